"""Transcript parsing: a hidden Markov model recovers roles, turns are rendered canonically.

A transcript is lines; a turn's first line may carry a speaker marker ("User:",
"### Assistant", "[system]", ...), its other lines none, and markers may be missing. The
states are each role's first line and later lines; a line's features (its marker, its
form) are independent given the state. Parameters are counts over turns with known
roles, with markers taken off some of them; the most likely states come from Viterbi.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Roles in canonical order. Names that mark a speaker.
ROLES = ("system", "user", "assistant")
NAMES = {"system": ("system", "instruction", "instructions"), "user": ("user", "human", "customer", "q"), "assistant": ("assistant", "ai", "bot", "agent", "model", "a")}
#: How many turns of training lose their marker, in eighths.
BARE_EIGHTHS = 3
#: Less than any difference that matters between paths.
TIE = 1e-6
#: A line's forms: ends as a question; starts in lower case; blank; list or code; short.
FORMS = 5

_ROLE_OF = {n: r for r, names in enumerate(NAMES.values()) for n in names}
_MARKER = re.compile(rf"^\s*(?:[#*<\[|]+\s*)?({'|'.join(sorted(_ROLE_OF, key=len, reverse=True))})\s*(?:[\]>*|#]+\s*:?|:)\s*", re.IGNORECASE)
_LIST = re.compile(r"\s*(?:[-*+>]|\d+[.)]|```|    )")


def marker(line: str) -> tuple[int, int]:
    """(role of a line's speaker marker or 3, characters of the marker)."""
    found = _MARKER.match(line)
    return (_ROLE_OF[found[1].lower()], found.end()) if found else (len(ROLES), 0)


def unmarked(line: str, role: int) -> str:
    """A turn's first line without the speaker marker of the turn's role."""
    found, n = marker(line)
    return line[n:] if found == role else line


def rendering(role: str, body: str) -> str:
    return f"<|{role}|>\n{body}\n<|end|>\n"


def forms(line: str) -> tuple[bool, ...]:
    body = line.strip()
    return body.endswith("?"), body[:1].islower(), not body, bool(_LIST.match(line)), len(body) < 40


@dataclass
class Model:
    """Log probabilities; states are 2 * role for a turn's first line, 2 * role + 1 for later ones."""

    start: np.ndarray
    trans: np.ndarray
    marks: np.ndarray
    forms: np.ndarray

    def line(self, text: str, *place: object) -> np.ndarray:
        """Log likelihood of a line in each state, and less than ``TIE`` by its place.

        Paths that differ only in which of two like lines starts a turn are equally likely;
        the addition chooses one of them whatever order sums are taken in.
        """
        own = self.marks[:, marker(text)[0]].copy()
        for k, on in enumerate(forms(text)):
            own += self.forms[:, k, int(on)]
        digest = hashlib.blake2b("|".join(map(str, place)).encode(), digest_size=2 * len(own)).digest()
        return own + np.frombuffer(digest, "<u2") * (TIE / (1 << 16))

    def viterbi(self, lines: list[str]) -> list[int]:
        """The most likely states of a whole transcript."""
        walk = Walk(self)
        return [s for i, line in enumerate(lines) for s, _ in walk.push(self.line(line, i), None)] + [s for s, _ in walk.finish()]

    def turns(self, text: str) -> list[tuple[int, str, str]]:
        """(first line, role, text without its marker) of the turns found in a raw transcript."""
        lines, out = text.split("\n"), []
        for i, state in enumerate(self.viterbi(lines)):
            if state % 2 == 0:
                out.append((i, ROLES[state // 2], [unmarked(lines[i], state // 2)]))
            else:
                out[-1][2].append(lines[i])
        return [(i, role, "\n".join(body)) for i, role, body in out]


class Walk:
    """Viterbi that gives states as soon as all best paths agree on them, so long transcripts need little memory.

    A piece of a transcript starts after the known state of the line before it (``before``)
    and, unless it is the last piece, ends in a known state (see ``finish``).
    """

    def __init__(self, model: Model) -> None:
        self.model, self.best, self.back, self.held = model, None, [], []

    def push(self, own: np.ndarray, item, before: int | None = None) -> list[tuple[int, object]]:
        """``own`` is the line's log likelihood in each state."""
        if self.best is None:
            self.best = (self.model.start if before is None else self.model.trans[before]) + own
            self.back.append(np.zeros(len(own), np.int64))
        else:
            paths = self.best[:, None] + self.model.trans
            at = paths.argmax(axis=0)
            self.back.append(at)
            self.best = paths[at, np.arange(len(own))] + own
        self.held.append(item)
        return self._agreed() if len(self.held) % 256 == 0 else []

    def _agreed(self) -> list[tuple[int, object]]:
        states = np.arange(len(self.best))
        for t in range(len(self.held) - 1, 0, -1):
            states = np.unique(self.back[t][states])
            if len(states) == 1:
                out = self._trace(t - 1, int(states[0]))
                self.back, self.held = self.back[t:], self.held[t:]
                return out
        return []

    def _trace(self, t: int, state: int) -> list[tuple[int, object]]:
        out = []
        for k in range(t, -1, -1):
            out.append((state, self.held[k]))
            state = int(self.back[k][state])
        return out[::-1]

    def finish(self, last: int | None = None) -> list[tuple[int, object]]:
        out = self._trace(len(self.held) - 1, int(self.best.argmax()) if last is None else last) if self.held else []
        self.best, self.back, self.held = None, [], []
        return out


def bare(conv: object, turn: object, eighths: int) -> bool:
    """Whether a turn of the table is written without its marker."""
    return zlib.crc32(f"{conv}:{turn}".encode()) % 8 < eighths


def turn_lines(role: str | None, text: str | None, hidden: bool) -> list[str]:
    """Lines of a turn as a log would have them; an unknown role has no marker."""
    lines = (text or "").split("\n")
    return lines if hidden or role not in ROLES else [f"{role.capitalize()}: {lines[0]}", *lines[1:]]


def _dealt(turns: DataFrame) -> DataFrame:
    """Turns in order of conversation and turn (nulls first), then role and text, in written runs (``part``).

    Runs are ranges of that order, so a long conversation is cut into pieces in several
    runs; see ``_pieces`` for what crosses a cut. The runs are written, so all passes see
    the same ones.
    """
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "turns")


def _by_run(dealt: DataFrame) -> DataFrame:
    parts = max(1, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select("part", "conv_id", "turn", "role", "text", "at").repartition(parts, "part").sortWithinPartitions("part", "at")


def _rows(batches: Iterator[pa.RecordBatch], columns: int = 5) -> Iterator[tuple]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, 256).columns[:columns]))


def _pieces(dealt: DataFrame, model: Model, eighths: int) -> dict[tuple[int, object], tuple[int | None, int | None]]:
    """(state before, last state) of the pieces of conversations that are in several runs.

    A piece's lines take each state before it (or the start) to each last state with some
    best value; the table of these values is all that the best path through a whole
    conversation needs of the piece. Only a run's first and last conversation can be cut, so there are two
    tables a run at most, whatever the number of turns.
    """

    def tables(batches):
        now, table, first, out = None, None, True, []

        def close(last: bool):
            if table is not None and (first or last):
                out.append((now[0], now[1], table.ravel().tolist()))

        for part, conv, turn, role, text in _rows(batches):
            if now != (part, conv):
                new_run = now is None or now[0] != part
                close(new_run)
                now, table, first = (part, conv), None, new_run
            for i, line in enumerate(turn_lines(role, text, bare(conv, turn, eighths))):
                own = model.line(line, conv, turn, i)
                table = np.vstack([model.trans, model.start]) + own if table is None else (table[:, :, None] + model.trans[None]).max(axis=1) + own
        close(True)
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.list_(pa.float64())))], ["part", "conv_id", "best"])

    found: dict[object, list[tuple[int, np.ndarray]]] = {}
    for r in _by_run(dealt).mapInArrow(tables, "part int, conv_id long, best array<double>").collect():
        found.setdefault(r.conv_id, []).append((r.part, np.array(r.best).reshape(2 * len(ROLES) + 1, -1)))
    out = {}
    for conv, parts in found.items():
        if len(parts) < 2:
            continue
        parts.sort(key=lambda x: x[0])
        best, back = parts[0][1][-1], []
        for _, table in parts[1:]:
            paths = best[:, None] + table[:-1]
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0)
        last, known = int(best.argmax()), None
        for (part, _), steps in zip(parts[:0:-1], back[::-1]):
            before = int(steps[last])
            out[part, conv] = before, known
            last = known = before
        out[parts[0][0], conv] = None, known
    return out


def learn(turns: DataFrame, eighths: int = BARE_EIGHTHS) -> Model:
    """From turns (conv_id, turn, role, text) of all conversations given; others than ``ROLES`` teach nothing.

    Null texts count as one empty line, repeated rows as turns of their own, turns of a null
    conversation as one conversation; without turns, all states are equally likely.
    """
    k = 2 * len(ROLES)

    def count(batches):
        start, trans, marks, form = np.zeros(k), np.zeros((k, k)), np.zeros((k, 4)), np.zeros((k, FORMS, 2))
        edges, run, now, last, opened = [], None, None, None, False
        for part, conv, turn, role, text in _rows(batches):
            if part != run:
                if run is not None:
                    edges.append((run, 1, now, last))
                run, now, last, opened = part, conv, None, True
            elif conv != now:
                now, last, opened = conv, None, False
            if role not in ROLES:
                continue
            for i, line in enumerate(turn_lines(role, text, bare(conv, turn, eighths))):
                state = 2 * ROLES.index(role) + (i > 0)
                if last is not None:
                    trans[last, state] += 1
                elif opened:
                    edges.append((part, 0, conv, state))  # what is before it is in another run, if anywhere
                else:
                    start[state] += 1
                marks[state, marker(line)[0]] += 1
                for f, on in enumerate(forms(line)):
                    form[state, f, int(on)] += 1
                last = state
        if run is not None:
            edges.append((run, 1, now, last))
        flat = np.concatenate([x.ravel() for x in (start, trans, marks, form)])
        rows = [(None, None, None, i, n) for i, n in enumerate(flat.tolist())] + [(p, e, c, s, None) for p, e, c, s in edges]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()))], ["part", "edge", "conv_id", "i", "n"])

    counted = cut(_by_run(_dealt(turns)).mapInArrow(count, "part int, edge int, conv_id long, i int, n double"), "counts")
    flat = np.zeros(k + k * k + k * 4 + k * FORMS * 2)
    for r in counted.filter("edge IS NULL").groupBy("i").agg(F.sum("n").alias("n")).collect():  # a row for each parameter
        flat[r.i] = r.n
    held: tuple[object, int | None] = (object(), None)
    for r in counted.filter("edge IS NOT NULL").orderBy("part", "edge").collect():  # two rows a run at most
        same = held[0] == r.conv_id and held[1] is not None
        if r.edge == 0:
            flat[k + held[1] * k + r.i if same else r.i] += 1
        elif r.i is not None or held[0] != r.conv_id:
            held = r.conv_id, r.i
    parts, at = [], 0
    for shape in ((k,), (k, k), (k, 4), (k, FORMS, 2)):
        size = int(np.prod(shape))
        n = flat[at : at + size].reshape(shape) + 0.5
        parts.append(np.log(n / n.sum(axis=-1, keepdims=True)))
        at += size
    parts[0][1::2] = -1e6  # a transcript starts with a turn's first line
    for a in range(k):
        for b in range(1, k, 2):
            if a // 2 != b // 2:
                parts[1][a, b] = -1e6  # a later line follows its own turn
    return Model(*parts)


def parse(turns: DataFrame, model: Model, eighths: int = BARE_EIGHTHS) -> DataFrame:
    """Turns as transcripts, parsed: (conv_id, turn, marked, role_pred, starts, rendered, agrees, recovered), a row for each turn.

    The transcript of a conversation is its turns' lines in order; ``marked`` says whether
    the turn has a marker there. ``role_pred`` is the role of the turn's first line,
    ``starts`` whether a turn was found to start there, ``rendered`` the table's turn as
    ``<|role|>`` text ``<|end|>``. Null texts count as one empty line; repeated rows are
    turns of their own; turns of a null conversation are one conversation.

    ``recovered`` holds the turns that the model found to start in the row, with the line
    of the row, role and canonical turn: all lines up to the next start, in whatever rows
    these are. ``agrees`` says whether a turn was found to start at the row's first line
    and nowhere else in it.
    """

    dealt = _dealt(turns)
    known = _pieces(dealt, model, eighths)
    names = ["part", "at", "conv_id", "turn", "marked", "role_pred", "starts", "rendered", "before", "found"]
    pieces = pa.list_(pa.struct([("line", pa.int32()), ("role", pa.string()), ("starts", pa.bool_()), ("text", pa.string())]))
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pieces)

    def batch(rows):
        rows = [(*r[:-1], [{"line": i, "role": role, "starts": starts, "text": "\n".join(lines)} for i, role, starts, lines in r[-1]]) for r in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches):
        walk, now, out = Walk(model), (None, None), []
        opened = None  # the row of this run's piece in which the current turn started

        def put(found):
            nonlocal opened
            for state, (head, i, line) in found:
                role, starts = ROLES[state // 2], state % 2 == 0
                if i == 0:
                    part, at, conv, turn, marked, body = head
                    out.append((part, at, conv, turn, marked, role, starts, rendering(role, body), None if starts else opened, []))
                pieces = out[-1][-1]
                if starts:
                    opened = out[-1][1]
                    pieces.append((i, role, True, [unmarked(line, state // 2)]))
                elif i == 0:
                    pieces.append((0, role, False, [line]))
                else:
                    pieces[-1][-1].append(line)

        for part, conv, turn, role, text, at in _rows(batches, 6):
            if (part, conv) != now:
                put(walk.finish(known.get(now, (None, None))[1]))
                now, opened = (part, conv), None
            hidden = bare(conv, turn, eighths) or role not in ROLES
            for i, line in enumerate(turn_lines(role, text, hidden)):
                head = None
                if i == 0:
                    body = text or ""
                    if hidden:
                        body = body[marker(body.split("\n", 1)[0])[1] :]
                    head = part, at, conv, turn, not hidden, body
                put(walk.push(model.line(line, conv, turn, i), (head, i, line), known.get(now, (None, None))[0]))
            if len(out) > 256:  # the last row can still get lines
                yield batch(out[:-1])
                del out[:-1]
        put(walk.finish(known.get(now, (None, None))[1]))
        if out:
            yield batch(out)

    schema = "part int, at long, conv_id long, turn long, marked boolean, role_pred string, starts boolean, rendered string, before long, found array<struct<line int, role string, starts boolean, text string>>"
    return _recovered(cut(_by_run(dealt).mapInArrow(run, schema), "parsed"))


def _recovered(rows: DataFrame) -> DataFrame:
    """Rows of ``parse`` with the turns that start in them; lines in later rows are brought to the row of their turn's start.

    A run's first lines can belong to a turn of an earlier run: to the last that starts
    there, of which there is one a run.
    """
    starts = F.filter("found", lambda x: x.starts)
    last, before = None, []
    ends = rows.groupBy("part").agg(F.max(F.when(F.size(starts) > 0, F.col("at"))).alias("at")).orderBy("part").collect()  # a row a run
    for r in ends:
        before.append((r.part, last))
        last = last if r.at is None else r.at
    earlier = rows.sparkSession.createDataFrame(before, "part int, earlier long")
    later = rows.filter("NOT starts").join(F.broadcast(earlier), "part").select(F.coalesce("before", "earlier").alias("at"), F.struct("at", F.col("found")[0]["text"].alias("text")).alias("piece"))
    later = later.groupBy("at").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    later = later.select("at", F.concat(F.lit("\n"), F.array_join(F.col("pieces.text"), "\n")).alias("rest"))
    rows = rows.join(later, "at", "left").withColumn("own", starts)
    text = lambda x, i: F.concat(x.text, F.when(i == F.size("own") - 1, F.coalesce("rest", F.lit(""))).otherwise(""))
    turn = lambda x, i: F.struct(x.line.alias("line"), x.role.alias("role"), F.concat(F.lit("<|"), x.role, F.lit("|>\n"), text(x, i), F.lit("\n<|end|>\n")).alias("rendered"))
    agrees = F.col("starts") & (F.size("found") == 1)
    return rows.select("conv_id", "turn", "marked", "role_pred", "starts", "rendered", agrees.alias("agrees"), F.transform("own", turn).alias("recovered"))


def parse_text(transcripts: DataFrame, model: Model) -> DataFrame:
    """Raw transcripts (conv_id, text), parsed: (conv_id, turn, line, role, rendered), a row for each turn found; null texts have none."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for conv, text in zip(*(c.to_pylist() for c in batch.slice(a, 256).columns)):
                    found = [] if text is None else model.turns(text)
                    rows += [(conv, k, i, role, rendering(role, body)) for k, (i, role, body) in enumerate(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], ["conv_id", "turn", "line", "role", "rendered"])

    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), "text")
    return rows.mapInArrow(run, "conv_id long, turn long, line int, role string, rendered string")
