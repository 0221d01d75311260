"""Personal data by patterns and by a skip-chain conditional random field.

Patterns give the base: emails, addresses of hosts, payment cards, phones. The field
tags words and adds what the patterns miss: numbers that run into each other, phones
without their prefix, and whatever stands elsewhere in the document in a form
that is recognised.

Only words with a digit or an ``@`` can be personal; all others are outside, which the field
holds as a constraint, so a chain of neighbours ends at them. Each such word
is also joined to the next one of the same likeness in its document, however far (equal
but for the punctuation around it, or ending in the same seven digits): both share a
potential that rewards equal kinds. Marginals come from loopy message passing: each
round sends all messages along the chain and the skips at once. The labels of training are
the base; documents with a match that failed its check teach nothing, since its words have no sure label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blanks, bounded_sample, bytes_of, cut, fitted_in_task, map_text, released, runs, within_bytes, without

KINDS = ("email", "ip", "card", "phone")
#: States: outside; one word each of email and address; begin and rest of a card and of a phone.
STATES = ("", "email", "ip", "card", "card+", "phone", "phone+")
STATE_KIND = np.array([-1, 0, 1, 2, 2, 3, 3])
#: Documents with digits or ``@`` that the field is fitted on, at most about, and bytes of their text at most.
TRAIN_DOCS, TRAIN_BYTES = 3000, 8 << 20
#: Steps of the fit, rounds of message passing in it and in use.
STEPS, FIT_ROUNDS, ROUNDS = 80, 8, 24
#: Bytes of text at a time.
SLICE = 4 << 20

_EMAIL = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = bytes(c for c in range(256) if c not in b"0123456789")


def digits_of(text: bytes) -> bytes:
    return text.translate(None, _NOT_DIGITS)


def luhn(digits: bytes) -> bool:
    """The check digit of a card number."""
    twice = [2 * (c - 48) for c in digits[-2::-2]]
    return (sum(c - 48 for c in digits[::-2]) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def quad(text: bytes) -> bool:
    """Four numbers of at most 255 between dots."""
    parts = text.split(b".")
    return len(parts) == 4 and all(p.isdigit() and len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in parts)


def base_spans(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the patterns' matches in byte offsets, by kind and start; and ranges that failed their check.

    Each pattern is matched in time linear in the text: an email by its ``@``, the others without backtracking over digits.
    """
    found: list[tuple[int, int, int]] = []
    failed: list[tuple[int, int]] = []
    last = 0
    for m in _EMAIL.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((0, start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if quad(m[0]):
            found.append((1, *m.span()))
        else:
            failed.append(m.span())
    for m in _CARD.finditer(text):
        digits = digits_of(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
        elif len(digits) >= 16:
            failed.append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            found.append((3, *m.span()))
        else:
            failed.append(m.span())
    return found, failed


def features(word: bytes) -> list[str]:
    """Of a word: its number of digits, its shape, dots and ``@``, and checks of its core."""
    digits = digits_of(word)
    core = word.strip(b".,;:!?\"'()[]{}<>")
    shape, before = [], ""
    for c in word[:64]:
        kind = "0" if 48 <= c <= 57 else "a" if c >= 128 or chr(c).isalpha() else chr(c) if c in b"+@.-()" else "_"
        if kind != before:
            shape.append(kind)
        before = kind
    out = [f"digits {min(len(digits), 20)}", f"shape {''.join(shape)[:16]}", f"@ {min(word.count(b'@'), 2)}", f"dots {min(core.count(b'.'), 5)}"]
    if word[:1] == b"+":
        out.append("plus")
    if b"." in core.partition(b"@")[2]:
        out.append("host")
    if quad(core):
        out.append("quad")
    if 16 <= len(digits) <= 19 and luhn(digits):
        out.append("luhn")
    return out


def possible(word: bytes) -> np.ndarray:
    """States that a word can have at all: an email has one ``@``, an address three dots, cards and phones no more digits than they may."""
    digits = len(digits_of(word))
    bare = 0 < digits and word.isascii() and not any(chr(c).isalpha() for c in word) and b"@" not in word
    card, phone = bare and digits <= 19, bare and digits <= 15
    return np.array([True, word.count(b"@") == 1, word.strip(b".,;:!?").count(b".") == 3, card, card, phone, phone])


def likeness(word: bytes) -> bytes:
    """Words of equal likeness are joined: the last seven digits, or the word in lower case without punctuation around it."""
    digits = digits_of(word)
    if b"@" not in word and len(digits) >= 7:
        return digits[-7:]
    return word.strip(b".,;:!?\"'()[]{}<>+-").lower()


@dataclass
class Graph:
    """Words that can be personal, by document and place; -1 where there is no neighbour."""

    doc: np.ndarray
    start: np.ndarray  # in bytes, within the document
    end: np.ndarray
    words: list[bytes]
    left: np.ndarray  # the word just before
    right: np.ndarray
    back: np.ndarray  # the last word before of the same likeness
    ahead: np.ndarray


def graph_of(data: np.ndarray, offsets: np.ndarray) -> Graph:
    """Of the texts in ``data``."""
    starts, ends = runs(~blanks(data), offsets)
    marked = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    place = np.unique(np.searchsorted(starts, marked, side="right") - 1)
    starts, ends = starts[place], ends[place]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n = len(place)
    near = np.zeros(n, bool)
    near[1:] = (np.diff(place) == 1) & (np.diff(doc) == 0)
    left = np.where(near, np.arange(n) - 1, -1)
    right = np.where(np.concatenate((near[1:], [False]))[:n], np.arange(n) + 1, -1)
    words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
    back, ahead = np.full(n, -1), np.full(n, -1)
    last: dict[tuple[int, bytes], int] = {}
    for i, (d, w) in enumerate(zip(doc.tolist(), words)):
        key = d, likeness(w)
        if (j := last.get(key, -1)) >= 0:
            back[i], ahead[j] = j, i
        last[key] = i
    return Graph(doc, starts - offsets[doc], ends - offsets[doc], words, left, right, back, ahead)


def _allowed() -> np.ndarray:
    """Which state may follow which: the rest of a card or phone follows its begin or rest only."""
    out = np.ones((7, 7), bool)
    for rest in (4, 6):
        out[:, rest] = False
        out[[rest - 1, rest], rest] = True
    return out


ALLOWED = _allowed()
#: Log factor of a state that a word cannot have.
NEVER = -60.0
#: Rewards of a skip by the states at its ends: both outside, or of one kind.
SAME = (STATE_KIND[:, None] == STATE_KIND[None, :]) & (STATE_KIND[:, None] >= 0)
OUTSIDE = (STATE_KIND[:, None] < 0) & (STATE_KIND[None, :] < 0)


def _even(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(rows.sum(axis=1, keepdims=True), 1e-300)


def pass_messages(g: Graph, own: np.ndarray, step: np.ndarray, skip: np.ndarray, rounds: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Beliefs of the nodes with factors ``own``, and the messages that reach them from each side.

    Exact after as many rounds as the longest way where documents' graphs have no loop.
    """
    sides = {"left": g.left, "right": g.right, "back": g.back, "ahead": g.ahead}
    through = {"left": step, "right": step.T, "back": skip, "ahead": skip.T}  # from there to here
    opposite = {"left": "right", "right": "left", "back": "ahead", "ahead": "back"}
    n, k = own.shape
    mail = {s: np.full((n, k), 1.0 / k) for s in sides}
    mail["left"][:] = step[0]  # the word before is outside, as is the document's edge
    mail["right"][:] = step[:, 0]
    mail = {s: _even(m) for s, m in mail.items()}
    here = {s: np.flatnonzero(at >= 0) for s, at in sides.items()}
    for s in ("left", "right"):
        mail[s][here[s]] = 1.0 / k
    for _ in range(rounds):
        new = {}
        for s, at in sides.items():
            to = here[s]
            new[s] = mail[s]
            if len(to):
                source, rest = at[to], own[at[to]]
                for other in sides:
                    if other != opposite[s]:
                        rest = rest * mail[other][source]
                new[s] = mail[s].copy()
                new[s][to] = _even(rest @ through[s])
        mail = new
    belief = own.copy()
    for m in mail.values():
        belief = belief * m
    return _even(belief), mail


def _pairs(g: Graph, own: np.ndarray, mail: dict[str, np.ndarray], factor: np.ndarray, near: str) -> np.ndarray:
    """Expected states at both ends of all chain (``near`` left) or skip (back) edges, summed."""
    there = {"left": ("right", g.left), "back": ("ahead", g.back)}[near]
    to = np.flatnonzero(there[1] >= 0)
    if not len(to):
        return np.zeros_like(factor)
    a, b = own[there[1][to]], own[to]
    for s, m in mail.items():
        if s != there[0]:
            a = a * m[there[1][to]]
        if s != near:
            b = b * m[to]
    joint = a[:, :, None] * factor * b[:, None, :]
    return (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)


@dataclass
class Field:
    """Weights by feature and state, of transitions (the first row and column also stand for the words around), and of skips."""

    emit: dict[str, np.ndarray]
    trans: np.ndarray
    skip: np.ndarray  # of equal kinds, of both outside
    _known: dict[bytes, np.ndarray] = field(default_factory=dict)

    def own(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), 7))
        for i, w in enumerate(words):
            if (row := self._known.get(w)) is None:
                if len(self._known) > 100_000:
                    self._known.clear()
                row = sum((self.emit[f] for f in features(w) if f in self.emit), np.where(possible(w), 0.0, NEVER))
                if len(w) <= 64:
                    self._known[w] = row
            out[i] = row
        return np.exp(out - out.max(axis=1, keepdims=True)) if len(words) else out

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(self.trans) * ALLOWED, np.exp(self.skip[0] * SAME + self.skip[1] * OUTSIDE)

    def beliefs(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        return pass_messages(g, self.own(g.words), *self.factors(), rounds)[0]


def _labels(g: Graph, texts: list[bytes]) -> np.ndarray:
    """State of each word by the patterns; -1 where they do not tell: in a failed match, or in two matches."""
    out = np.zeros(len(g.doc), np.int64)
    where = np.searchsorted(g.doc, np.arange(len(texts) + 1))
    for d, text in enumerate(texts):
        a, b = where[d], where[d + 1]
        taken = np.zeros(b - a, bool)
        found, failed = base_spans(text)
        for kind, start, end in [*((-1, *x) for x in failed), *found]:
            i, j = int(np.searchsorted(g.end[a:b], start, side="right")), int(np.searchsorted(g.start[a:b], end))
            states = np.full(j - i, -1 if kind < 0 else 1 + kind if kind < 2 else 3 + 2 * (kind - 2))
            if kind >= 2:
                states[1:] += 1
            out[a + i : a + j] = np.where(taken[i:j], -1, states)
            taken[i:j] = True
    return out


def fit(texts: list[bytes], steps: int = STEPS) -> Field:
    """By the likelihood of the labels, with expectations from message passing; texts that the patterns do not label wholly are left out."""

    def labelled() -> tuple[Graph, np.ndarray]:
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        g = graph_of(np.frombuffer(b"".join(texts), np.uint8), offsets)
        return g, _labels(g, texts)

    g, y = labelled()
    if (y < 0).any():
        unsure = set(g.doc[y < 0].tolist())
        texts = [t for d, t in enumerate(texts) if d not in unsure]
        g, y = labelled()
    lists = [features(w) for w in g.words]
    number = {f: i for i, f in enumerate(sorted({f for fs in lists for f in fs}))}
    row = np.repeat(np.arange(len(lists)), [len(fs) for fs in lists])
    col = np.array([number[f] for fs in lists for f in fs], np.int64)
    n, k = len(lists), len(number)
    never = np.array([np.where(possible(w), 0.0, NEVER) for w in g.words]).reshape(n, 7)
    w = np.zeros(7 * k + 49 + 2)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)

    def sums(own: np.ndarray, step: np.ndarray, skip: np.ndarray) -> np.ndarray:
        belief, mail = pass_messages(g, own, step, skip, FIT_ROUNDS)
        emit = np.zeros((k, 7))
        np.add.at(emit, col, belief[row])
        trans = _pairs(g, own, mail, step, "left")
        trans[0] += belief[g.left < 0].sum(axis=0)
        trans[:, 0] += belief[g.right < 0].sum(axis=0)
        both = _pairs(g, own, mail, skip, "back")
        return np.concatenate((emit.ravel(), trans.ravel(), [both[SAME].sum(), both[OUTSIDE].sum()]))

    observed = sums((np.arange(7) == y[:, None]).astype(float), ALLOWED * 1.0, np.ones((7, 7)))
    for t in range(1, steps + 1 if n else 1):
        scores = never.copy()
        np.add.at(scores, row, w[: 7 * k].reshape(k, 7)[col])
        own = np.exp(scores - scores.max(axis=1, keepdims=True))
        step = np.exp(w[7 * k : 7 * k + 49].reshape(7, 7)) * ALLOWED
        skip = np.exp(w[-2] * SAME + w[-1] * OUTSIDE)
        grad = (observed - sums(own, step, skip)) / n - 1e-4 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w = w + 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    emit = w[: 7 * k].reshape(k, 7)
    return Field({f: emit[i] for f, i in number.items()}, w[7 * k : 7 * k + 49].reshape(7, 7), w[-2:])


def learn(docs: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """From about ``rows`` of the texts of ``docs`` (doc_id, text) with a digit or ``@`` at most; no labels are read."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text RLIKE '[0-9@]'")
    total = held.count()
    sample = cut(bounded_sample(held, "doc_id", rows, total), "sample")
    field = fitted_in_task(within_bytes(sample, "doc_id", TRAIN_BYTES).select("doc_id", "text"), lambda got: fit([t.encode() for _, t in got]))  # ``TRAIN_BYTES`` at most
    released(sample)
    return field


def _core(kind: int, text: bytes) -> tuple[int, int] | None:
    """The part of a tagged text that can be of its kind, or None."""
    ends = b"0123456789" if kind else _LOCAL - frozenset(b"._%+-")
    inside = [i for i, c in enumerate(text) if c in ends]
    if not inside:
        return None
    start, end = inside[0], inside[-1] + 1
    if kind == 3:
        while start and text[start - 1] in b"+(":
            start -= 1
    core, digits = text[start:end], digits_of(text)
    good = (core.count(b"@") == 1 and b"@" not in (core[:1], core[-1:]), quad(core), 16 <= len(digits) <= 19 and luhn(digits), 7 <= len(digits) <= 15)[kind]
    return (start, end) if good else None


def added_spans(g: Graph, states: np.ndarray, nodes: range, text: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the states of a document's words tag beyond its base: well formed, and apart from every base span."""
    found, i = [], nodes.start
    while i < nodes.stop:
        kind = int(STATE_KIND[states[i]])
        j = i + 1
        if kind >= 0:
            while j < nodes.stop and g.left[j] == j - 1 and states[j] == 4 + 2 * (kind - 2) and kind >= 2:
                j += 1
            start, end = int(g.start[i]), int(g.end[j - 1])
            if (core := _core(kind, text[start:end])) is not None:
                a, b = start + core[0], start + core[1]
                if not any(s < b and a < e for _, s, e in base):
                    found.append((kind, a, b))
        i = j
    return found


def _points(text: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    raw, out, last, n = np.frombuffer(text, np.uint8), {}, 0, 0
    for p in sorted(set(places)):
        n += int(((raw[last:p] & 0xC0) != 0x80).sum())
        out[p] = n
        last = p
    return out


def find(df: DataFrame, model: Field) -> DataFrame:
    """``df`` (with ``text``) and ``pii``: kind, start and end (code points) of each span, and whether a pattern matched it.

    Base spans come first, by kind and start, then those of the field. Null texts are empty; a column ``pii`` is replaced.
    """
    rows = without(df, "pii")
    held = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def make():
        model = held.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = bytes_of(part.column("text"))
            g = graph_of(data, offsets)
            states = model.beliefs(g).argmax(axis=1) if len(g.doc) else np.zeros(0, np.int64)
            where = np.searchsorted(g.doc, np.arange(part.num_rows + 1))
            out: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for d in np.flatnonzero(np.diff(where)).tolist():
                text = data[offsets[d] : offsets[d + 1]].tobytes()
                base, _ = base_spans(text)
                more = added_spans(g, states, range(where[d], where[d + 1]), text, base)
                at = _points(text, [p for _, a, b in base + more for p in (a, b)])
                out[d] = [{"kind": KINDS[k], "start": at[a], "end": at[b], "base": own} for own, spans in ((True, base), (False, more)) for k, a, b in spans]
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], [*part.schema.names, "pii"])

        return work

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return map_text(rows, f"{schema}, pii array<struct<kind: string, start: long, end: long, base: boolean>>", make, limit=SLICE)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the hash of the base, and all spans as ``kind:start:end`` joined by commas, from ``find``."""
    order = F.expr("array_sort(pii, (a, b) -> coalesce(nullif(array_position(array('email', 'ip', 'card', 'phone'), a.kind) - array_position(array('email', 'ip', 'card', 'phone'), b.kind), 0), a.start - b.start)::int)")
    rows = found.select("doc_id", order.alias("pii"))
    text = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"size(filter(pii, s -> s.base AND s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    added = F.expr("size(filter(pii, s -> NOT s.base))").cast("long").alias("n_added")
    return rows.select("doc_id", *counts, F.sha2(F.expr(text.format("filter(pii, s -> s.base)")), 256).alias("base_sha256"), F.expr(text.format("pii")).alias("spans"), added)


def masked(found: DataFrame) -> DataFrame:
    """The rows of ``find`` with each span of ``text`` replaced by its kind in brackets; of overlapping spans the first is."""
    step = """aggregate(array_sort(pii, (a, b) -> (a.start - b.start)::int), named_struct('out', '', 'at', 0L),
      (a, s) -> IF(s.start < a.at, a, named_struct('out', concat(a.out, substring(text, (a.at + 1)::int, (s.start - a.at)::int), '[', s.kind, ']'), 'at', s.end)),
      a -> concat(a.out, substring(text, (a.at + 1)::int)))"""
    return found.withColumn("text", F.when(F.size("pii") > 0, F.expr(step)).otherwise(F.col("text")))
