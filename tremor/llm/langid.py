"""Language of a text by rank-order profiles of its most frequent letter n-grams.

Training ranks each language's n-grams by frequency. A text is ranked the same way and
goes to the language whose profile is nearest by out-of-place distance: the sum, over
the text's n-grams, of the difference of ranks, or of ``profile`` for n-grams that the
language's profile lacks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_sample, flat_text, map_text, without

#: Longest n-gram, entries of a profile, and about the most labelled rows that profiles are learnt from.
LONGEST, PROFILE, TRAIN_ROWS = 3, 300, 20_000
#: Sharpness of the score, and the most that a reject distance can be, as a share of the largest possible distance.
SHARPNESS, FOREIGN = 25.0, 0.93
#: The reject distance is this quantile of the labelled rows' distances from profiles learnt without them, and a margin.
QUANTILE, MARGIN = 0.99, 0.2
#: Of a text without letters.
UNKNOWN = "und"

#: Bytes of text at a time: sorting its n-grams takes about a hundred times as much memory.
SLICE = 1 << 19

#: Characters of texts whose n-grams are counted at a time.
PIECE = 1 << 20

_WIDE = 13  # bits of a character in an n-gram's code
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point: its own folded code if it is a letter, else a blank's."""
    global _letters
    if _letters is None:
        points = np.arange(0x110000)
        folded = np.where(points < 1 << (_WIDE - 1), points, (1 << (_WIDE - 1)) + points % (1 << (_WIDE - 1)))
        is_letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        _letters = np.where(is_letter, folded, 32).astype(np.int64)
        _letters[0] = 0
    return _letters


def ranked_grams(texts: pa.Array, groups: np.ndarray | None = None, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count), by owner and n-gram; the owner is the text's place, or its entry in ``groups``.

    Letters in lower case count; all else is a blank, runs of blanks are one, and words
    stand between blanks. Characters beyond U+0FFF are folded into 4,096 codes. Long texts are counted in
    pieces of ``PIECE`` characters, each with the last codes of the one before, and the counts added.
    """
    plain = pc.replace_substring(flat_text(texts), "\0", " ")
    joined = " " + " \0 ".join(plain.to_pylist()) + " "
    packed, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail, tail_owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(joined), PIECE):
        codes = _letter_table()[np.frombuffer(joined[start : start + PIECE].lower().encode("utf-32-le", "replace"), np.uint32)]
        blank, last = codes == 32, len(tail) > 0 and tail[-1] == 32
        codes = codes[~(blank & np.concatenate(([last], blank[:-1])))]
        owner = (tail_owner[-1] if len(tail) else 0) + np.cumsum(codes == 0)
        codes, owner = np.concatenate((tail, codes)), np.concatenate((tail_owner, owner))
        found = _packed_grams(codes, owner if groups is None else groups[owner], len(tail), longest)
        if len(counts):  # what came before, and this piece
            packed, place = np.unique(np.concatenate((packed, found[0])), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, found[1])), len(packed)).astype(np.int64)
        else:
            packed, counts = found
        tail, tail_owner = codes[max(0, len(codes) - longest + 1) :], owner[max(0, len(codes) - longest + 1) :]
    return packed >> (_WIDE * longest), packed & ((1 << (_WIDE * longest)) - 1), counts


def _packed_grams(codes: np.ndarray, owner: np.ndarray, old: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and n-grams in one number, ascending, and the counts of those that end beyond the first ``old`` codes."""
    found = []
    gram = np.zeros(len(codes), np.int64)
    usable = np.ones(len(codes), bool)
    for n in range(longest):
        ends = codes[n:]
        gram = gram[: len(ends)] << _WIDE | ends
        usable = usable[: len(ends)] & (ends != 0)
        keep = usable & (ends != 32) if n == 0 else usable.copy()
        keep[: max(0, old - n)] = False
        found.append(owner[: len(ends)][keep] << (_WIDE * longest) | gram[keep])
    packed = np.sort(np.concatenate(found))
    if not len(packed):
        return packed, packed
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    return packed[first], np.diff(np.concatenate((first, [len(packed)])))


@dataclass
class Profiles:
    """Ranks of n-grams (rows, ascending) in languages (columns); ``entries`` where a profile lacks one.

    A text farther than ``foreign`` from all is in none of the languages.
    """

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    entries: int = PROFILE
    longest: int = LONGEST
    foreign: float = FOREIGN

    def distances(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the largest possible distance (texts x languages), and each text's n-grams that were compared."""
        owner, gram, count = ranked_grams(texts, longest=self.longest)
        order = np.argsort(owner << 32 | ((1 << 32) - 1 - count), kind="stable")
        owner, gram = owner[order], gram[order]
        starts = np.searchsorted(owner, np.arange(len(texts)))
        rank = np.arange(len(owner)) - starts[owner] if len(owner) else owner
        top = rank < self.entries
        owner, gram, rank = owner[top], gram[top], rank[top]
        n = np.bincount(owner, minlength=len(texts))
        out = np.ones((len(texts), len(self.languages)))
        if len(self.grams) and len(owner):
            at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            known = self.grams[at] == gram
            for k in range(len(self.languages)):
                ranks = np.where(known, self.ranks[at, k], self.entries)
                off = np.where(ranks < self.entries, np.abs(rank - ranks), self.entries)
                out[:, k] = np.bincount(owner, off, len(texts)) / np.maximum(n * self.entries, 1)
        return out, n

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score in 0 to 1, distance); ties go to the first language by name."""
        distance, n = self.distances(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        best = distance.argmin(axis=1)
        near = distance[np.arange(len(texts)), best]
        score = 1 / np.exp(-SHARPNESS * (distance - near[:, None])).sum(axis=1)
        names = [self.languages[b] if m else UNKNOWN for b, m in zip(best, n)]
        return names, np.where(n > 0, score, 0.0), near


def learn(labelled: DataFrame, rows: int = TRAIN_ROWS, entries: int = PROFILE, longest: int = LONGEST, reject: bool = True) -> Profiles:
    """Profiles of the languages of ``labelled`` (doc_id, text, lang); rows without text or language teach nothing.

    At most about ``rows`` rows are read, chosen by a hash of ``doc_id``. Equal counts rank by n-gram.
    With ``reject``, half of the rows' distances from profiles of the other half, both ways,
    give the reject distance.
    """
    half = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2)).cast("int"), F.lit(0))
    known = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("half", half)
    sample = bounded_sample(known, "doc_id", rows, known.select("lang").count())

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            codes = part.column("lang").dictionary_encode()
            groups = codes.indices.to_numpy().astype(np.int64) * 2 + part.column("half").to_numpy()
            owner, gram, count = ranked_grams(part.column("text"), groups, longest)
            return pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(owner // 2)), pa.array(owner % 2, pa.int32()), pa.array(gram), pa.array(count, pa.int64())], ["lang", "half", "gram", "n"])

        return work

    counts = map_text(sample.select("text", "lang", "half"), "lang string, half int, gram long, n long", make, limit=SLICE)
    by = {f"n{k}": F.sum(F.when(F.col("half") == k, F.col("n"))) for k in (0, 1)}
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), *[v.alias(k) for k, v in by.items()])
    columns = ["n", "n0", "n1"] if reject else ["n"]
    counts = counts.withColumns({f"r{c}": F.row_number().over(W.partitionBy("lang").orderBy(F.desc_nulls_last(c), "gram")) - 1 for c in columns})
    counts = counts.withColumns({f"r{c}": F.when(F.col(c).isNotNull() & (F.col(f"r{c}") < entries), F.col(f"r{c}")) for c in columns})
    got = counts.filter(F.coalesce(*[f"r{c}" for c in columns]).isNotNull()).collect()  # ``entries`` rows a language, three times at most
    profiles = {c: _profiles([(r.lang, r.gram, r[f"r{c}"]) for r in got if r[f"r{c}"] is not None], entries, longest) for c in columns}
    if reject and profiles["n"].languages:
        profiles["n"].foreign = _reject_distance(sample, [profiles["n0"], profiles["n1"]])
    return profiles["n"]


def _profiles(got: list[tuple[str, int, int]], entries: int, longest: int) -> Profiles:
    """Of (language, n-gram, rank)."""
    languages = sorted({lang for lang, _, _ in got})
    grams = np.unique(np.array([gram for _, gram, _ in got], np.int64))
    ranks = np.full((len(grams), len(languages)), entries, np.int64)
    for lang, gram, rank in got:
        ranks[np.searchsorted(grams, gram), languages.index(lang)] = rank
    return Profiles(languages, grams, ranks, entries, longest)


def _reject_distance(sample: DataFrame, halves: list[Profiles]) -> float:
    """From rows (text, half) and the profiles of the halves; ``FOREIGN`` where no row has letters."""
    held = sample.sparkSession.sparkContext.broadcast(halves)

    def make():
        models = held.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            half, out = part.column("half").to_numpy(), []
            for k in (0, 1):
                if (half == k).any():
                    _, _, near = models[1 - k].predict(part.column("text").filter(pa.array(half == k)))
                    out.append(near)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["d"])

        return work

    rows = map_text(sample.select("text", "half"), "d double", make, limit=SLICE).filter("d < 1")
    at = rows.agg(F.percentile("d", F.lit(QUANTILE)).alias("q")).head().q
    return FOREIGN if at is None else min(FOREIGN, at + MARGIN)


def identify(df: DataFrame, profiles: Profiles) -> DataFrame:
    """``df`` (with ``text``) and ``lang_pred``, ``score``, ``lang_distance``; columns of these names are replaced.

    Null texts and texts without letters are ``und`` with score 0 and distance 1.
    """
    rows, added = without(df, "lang_pred", "score", "lang_distance"), ["lang_pred", "score", "lang_distance"]
    held = df.sparkSession.sparkContext.broadcast(profiles)

    def make():
        model = held.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            names, score, near = model.predict(part.column("text"))
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(near)], [*part.schema.names, *added])

        return work

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return map_text(rows, f"{schema}, lang_pred string, score double, lang_distance double", make, limit=SLICE)


def keep_known_languages(df: DataFrame, profiles: Profiles) -> DataFrame:
    """Rows of ``df`` in a learnt language: with letters, and no farther than the reject distance from the nearest profile.

    Rows are kept as they are, repeated ones and null ids too; null and empty texts have no letters and go.
    """
    found = identify(df, profiles).filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_distance") <= profiles.foreign))
    return found.select(*[F.col(f"`{c}`") for c in df.columns])
