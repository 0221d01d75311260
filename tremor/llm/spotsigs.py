"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

At each anchor, the next ``CHAIN`` content words at a distance of ``STEP`` content words
make one signature with the anchor. A text's fingerprint is the set of its signatures;
likeness is Jaccard's. Two sets can reach a likeness of t only if the smaller has at
least t times the larger's size, so near pairs are sought within a partition of set
sizes and the next one, and a comparison stops as soon as t is out of reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, even_keys, map_text, text_slices

#: Common words of English, French, German and Spanish, which open chains and are not content.
ANCHORS = frozenset(
    """a an the of and to in is was are be been it that this with for on as at by from or not but he she they his her its there said can had has have which
    le la les un une des du de et en est que qui dans pour pas sur au aux avec il elle ce cette par
    der die das und ist von zu den dem ein eine mit auf nicht im es auch sich
    el los las y es una por con para del se lo su al como""".split()
)
#: Content words in a chain and the step between them.
CHAIN, STEP = 2, 1
#: Near pairs of documents.
NEAR = 0.8
#: Texts of about so many bytes are a range of ids, and a task, of their own.
RANGE_BYTES = 32 << 20

_WORD = regex.compile(r"[\p{L}\p{N}]+")


def signature_set(text: str | None) -> frozenset[int]:
    """64-bit hashes of a text's spot signatures.

    A text without a full chain has one signature, of its words, or of the text itself if
    it has none; so equal texts always have equal, and never empty, sets.
    """
    words = _WORD.findall((text or "").lower())
    content = [w for w in words if w not in ANCHORS]
    found, at, span = set(), 0, (CHAIN - 1) * STEP + 1
    digest = xxhash.xxh3_64_intdigest
    for w in words:
        if w not in ANCHORS:
            at += 1
        elif at + span <= len(content):
            found.add(digest(f"{w}:{':'.join(content[at : at + span : STEP])}"))
        else:
            break
    if not found:
        found.add(digest("\0" + " ".join(words) if words else "\1" + (text or "")))
    return frozenset(found)


def fingerprint(signatures: frozenset[int]) -> str:
    """Size and hash of a set, as text."""
    raw = np.sort(np.fromiter(signatures, np.uint64, len(signatures))).astype("<u8").tobytes()
    return f"{len(signatures)}-{hashlib.blake2b(raw, digest_size=16).hexdigest()}"


def likeness(a: frozenset[int], b: frozenset[int], least: float = 0.0) -> float:
    """Jaccard similarity; 0 as soon as it cannot reach ``least``."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not large or len(small) < least * len(large):
        return 0.0
    if not least:
        common = len(small & large)
    else:
        # ``misses`` elements of the smaller set may be missing before the pair is lost.
        misses, common = len(small) - least / (1 + least) * (len(small) + len(large)) + 1e-9, 0
        for x in small:
            if x in large:
                common += 1
            elif (misses := misses - 1) < 0:
                return 0.0
    return common / (len(a) + len(b) - common)


def edited(text: str | None, following: str | None) -> str:
    """``text`` with its last quarter replaced by as many first code points of ``following``, or all of it."""
    text = text or ""
    n = len(text) // 4
    return text[: len(text) - n] + (following or "")[:n]


def with_next(df: DataFrame, out: str, step) -> DataFrame:
    """Rows that ``step(doc_id, text, next_text, state)`` makes of each row and the next one, by ascending ``doc_id``.

    After the last row comes the first. Rows are dealt to ranges of ids; the first rows of
    a range are dealt to the range before it as well, so each range streams alone: one
    shuffle of the texts, no global window. Null ids sort first, equal ids by text.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(1, -(-docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0] // RANGE_BYTES))
    parts = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    stats = docs.agg(F.percentile_approx("doc_id", cuts, 100 * parts).alias("at"), F.min("doc_id").alias("lo"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).head()
    bounds = sorted({b for b in stats.at or [] if b != stats.lo})
    cells, last = np.array(bounds, np.int64), len(bounds)
    keys = F.array(*[F.lit(k) for k in even_keys(spark, last + 1)])

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the range of an id, and one more for the first id of a range but the first."""
        known = ids.to_numpy()
        at = np.searchsorted(cells, known, side="right")
        edge = (at > 0) & (cells[np.maximum(at - 1, 0)] == known) if len(cells) else np.zeros(len(known), bool)
        return pd.Series(2 * at + edge)

    spot = lambda part, extra: F.struct(part.cast("int").alias("part"), F.lit(extra).alias("extra"))
    at = F.shiftright("_at", 1)
    opens = F.col("doc_id").isNull() if stats.nulls else F.col("doc_id") == F.lit(stats.lo)
    spots = F.array(spot(at, 0), F.when(F.col("_at") % 2 == 1, spot(at - 1, 1)), F.when(opens, spot(F.lit(last), 2)))
    dealt = docs.withColumn("_at", place(F.coalesce("doc_id", F.lit(-(1 << 63))))).select("doc_id", "text", F.explode(F.array_compact(spots)).alias("_s")).select("doc_id", "text", "_s.part", "_s.extra")
    dealt = dealt.withColumn("deal", F.get(keys, F.col("part"))).repartition(last + 1, "deal").drop("deal").sortWithinPartitions("part", "extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, state, rows = None, None, {}, []
        for doc, text, part, extra in (row for batch in batches for piece in text_slices(batch) for row in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "part", "extra")))):
            if part == done:
                continue
            row = (part, doc, text)
            if held is not None and held[0] == part:
                rows.append(step(held[1], held[2], row[2], state))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows)
                    rows = []
            held = row
            if extra:
                done, held = part, None
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    return dealt.mapInArrow(run, out)


def fingerprints(df: DataFrame) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures) of every row.

    A null text counts as empty; a single row is its own next one. A repeated row is a row
    of its own: the first of two equal rows has the second as its next one.
    """

    def step(doc, text, following, state) -> dict:
        own = state["set"] if state.get("text") is text and text is not None else signature_set(text)
        changed = edited(text, following)
        other, after = signature_set(changed), signature_set(following)
        state |= {"text": following, "set": after}  # the next row's own set
        return {"doc_id": doc, "n_chars": len(text or ""), "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": fingerprint(own), "edited_fingerprint": fingerprint(other), "near_edited": likeness(own, other), "near_next": likeness(own, after), "n_signatures": len(own)}

    return with_next(df, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long", step)


def size_partition(n: int, threshold: float = NEAR) -> int:
    """Partition of a set's size: sizes of one partition and the next are all that ``threshold`` can join."""
    bound, k = 1, 0
    while bound < n:
        bound, k = int(bound / threshold) + 1, k + 1
    return k


def near_pairs(df: DataFrame, threshold: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): rows (doc_id, class_id), and pairs (a, b, likeness) of classes with at least ``threshold``.

    A class is all documents of one signature set, named by its smallest id; null ids
    are left out. Candidates share one of the rarest signatures that a set cannot do
    without (its prefix by document frequency) and a size partition or two neighbours.
    """

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = [signature_set(t) for t in part.column("text").to_pylist()]
            lists = [sorted(x - (1 << 64) if x >> 63 else x for x in s) for s in sets]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([fingerprint(s) for s in sets]), pa.array(lists, pa.list_(pa.int64())), pa.array([size_partition(len(x), threshold) for x in sets], pa.int32())], ["doc_id", "fp", "sigs", "part"])

        return work

    base = cut(map_text(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL"), "doc_id long, fp string, sigs array<long>, part int", make), "spots")
    members = base.select("doc_id", "fp").join(base.groupBy("fp").agg(F.min("doc_id").alias("class_id")), "fp")
    classes = cut(base.join(members.filter("doc_id = class_id").select("doc_id", "fp").distinct(), ["doc_id", "fp"]).dropDuplicates(["fp"]), "spots")
    each = classes.select(F.col("doc_id").alias("id"), F.size("sigs").alias("n"), "part", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    order = W.partitionBy("id").orderBy("df", "sig")
    needed = each.join(often, "sig").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    needed = cut(needed.filter("df > 1").select("id", "n", "part", "sig"), "spots")
    a, b = needed.alias("a"), needed.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") - 1))).alias("b")
    fits = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.part")) & fits & (F.col("a.n") >= F.lit(threshold) * F.col("b.n") - 1e-9)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()

    def compare(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = [likeness(frozenset(r["x"]), frozenset(r["y"]), threshold) for r in rows]
            good = [i for i, v in enumerate(found) if v >= threshold - 1e-12]
            yield pa.RecordBatch.from_arrays([pa.array([min(rows[i]["a"], rows[i]["b"]) for i in good], pa.int64()), pa.array([max(rows[i]["a"], rows[i]["b"]) for i in good], pa.int64()), pa.array([found[i] for i in good], pa.float64())], ["a", "b", "likeness"])

    sets = classes.select(F.col("doc_id").alias("id"), "sigs")
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("y")), "b")
    return members.select("doc_id", "class_id"), rows.mapInArrow(compare, "a long, b long, likeness double")
