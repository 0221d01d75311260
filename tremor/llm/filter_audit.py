"""How quality filters interact: what each removes in every order of application.

Duplicates come from one sort: rows are dealt to ranges by (SHA-256 of the text, id),
sorted within them by (SHA-256, text, id) and compared with their predecessors. A range may
begin inside a group of equal texts; only the group's first rows there are in doubt, and
they are settled by the last row of the nonempty range before. Failures of a row are a mask; masks
are counted by part, and every figure is a sum of these counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SLICE_CHARS, blanks, bytes_of, counts_in, cut, handing_back, pieces, runs, text_slices

#: The filters in the order of their bits: few words, few distinct words, capitals, symbols, duplicates.
FILTERS = "ABCDE"
#: Fewer words fail; so does a smaller percentage of distinct words, and a larger one of capitals; so does any symbol.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Bytes of text in a range of the sort.
RANGE_BYTES = 32 << 20


def text_failures(texts: pa.Array) -> np.ndarray:
    """Mask of filters A to D (bits 0 to 3) that each text fails; null texts are empty."""
    data, offsets = bytes_of(texts)
    starts, ends = runs(~blanks(data), offsets)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    code = pieces(data, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64)
    seen = np.unique(np.repeat(np.arange(len(words)), words) << 32 | code) >> 32
    distinct = np.bincount(seen, minlength=len(words))
    points = np.diff(offsets) - counts_in(np.flatnonzero((data & 0xC0) == 0x80), offsets)
    capitals = counts_in(np.flatnonzero((data >= 65) & (data <= 90)), offsets)
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    marked = counts_in(np.flatnonzero(symbols[data]), offsets)
    tests = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, marked > 0)
    return sum(t.astype(np.int64) << k for k, t in enumerate(tests))


_NONE = np.iinfo(np.int64).max  # no id


class _Sorted:
    """Compares the rows of one sorted range, slice by slice, with their predecessors."""

    def __init__(self) -> None:
        self.print: bytes | None = None  # of the last row
        self.text: bytes | None = None
        self.least = _NONE  # smallest id of the last row's group within the range
        self.whole = True  # that group is the range's first

    def repeats(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have a smaller id with the same text before them, and which may have one in an earlier range."""
        prints, texts = part.column("print").cast(pa.large_binary()), part.column("text").cast(pa.large_binary())
        ids = pc.fill_null(part.column("doc_id"), _NONE).to_numpy()
        n = len(ids)
        same = np.zeros(n, bool)
        same[1:] = pc.equal(prints.slice(1), prints.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(same)
        if len(at):
            same[at] = pc.equal(texts.take(pa.array(at)), texts.take(pa.array(at - 1))).to_numpy(zero_copy_only=False)
        fresh = self.print is None
        same[0] = not fresh and prints[0].as_py() == self.print and texts[0].as_py() == self.text
        group = np.cumsum(~same) - int(not same[0])
        heads = np.flatnonzero(~same)
        least = np.minimum.reduceat(ids, np.concatenate(([0], heads[heads > 0])))
        if same[0]:
            least[0] = min(least[0], self.least)
        first = (group == 0) & (fresh or (bool(same[0]) and self.whole))
        known = ids != _NONE
        fails = known & (ids > least[group])
        self.whole = (fresh or (bool(same[0]) and self.whole)) and group[-1] == 0
        self.print, self.text, self.least = prints[n - 1].as_py(), texts[n - 1].as_py(), int(least[-1])
        return fails, first & known & ~fails


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from judged(TaskContext.get().partitionId(), batches)


def judged(range_: int, batches: Iterator[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Masks of the sorted rows (doc_id, part, text, print) of a range, and one row that tells of its last."""
    state, length = _Sorted(), 0
    names = ["range", "part", "doc_id", "mask", "print", "length", "ided"]

    for batch in batches:
        for part in text_slices(batch, limit=limit):
            fails, doubt = state.repeats(part)
            mask = text_failures(part.column("text")) | fails.astype(np.int64) << 4
            n, lengths = part.num_rows, pc.binary_length(part.column("text")).cast(pa.int64())
            length = lengths[n - 1].as_py()
            told = pa.array(np.arange(n), mask=~doubt)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, range_), pa.int32()), part.column("part"), part.column("doc_id"), pa.array(mask, pa.int32()), part.column("print").take(told), lengths.take(told), pa.nulls(n, pa.bool_())], names)
    if state.print is not None:  # the range's last row, for the range after it
        yield pa.RecordBatch.from_arrays([pa.array([range_], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([state.print], pa.binary()), pa.array([length], pa.int64()), pa.array([state.least != _NONE])], names)


def failure_masks(docs: DataFrame) -> DataFrame:
    """``part`` (the source), ``doc_id`` and ``mask`` of each row of ``docs`` (doc_id, text, source).

    Bits 0 to 4 are filters A to E. Null texts and sources are empty. A row fails E if a smaller id anywhere has the same text: repeats of a
    row with the smallest id pass, and rows with a null id neither fail nor make others fail.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // RANGE_BYTES)
    rows = rows.withColumn("print", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    placed = rows.repartitionByRange(ranges, "print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    schema = "range int, part string, doc_id long, mask int, print binary, length long, ided boolean"
    judged = cut(placed.mapInArrow(handing_back(_judged), schema), "judged")
    # One row a range; the last one that is not empty before each.
    ends = judged.filter("ided IS NOT NULL").select(F.lead("range").over(W.orderBy("range")).alias("range"), "print", "length", "ided").filter("range IS NOT NULL")
    doubt = judged.filter("ided IS NULL AND print IS NOT NULL").join(ends.select("range", "print", "length", F.col("ided").alias("before")), ["range", "print", "length"], "left")
    settled = judged.filter("ided IS NULL AND print IS NULL").select("part", "doc_id", "mask")
    return settled.union(doubt.select("part", "doc_id", F.when(F.coalesce("before", F.lit(False)), F.col("mask").bitwiseOR(1 << 4)).otherwise(F.col("mask")).alias("mask")))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``n``, ``good`` and ``toxic`` rows by part and mask; these add up over any split of the rows.

    A row is good (toxic) if a label of its id has quality (toxic) 1.
    """
    one = [F.max((F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1).cast("long")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*one)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums)


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of ``filters`` and step, from ``mask_counts``.

    ``kept`` pass all filters so far; ``removed`` fail this one first; ``redundant`` fail it, but were removed before;
    ``unique_fails`` fail it alone; ``shapley`` is what it removes summed over all orders.
    """
    orders = ["".join(o) for o in itertools.permutations(filters)]
    bit = f"(1L << (instr('{filters}', letter) - 1))"
    cells = counts.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("long").alias("mask"), "n", "good", "toxic")).alias("cells"))  # a mask each
    steps = cells.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders])))
    steps = steps.select("part", "cells", "filter_order", F.posexplode(F.split("filter_order", "(?<=.)(?=.)")).alias("place", "letter"))
    before = f"aggregate(split(substring(filter_order, 1, place), ''), 0L, (a, letter) -> a | IF(letter = '', 0L, {bit}))"
    steps = steps.withColumns({"own": F.expr(bit), "earlier": F.expr(before)})

    def total(condition: str, what: str = "c.n") -> str:
        return f"aggregate(cells, 0L, (a, c) -> a + IF({condition}, {what}, 0L))"

    removed = "c.mask & own <> 0 AND c.mask & earlier = 0"
    share = len(orders)  # of the orders, one in as many as the filters that a row fails has this filter first of them
    figures = {
        "kept": total("c.mask & (own | earlier) = 0"),
        "removed": total(removed),
        "redundant": total("c.mask & own <> 0 AND c.mask & earlier <> 0"),
        "unique_fails": total("c.mask = own"),
        "good_lost": total(removed, "c.good"),
        "toxic_lost": total(removed, "c.toxic"),
        "shapley": total("c.mask & own <> 0", f"c.n * ({share} div bit_count(c.mask))"),
    }
    return steps.select("part", "filter_order", (F.col("place") + 1).cast("int").alias("step"), *[F.expr(e).cast("long").alias(k) for k, e in figures.items()])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the five filters over ``docs``; none for an empty table."""
    return interactions(mask_counts(failure_masks(docs), labels))
