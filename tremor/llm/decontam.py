"""Benchmark decontamination: rare n-gram seeds join passages to items, then Smith-Waterman alignment.

Seeds are runs of ``SEED`` words of an item that are rare in the corpus: over all documents,
they have few different neighbours (the word before and the one after, as a pair), or one
pair has at least half of their occurrences. So a passage that has leaked into many
documents does not become common by that, while a common phrase has many neighbours. An
item without a rare run keeps all of its runs.

Runs of documents are joined with runs of items by their hashes, by a shuffle join whose
work does not depend on how many items there are. A filter of bounded size, made of the items'
runs, keeps documents' other runs from being shuffled; documents are read for it once. Texts are
known by a hash of theirs, so equal ones are aligned once. Where a document has seeds of an item's segment, the passage around them is
aligned with the segment, so edited copies are found as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, flat_text, fresh, handing_back, hash_filter, map_text, passing, released, text_slices, values_of, words_of
from .neardup import mixed

#: Words of a seed, and the most neighbours (distinct pairs of the words around it) of a rare one.
SEED, NEIGHBOURS = 4, 12
#: Alignment: a match, a mismatch, a word left out or put in.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A copy has this share of the item's words, or so many of them, and this share of matches in the aligned run.
COVERAGE, MATCHED, IDENTITY = 0.5, 30, 0.6
#: Items are aligned in segments of so many words, which overlap by a seed less a word.
SEGMENT = 256
#: Bits of the filter of the items' runs: 4 MB, whatever the items. With more runs it lets more pass, and the join decides.
FILTER_BITS = 1 << 25
#: So many hashes of texts at most (a number each) are broadcast to find the texts; with more, texts are shuffled by hash.
HELD_HASHES = 1_000_000

_BY_PLACE = np.random.default_rng(971).integers(0, 1 << 63, SEED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOKEN = re.compile("[^ \t-\r]+")
_NO_WORD = np.uint64(0)


def core(chunk: str) -> str:
    """A word as it is compared: its letters and digits in lower case."""
    return "".join(c for c in chunk.lower() if c.isalnum())


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and each text's first one (one more entry for the end).

    Words are chunks between blanks and the controls 9 to 13; chunks without a letter or digit are left out.
    """
    index, seen, first = words_of(pc.replace_substring_regex(flat_text(texts), "[\t-\r]", " "))
    if not len(index):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    cores = [core(c) for c in values_of(seen)]
    own = np.fromiter((xxhash.xxh3_64_intdigest(c) | 1 if c else 0 for c in cores), np.uint64, len(cores))[index]
    filled = own != _NO_WORD
    return own[filled], np.concatenate(([0], np.cumsum(filled)))[first]


def runs(words: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` words from each place on."""
    n = len(words) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mixed(sum((words[k : n + k] * _BY_PLACE[k] for k in range(SEED)), np.uint64(0)))


def short_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the texts with fewer words than a seed: all of their words, which only an equal text shares."""
    size = np.diff(first)
    at = np.flatnonzero((size > 0) & (size < SEED))
    out = [mixed((words[first[i] : first[i + 1]] * _BY_PLACE[: size[i]]).sum(keepdims=True) + np.uint64(size[i])) for i in at.tolist()]
    return at, np.concatenate(out) if out else np.zeros(0, np.uint64)


def owners(first: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each place, whether a run from there lies within it)."""
    owner = np.searchsorted(first, places, side="right") - 1
    return owner, places + SEED <= first[owner + 1]


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int, int]:
    """(score, matches, columns, first, end) of the best local alignment; the last two are places in ``doc``.

    A row at a time; inserted words are a running maximum, so a row is a few vector steps.
    Of equal scores, the alignment that ends first in the item, then in the document.
    """
    m, n = len(item), len(doc)
    table = np.zeros((m + 1, n + 1), np.int32)
    ramp = np.arange(n + 1, dtype=np.int32) * GAP
    for i in range(1, m + 1):
        row = np.zeros(n + 1, np.int32)
        row[1:] = np.maximum(table[i - 1, :-1] + np.where(doc == item[i - 1], MATCH, MISMATCH), table[i - 1, 1:] + GAP)
        np.maximum(row, 0, out=row)
        table[i] = np.maximum.accumulate(row - ramp) + ramp
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, end, matches, columns = int(table[i, j]), int(j), 0, 0
    while table[i, j] > 0:
        same = item[i - 1] == doc[j - 1]
        columns += 1
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches, i, j = matches + int(same), i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matches, columns, int(j), end


@dataclass
class Items:
    """The items' tables, written: ``words`` (item, segment, first, n_words, words), ``runs`` (run, item, segment, place), and ``names`` (item, item_id)."""

    words: DataFrame
    runs: DataFrame
    names: DataFrame


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _segments(benchmark: DataFrame) -> DataFrame:
    """(item, segment, first, n_words, words) of the items (item, text); short items are one segment."""
    schema = "item long, segment int, first int, n_words int, words array<long>"

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
            words, first = numbered(part.column("text"))
            rows = []
            for item, a, b in zip(part.column("item").to_pylist(), first.tolist(), first[1:].tolist()):
                step = SEGMENT - SEED + 1
                for k, s in enumerate(range(0, max(1, b - a - SEED + 1), step) if b > a else ()):
                    rows.append((item, k, s, b - a, words[a + s : min(a + s + SEGMENT, b)].view(np.int64).tolist()))
            if not rows:
                return None
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])

        return work

    return map_text(benchmark, schema, make)


def _runs_of(segments: DataFrame) -> DataFrame:
    """(run, item, segment, place): runs of the segments; an item with fewer words than a seed is one run."""
    schema = "run long, item long, segment int, place int"

    def run(batches):
        for batch in batches:
            rows = []
            for item, segment, words in zip(*(batch.column(c).to_pylist() for c in ("item", "segment", "words"))):
                w = np.array(words, np.int64).view(np.uint64)
                found = runs(w) if len(w) >= SEED else short_runs(w, np.array([0, len(w)]))[1]
                rows += [(h, item, segment, place) for place, h in enumerate(found.view(np.int64).tolist())]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [c.split()[0] for c in schema.split(", ")])

    return segments.mapInArrow(handing_back(run), schema)


def benchmark_items(benchmark: DataFrame) -> Items:
    """The items (item_id, text), in segments, and their runs.

    Null and blank items have no words to be found by. An item with fewer words than a seed
    is found only in a text of the same words and no others. Repeated items are items of their own.
    """
    known = benchmark.select("item_id", "text").filter("text IS NOT NULL").withColumn("item", F.monotonically_increasing_id())
    known = cut(known, "items")
    words = cut(_segments(known.select("item", "text")), "segments")
    return Items(words, cut(_runs_of(words), "runs"), known.select("item", "item_id"))


def _occurrences(docs: DataFrame, filter_) -> DataFrame:
    """(text_hash, run, at, around) of the runs of ``docs`` (text_hash, text) that the filter lets pass; ``around`` is a hash of the neighbours."""
    schema = "text_hash string, run long, at int, around long"

    def make():
        held = filter_.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
            words, first = numbered(part.column("text"))
            found = runs(words)
            at = passing(held, found)
            owner, inside = owners(first, at) if len(at) else (at, np.zeros(0, bool))
            at, owner = at[inside], owner[inside]
            before = np.where(at > first[owner], words[at - 1], np.uint64(2))
            after = np.where(at + SEED < first[owner + 1], words[np.minimum(at + SEED, len(words) - 1)], np.uint64(4)) if len(at) else before
            short, whole = short_runs(words, first)
            kept = passing(held, whole)
            short, whole = short[kept], whole[kept]
            if not len(at) + len(short):
                return None
            none = np.zeros(len(short), np.uint64)
            cols = [np.concatenate(x) for x in ((owner, short), (found[at], whole), (at - first[owner], none), (mixed(before) + after, none))]
            return pa.RecordBatch.from_arrays([part.column("text_hash").take(pa.array(cols[0].astype(np.int64))), _signed(cols[1]), pa.array(cols[2].astype(np.int32)), _signed(cols[3])], ["text_hash", "run", "at", "around"])

        return work

    return map_text(docs, schema, make)


def rare_runs(occurrences: DataFrame, runs_: DataFrame) -> DataFrame:
    """(run, item, segment, place): the items' seeds; see the head of the module.

    Occurrences are summed by run and neighbours, then by run, with partial sums before each shuffle.
    """
    by_pair = occurrences.groupBy("run", "around").agg(F.count(F.lit(1)).alias("n"))
    by_run = by_pair.groupBy("run").agg(F.count(F.lit(1)).alias("near"), F.max("n").alias("most"), F.sum("n").alias("all"))
    known = runs_.join(by_run, "run").withColumn("rare", (F.col("near") <= NEIGHBOURS) | (2 * F.col("most") >= F.col("all")))
    some = known.groupBy("item").agg(F.max("rare").alias("some"))
    return known.join(some, "item").filter("rare OR NOT some").select("run", "item", "segment", "place")


def _aligned(rows: DataFrame) -> DataFrame:
    """(text_hash, item, segment, n_words, score, matches, columns, first, end, at) of the best alignment of each group of seeds.

    ``rows`` are (text_hash, text, seeds: list of (item, segment, first, n_words, words, starts)), a row for each text.
    """
    schema = "text_hash string, item long, segment int, n_words int, score long, matches long, columns long, first int, end int, at int"

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                words, first = numbered(part.column("text"))
                out = []
                for k, (key, found) in enumerate(zip(part.column("text_hash").to_pylist(), part.column("seeds").to_pylist())):
                    ids = words[first[k] : first[k + 1]]
                    for s in found:
                        item = np.array(s["words"], np.int64).view(np.uint64)
                        for lo, hi in _groups(sorted(s["starts"]), len(item)):
                            a, b = max(0, lo - len(item) // 4 - 2), min(len(ids), hi + len(item) + len(item) // 4 + 2)
                            score, matches, columns, x, y = align(item, ids[a:b])
                            out.append((key, s["item"], s["segment"], s["n_words"], score, matches, columns, x + a, y + a, s["first"]))
                if out:
                    types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(handing_back(run), schema)


def _groups(starts: list[int], size: int) -> list[tuple[int, int]]:
    """(least, most) of runs of places that can belong to one copy of a segment of ``size`` words."""
    out = [[starts[0], starts[0]]]
    for x in starts[1:]:
        if x - out[-1][1] <= size // 2 and x - out[-1][0] <= 2 * size:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [tuple(g) for g in out]


def _chained(parts: DataFrame) -> DataFrame:
    """(text_hash, item, score, matches, columns, first, end, n_words): the best copy of each item in each text.

    Alignments of an item's segments make one copy where they follow each other in the text as
    the segments do in the item; alignments of segments found in unrelated places are not added up.
    Places are within half a segment of where the copy's other segments put them. Overlapping words
    of neighbouring segments count once.
    """
    near = F.floor((F.col("first") - F.col("at")) / F.lit(SEGMENT))
    # Two cells, so that copies whose offset lies at a cell's edge still meet.
    spots = parts.withColumn("cell", F.explode(F.array(near, near + 1)))
    best = spots.withColumn("r", F.row_number().over(W.partitionBy("text_hash", "item", "cell", "segment").orderBy(F.desc("score"), "first"))).filter("r = 1")
    sums = best.groupBy("text_hash", "item", "cell").agg(F.sum("score").alias("score"), F.sum("matches").alias("matches"), F.sum("columns").alias("columns"), F.min("first").alias("first"), F.max("end").alias("end"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("k"))
    twice = (F.col("k") - 1) * (SEED - 1)
    sums = sums.withColumns({"matches": F.least(F.greatest(F.lit(0), F.col("matches") - twice), F.col("n_words").cast("long")), "columns": F.greatest(F.lit(1), F.col("columns") - twice)})
    copy = (F.col("matches") / F.col("columns") >= IDENTITY) & ((F.col("matches") >= COVERAGE * F.col("n_words")) | (F.col("matches") >= MATCHED))
    order = F.struct("score", -F.col("first"))
    return sums.filter(copy).groupBy("text_hash", "item").agg(F.max_by(F.struct("score", "matches", "columns", "first", "end", "n_words"), order).alias("c")).select("text_hash", "item", "c.*")


def _found(docs: DataFrame, items: Items) -> DataFrame:
    """(text_hash, item, score, matches, columns, first, end, n_words) of the copies in the distinct texts of ``docs`` (text_hash, text), written."""
    held = docs.sparkSession.sparkContext.broadcast(hash_filter(items.runs.select("run"), FILTER_BITS))
    seen = cut(_occurrences(docs, held), "occurrences")
    seeds = cut(rare_runs(seen, items.runs), "seeds")
    joined = seen.join(seeds, "run").select("text_hash", "item", "segment", (F.col("at") - F.col("place")).alias("start"))
    starts = joined.groupBy("text_hash", "item", "segment").agg(F.collect_set("start").alias("starts"))
    starts = starts.join(items.words, ["item", "segment"]).groupBy("text_hash").agg(F.collect_list(F.struct("item", "segment", "first", "n_words", "words", "starts")).alias("seeds"))
    starts = cut(starts, "starts")
    # Of a text, one row; the texts that have a seed are few, and come once each however many documents share them.
    texts = _among(docs, starts.select("text_hash")).groupBy("text_hash").agg(F.max("text").alias("text"))
    parts = cut(_aligned(texts.join(starts, "text_hash").select("text_hash", "text", "seeds")), "aligned")
    out = cut(_chained(parts), "copies")
    released(seen, seeds, starts, parts)
    return out


def _number(text_hash) -> Column:
    return F.conv(F.substring(text_hash, 1, 15), 16, 10).cast("long")


def _among(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of ``docs`` (with text_hash) whose hash is in ``hashes`` (text_hash).

    A broadcast of numbers, if they are few enough, leaves all other texts where they are; a join by the whole hash decides.
    """
    own = cut(hashes.select("text_hash").distinct(), "hashes")
    if own.count() <= HELD_HASHES:
        (name,) = fresh("number")
        numbers = F.broadcast(own.select(_number(F.col("text_hash")).alias(name)).distinct())
        docs = docs.join(numbers, _number(F.col("text_hash")) == F.col(name), "left_semi")
        return docs.join(own, "text_hash", "left_semi")
    return docs.join(own, "text_hash", "left_semi")


def _hashed(docs: DataFrame, *columns) -> DataFrame:
    """Rows with ``text_hash``; null texts have none and no copy."""
    return docs.select(*columns, "text", F.md5(F.col("text").cast("binary")).alias("text_hash")).filter("text IS NOT NULL")


def copies(docs: DataFrame, items: Items) -> DataFrame:
    """Rows (doc_id, item_id, score, matched, item_words, identity, begin, end) of copies of items in ``docs``.

    ``begin`` and ``end`` are character offsets of the copy; repeated rows are found again, null and empty texts have no copy.
    """
    schema = "doc_id long, item long, score long, matched long, item_words long, identity double, begin long, end long"
    rows = _hashed(docs, F.col("doc_id").cast("long").alias("doc_id"))
    found = _found(rows.select("text_hash", "text"), items)
    per_text = found.groupBy("text_hash").agg(F.collect_list(F.struct("item", "score", "matches", "columns", "first", "end", "n_words")).alias("found"))

    def run(batches):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        for batch in batches:
            for part in text_slices(batch):
                out = []
                for doc, text, found_ in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "found"))):
                    spots = [m.span() for m in _TOKEN.finditer(text) if core(m[0])]
                    for c in sorted(found_, key=lambda c: c["item"]):
                        out.append((doc, c["item"], c["score"], c["matches"], c["n_words"], c["matches"] / c["columns"], spots[c["first"]][0], spots[c["end"] - 1][1]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [f.split()[0] for f in schema.split(", ")])

    placed = _among(rows, found).join(per_text, "text_hash").select("doc_id", "text", "found").mapInArrow(handing_back(run), schema)
    return placed.join(items.names, "item").select("doc_id", F.col("item_id").cast("long").alias("item_id"), "score", "matched", "item_words", "identity", "begin", "end")


def drop_contaminated(docs: DataFrame, items: Items) -> DataFrame:
    """Rows of ``docs`` without a copy of an item, as they are: null texts, null ids and repeated rows stay."""
    own = fresh("hash")[0]
    found = _found(_hashed(docs).select("text_hash", "text"), items).select(F.col("text_hash").alias(own)).distinct()
    if found.count() <= HELD_HASHES:
        found = F.broadcast(found)
    return docs.join(found, F.md5(F.col("text").cast("binary")) == F.col(own), "left_anti")
