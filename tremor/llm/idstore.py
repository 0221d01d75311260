"""Token-id files: each document compressed alone against one trained zstandard dictionary.

A store is a folder of three Parquet tables, written and read by Spark alone, so any
file system that Spark reaches will do:

* ``dictionary``: one row with the dictionary and its SHA-256;
* ``blocks``: frames of consecutive documents one after the other (``body``), the
  dictionary's hash, and the block's index: ids, frame offsets and token counts;
  ``part`` and ``block`` order them by ascending ``doc_id`` (nulls first), and
  ``part_start`` counts the part's ids before the block; ``first_id`` and ``last_id`` let
  a reader skip files and row groups;
* nothing else: a document is read from its block's row by offset.

A part is a range of ids with about ``RANGE_BYTES`` of text, and a task of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_sample, cut, even_keys, map_text, released, within_bytes
from .wordbpe import word_bpe

#: The dictionary is fitted on at most about so many documents, and has at most so many bytes.
TRAIN_DOCS, DICTIONARY_BYTES = 2000, 64 << 10
#: The sample's texts have at most about so many bytes; a document that would go beyond is not in the sample.
TRAIN_BYTES = 8 << 20
#: Frames of about so many bytes share a block.
BLOCK_BYTES = 256 << 10
#: Texts of about so many bytes are a part.
RANGE_BYTES = 48 << 20
BLOCKS = "part int, block int, part_start long, first_id long, last_id long, dictionary_sha256 string, doc_ids array<long>, offsets array<long>, tokens array<long>, body binary"


def _encoded(path: str, end_id: int):
    """make() for ``map_text``: a slice's rows as (doc_id, bytes of the ids with the end id)."""

    def start():
        bpe, end = word_bpe(path), np.array([end_id], "<u4").tobytes()

        def rows(part: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
            ids, first = bpe.encode(part.column("text"))
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            for doc, a, b in zip(part.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist()):
                yield doc, bytes(raw[4 * a : 4 * b]) + end

        return rows

    return start


def train_dictionary(df: DataFrame, path: str, end_id: int = 2, docs: int = TRAIN_DOCS, total: int | None = None) -> bytes:
    """A zstandard dictionary of serialized ids of a bounded sample; empty where there is too little to learn from.

    ``total`` is the number of texts, where it is known.
    """
    docs_in = df.select(F.col("doc_id").cast("long"), "text").filter(F.col("text").isNotNull())

    def make():
        rows = _encoded(path, end_id)()
        return lambda part: pa.RecordBatch.from_arrays([pa.array([b for _, b in rows(part)], pa.binary())], ["ids"])

    drawn = cut(bounded_sample(docs_in, "doc_id", docs, docs_in.count() if total is None else total), "sample")
    sample = within_bytes(drawn, "doc_id", TRAIN_BYTES)
    got = sorted(r[0] for r in map_text(sample.select("doc_id", "text"), "ids binary", make).collect())  # about ``docs`` rows and ``TRAIN_BYTES`` at most
    released(drawn)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(b) for b in got]).as_bytes() if len(got) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def write_store(df: DataFrame, folder: str, path: str, end_id: int = 2) -> None:
    """Write the ids of every document of ``df`` (null text: none but the end id) to ``folder``.

    Null ids come first; rows with one id follow each other in the order of their frames. An
    empty table writes a store without blocks.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long"), "text")
    size, total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("text")).head()
    dictionary = train_dictionary(docs, path, end_id, total=total)
    sha = hashlib.sha256(dictionary).hexdigest()
    held = spark.sparkContext.broadcast(dictionary)
    spark.createDataFrame([(sha, bytearray(dictionary))], "dictionary_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    parts = max(1, -(-size // RANGE_BYTES))
    cuts = [i / parts for i in range(1, parts)]
    bounds = np.array(sorted(set((docs.agg(F.percentile_approx("doc_id", cuts, 100 * parts)).head()[0] if cuts else None) or [])), np.int64)
    ranges = len(bounds) + 2  # one for null ids
    keys = np.array(even_keys(spark, ranges), np.int64)

    def make():
        rows = _encoded(path, end_id)()
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held.value) if held.value else None)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            docs_, n, frames = [], [], []
            for doc, raw in rows(part):
                docs_.append(doc)
                n.append(len(raw) // 4)
                frames.append(packer.compress(raw))
            at = [-1 if d is None else int(np.searchsorted(bounds, d, side="right")) for d in docs_]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys[np.array(at, np.int64) + 1]), pa.array(docs_, pa.int64()), pa.array(n, pa.int64()), pa.array(frames, pa.binary())], ["part", "deal", "doc_id", "n", "frame"])

        return work

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, start, ids, sizes, tokens, body = None, 0, 0, [], [], [], []

        def full() -> pa.RecordBatch:
            offsets = [0]
            for s in sizes[:-1]:
                offsets.append(offsets[-1] + s)
            row = {"part": now, "block": block, "part_start": start, "first_id": ids[0], "last_id": ids[-1], "dictionary_sha256": sha, "doc_ids": ids, "offsets": offsets, "tokens": tokens, "body": b"".join(body)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dictionary_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("body", pa.binary())]))

        size = 0
        for batch in batches:
            for part, doc, n, frame in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame"))):
                if ids and (part != now or size >= BLOCK_BYTES):
                    yield full()
                    block, start = (block + 1, start + sum(tokens)) if part == now else (0, 0)
                    ids, sizes, tokens, body, size = [], [], [], [], 0
                now = part
                ids.append(doc)
                sizes.append(len(frame))
                tokens.append(n)
                body.append(frame)
                size += len(frame)
        if ids:
            yield full()

    frames = map_text(docs, "part int, deal long, doc_id long, n long, frame binary", make)
    dealt = frames.repartition(ranges, "deal").drop("deal").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "frame")
    dealt.mapInArrow(blocks, BLOCKS).write.option("parquet.block.size", 16 << 20).option("compression", "none").parquet(f"{folder}/blocks")


def _opener(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    sha, raw = spark.read.parquet(f"{folder}/dictionary").head()
    if hashlib.sha256(raw).hexdigest() != sha:
        raise ValueError("the dictionary does not match its hash")
    return sha, bytes(raw)


def read_store(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids as little-endian bytes) of every document of a store.

    Without ``ids`` every frame is read and decoded as well, but its ids stay in the worker.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids]
    sha, raw = _dictionary(spark, folder)
    held = spark.sparkContext.broadcast(raw)
    table = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    ends = table.groupBy("part").agg(F.max(F.col("part_start") + F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row a part; a part has tens of megabytes.
    before = ends.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    ordered = table.join(F.broadcast(before), "part").select("dictionary_sha256", (F.col("before") + F.col("part_start")).alias("start"), "doc_ids", "offsets", "tokens", "body")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = _opener(held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("dictionary_sha256")[0].as_py() != sha:
                    raise ValueError("a block was written with another dictionary")
                body, start = row.column("body")[0].as_buffer(), row.column("start")[0].as_py()
                docs, offsets, tokens = (row.column(c)[0].as_py() for c in ("doc_ids", "offsets", "tokens"))
                view, starts, raw = memoryview(body), [], []
                for a, b, n in zip(offsets, [*offsets[1:], len(view)], tokens):
                    raw.append(opener.decompress(view[a:b]))
                    if len(raw[-1]) != 4 * n:
                        raise ValueError("a frame does not match the index")
                    starts.append(start)
                    start += n
                numbers = [pa.array(c, pa.int64()) for c in (docs, starts, tokens, [zlib.crc32(x) for x in raw])]
                yield pa.RecordBatch.from_arrays([*numbers, *([pa.array(raw, pa.binary())] if ids else [])], names)

    return ordered.mapInArrow(decode, schema)


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[int] | None:
    """The ids of one document through the index; None if the store has no such document.

    Of several documents with the id, the first in the store's order. Files and row groups
    whose ids end before or start after it are skipped.
    """
    near = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").filter((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
    row = near.filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).orderBy("part", "block").head()
    if row is None:
        return None
    i, ends = row.doc_ids.index(doc_id), [*row.offsets[1:], len(row.body)]
    return np.frombuffer(_opener(_dictionary(spark, folder)[1]).decompress(bytes(row.body[row.offsets[i] : ends[i]])), "<u4").tolist()
