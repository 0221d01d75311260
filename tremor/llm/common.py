"""Shared pieces of the text operators: work folders, row hashing, Arrow slicing."""

from __future__ import annotations

import ctypes
import pickle
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import released, stage_folder  # noqa: F401  released is for the operators

#: Characters of text handled at a time by the Arrow operators; bounds a worker's memory.
SLICE_CHARS = 1 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder of ``spark.checkpoint.dir`` (see ``stage_folder``)."""
    return f"{stage_folder(spark)}/step-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors.

    ``released`` removes the table once nothing reads it any more.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fresh(*stems: str) -> list[str]:
    """Column names that no input has."""
    tag = uuid.uuid4().hex[:12]
    return [f"_{s}_{tag}" for s in stems]


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` keys that ``repartition(n, key)`` deals to partitions 0 to ``n`` - 1 in turn, so that no two share one."""
    found: dict[int, int] = {}
    span, start = 16 * n + 64, 0
    while len(found) < n:
        part = F.pmod(F.hash(F.col("id")), F.lit(n))
        rows = spark.range(start, start + span).groupBy(part.alias("part")).agg(F.min("id").alias("key")).collect()  # ``n`` rows at most
        for r in rows:
            found.setdefault(r.part, r.key)
        start += span
    return [found[i] for i in range(n)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` of the ``total`` rows of ``df`` at most, chosen by a hash of ``key``."""
    if total <= rows:
        return df
    share = int(rows / total * (1 << 40))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 40)) < share)


def within_bytes(sample: DataFrame, key: str, most: int, column: str = "text") -> DataFrame:
    """Rows of a bounded ``sample`` whose texts, in the order of a hash of ``key``, have at most ``most`` bytes together; whole texts only."""
    spark = sample.sparkSession
    rows = sample.select(key, F.octet_length(column).alias("n"), F.xxhash64(F.col(key), F.lit("bytes")).alias("h")).collect()  # the sample's rows, not its texts
    kept, so_far = [], 0
    for r in sorted(rows, key=lambda r: (r.h, r.n or 0)):
        if so_far + (r.n or 0) <= most:
            so_far += r.n or 0
            kept.append((r[0],))
    if len(kept) == len(rows):
        return sample
    ids = spark.createDataFrame(sorted(set(kept)), f"{key} {dict(sample.dtypes)[key]}")
    return sample.join(F.broadcast(ids), key, "left_semi")


def fitted_in_task(sample: DataFrame, fit: Callable[[list[tuple]], object]) -> object:
    """What ``fit`` makes of the distinct rows, in order, of a bounded ``sample``; it runs in one task, so its memory is no driver's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: set[tuple] = set()
        for batch in batches:
            rows.update(zip(*[c.to_pylist() for c in batch.columns]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sorted(rows)))], pa.binary())], ["model"])

    return pickle.loads(sample.coalesce(1).mapInArrow(handing_back(run), "model binary").head().model)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add (names compare as Spark does, caselessly)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` of about ``limit`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start, n = np.cumsum(sizes, dtype=np.int64), 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def hand_back() -> None:
    """Return a worker's freed memory to the system; its allocators keep it otherwise, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker hands its freed memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return whole


def map_text(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], column: str = "text", limit: int = SLICE_CHARS) -> DataFrame:
    """``mapInArrow`` over slices of bounded size; ``make`` runs once a task and returns the slice's function.

    A worker hands its freed memory back at the end of each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in text_slices(batch, column, limit):
                if (out := work(part)) is not None:
                    yield out

    return df.mapInArrow(handing_back(run), schema)


def flat_text(texts: pa.Array) -> pa.Array:
    """``texts`` with null as empty, in buffers of their own: some string kernels mistake the offsets of a slice."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    return filled.take(pa.array(np.arange(len(filled))))


def values_of(texts: pa.Array) -> list[str] | list[bytes]:
    """``to_pylist`` of strings or bytes without an Arrow scalar for each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all ``texts`` (null: empty), and each text's first with one more entry for the end."""
    flat = flat_text(texts)
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
    held = flat.buffers()[2]
    return np.frombuffer(held, np.uint8)[: offsets[-1]] if held is not None else np.zeros(0, np.uint8), offsets


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes; a text's end ends a run."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(inside))])
    inner = inner[inside[inner] & inside[inner - 1]]
    if len(inner):
        starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return starts, ends


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes from each start to its end; the ranges ascend and do not overlap."""
    if not len(starts):
        return pa.array([], pa.large_binary())
    bounds = np.stack((starts, ends), axis=1).ravel().astype(np.int64)
    all_ = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return all_.take(pa.array(np.arange(0, len(bounds) - 1, 2)))


def blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes are blanks or controls 9 to 13, which words stand between."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def counts_in(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the ascending ``places`` lie in each text."""
    return np.diff(np.searchsorted(places, offsets))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Chunks between blanks and line ends, empty ones left out.

    Returns, for each chunk, its index into the distinct chunks; these; and each
    text's first chunk with one more entry for the end. Null texts have none.
    """
    flat = pc.replace_substring(flat_text(texts), "\n", " ")
    lists = pc.split_pattern(flat, " ")
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    codes = lists.flatten().dictionary_encode()
    index, seen = codes.indices.to_numpy(), codes.dictionary
    filled = pc.not_equal(pc.binary_length(seen), 0).to_numpy(zero_copy_only=False)[index] if len(index) else np.zeros(0, bool)
    kept = np.concatenate(([0], np.cumsum(filled)))
    return index[filled], seen, kept[starts]


#: Bits of a filter of hashes, and bytes of one of its blocks.
FILTER_BITS, FILTER_BLOCK = 1 << 27, 1 << 16


def hash_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the low bits of a column of 64-bit hashes: ``bits`` / 8 bytes, however many hashes there are.

    Each partition makes blocks of its own, which are put together by block. With more
    hashes the bitmap lets more others pass, so an exact join has to follow.
    """
    name, block = hashes.columns[0], min(FILTER_BLOCK, bits // 8)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.unique(batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1))
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        parts = held.reshape(-1, block)
        for i in np.flatnonzero(parts.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1)], pa.binary())], ["block", "bytes"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(block, np.uint8)
        for raw in frame["bytes"]:
            out |= np.frombuffer(zlib.decompress(raw), np.uint8)
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "bytes": [zlib.compress(out.tobytes(), 1)]})

    made = hashes.select(name).filter(F.col(name).isNotNull()).mapInArrow(partial, "block int, bytes binary").groupBy("block").applyInPandas(whole, "block int, bytes binary")
    out = np.zeros((bits // 8 // block, block), np.uint8)
    for r in made.collect():  # ``bits`` / 8 bytes in all
        out[r.block] = np.frombuffer(zlib.decompress(r.bytes), np.uint8)
    return out.ravel()


def passing(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the (unsigned) hashes that the bitmap lets pass."""
    at = hashes & np.uint64(len(filter_) * 8 - 1)
    return np.flatnonzero(filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
