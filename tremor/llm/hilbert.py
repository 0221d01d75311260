"""Sharding along a Hilbert curve, with DataFrame functions alone.

Metadata dimensions are quantised to ``bits`` bits each; rows are sorted by the index
of their cell on the curve, which keeps neighbouring cells in neighbouring rows, and
the order is cut into runs of equal row counts. A run's files then span a small box
of the dimensions, so readers skip files by each of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh

#: Bits of each dimension.
BITS = 5


def by_hash(column: str, bits: int = BITS) -> Column:
    """A label's cell: 32 bits of its md5, modulo the cells; null is cell 0."""
    digest = F.md5(F.col(column).cast("string").cast("binary"))
    return F.coalesce(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(1 << bits), F.lit(0)).cast("int")


def by_log(value: Column, bits: int = BITS) -> Column:
    """A positive size's cell: two cells for each power of two, by whole numbers alone; null is 0."""
    most = 1 << ((1 << bits) // 2)
    v = F.least(F.greatest(value.cast("long"), F.lit(1)), F.lit(min(most, 1 << 31)).cast("long"))
    k = F.length(F.bin(v)) - 1
    half = F.when(v * v >= F.pow(F.lit(2.0), 2 * k + 1), 1).otherwise(0)
    return F.coalesce(F.least(F.lit((1 << bits) - 1), 2 * k + half), F.lit(0)).cast("int")


def curve_index(df: DataFrame, dims: list[Column], out: str, bits: int = BITS) -> DataFrame:
    """``df`` with the Hilbert index of the cell with these coordinates, each in [0, 2^bits).

    From coordinates to the curve's transposed form one bit plane at a time, highest
    first; then the Gray code; then the planes are interleaved.
    """
    n, last = len(dims), len(dims) - 1
    q = f"shiftleft(1, cast({bits - 1} - s div {n} as int))"
    own = f"element_at(x, s % {n} + 1)"
    turned = f"""aggregate(sequence(0, {n * (bits - 1) - 1}), _x, (x, s) -> transform(x, (v, j) -> CASE
        WHEN {own} & {q} != 0 THEN CASE WHEN j = 0 THEN v ^ ({q} - 1) ELSE v END
        WHEN j = 0 OR j = s % {n} THEN v ^ ((element_at(x, 1) ^ {own}) & ({q} - 1)) ELSE v END))"""
    gray = "transform(_x, (v, j) -> aggregate(slice(_x, 1, j + 1), 0, (a, e) -> a ^ e))"
    flips = f"aggregate(sequence(1, {bits - 1}), 0, (t, s) -> CASE WHEN _x[{last}] & shiftleft(1, s) != 0 THEN t ^ (shiftleft(1, s) - 1) ELSE t END)"
    index = f"aggregate(sequence(0, {n * bits - 1}), 0L, (o, s) -> o * 2 + (shiftright(_x[s % {n}] ^ _t, cast({bits - 1} - s div {n} as int)) & 1))"
    x, t = fresh("x", "t")
    own_names = lambda sql: F.expr(re.sub(r"\b_x\b", x, re.sub(r"\b_t\b", t, sql)))
    df = df.withColumn(x, F.array(*dims))
    df = df.withColumn(x, own_names(turned)) if bits > 1 else df
    df = df.withColumn(x, own_names(gray))
    df = df.withColumn(t, own_names(flips) if bits > 1 else F.lit(0))
    return df.withColumn(out, own_names(index)).drop(x, t)


def shards(rows: DataFrame, order: list[str], n: int, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with ``shard`` (0 to n-1) and ``slot`` (gapless from 0) by runs of equal counts in this order.

    One shuffle by ranges of ``order`` (ranges split hot cells as long as the order
    tells their rows apart) and a count for each range; no row passes the driver. Rows are kept as
    they are, equal ones and null ids too.
    """
    at, part, row, count, before, whole, i = fresh("at", "part", "row", "n", "before", "all", "i")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    placed = cut(placed, "curve").withColumns({part: F.shiftright(at, 33), row: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias(count))  # a row for each range, ``parts`` at most
    starts = counts.select(part, (F.sum(count).over(W.orderBy(part)) - F.col(count)).alias(before), F.sum(count).over(W.partitionBy()).alias(whole))
    placed = placed.join(F.broadcast(starts), part).withColumn(i, F.col(before) + F.col(row))
    of = F.expr(f"{i} * {n} div {whole}")
    return placed.withColumn(shard, of.cast("int")).withColumn(slot, F.expr(f"{i} - ({shard} * {whole} + {n - 1}) div {n}")).drop(at, part, row, count, before, whole, i)


def _measured(df: DataFrame, bits: int, size: str, crc: str, curve: str) -> DataFrame:
    """``df`` with its texts' sizes and checksums, and the curve's index by language, source and size."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.withColumns({size: (F.octet_length(text) + 1).cast("long"), crc: F.crc32(text.cast("binary"))})
    return curve_index(rows, [by_hash("lang", bits), by_hash("source", bits), by_log(F.col(size), bits)], curve, bits)


def shard_documents(df: DataFrame, n: int = 8, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, curve, shard, slot) of every document, by language, source and size.

    Equal texts of one cell follow each other. Null texts have size 1; repeated rows
    have slots of their own; null ids sort first.
    """
    size, crc, curve = fresh("size", "crc", "curve")
    rows = _measured(df.select("doc_id", "text", "lang", "source"), bits, size, crc, curve)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(size).alias("size"), F.col(crc).alias("text_crc32"), F.col(curve).alias("curve"))
    return shards(rows, ["curve", "size", "text_crc32", "doc_id"], n)


def write_shards(df: DataFrame, folder: str, n: int = 8, bits: int = BITS) -> str:
    """Write every row of ``df`` as it is, in curve order, as Parquet with a folder for each shard; returns the folders' column.

    That is ``shard``, or ``shard_1``, ``shard_2``, ... where ``df`` has the name itself (in any case).
    Null ids, null texts and repeated rows are rows like others; an empty table writes no row.
    """
    taken, k = {c.lower() for c in df.columns}, 0
    while (name := f"shard_{k}" if k else "shard") in taken:
        k += 1
    size, crc, curve, slot = fresh("size", "crc", "curve", "slot")
    placed = shards(_measured(df, bits, size, crc, curve), [curve, size, crc, "doc_id"], n, name, slot)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = placed.repartitionByRange(parts, name, slot).sortWithinPartitions(name, slot)
    ordered.select(*[F.col(f"`{c}`") for c in df.columns], name).write.partitionBy(name).parquet(folder)
    return name


def curve_sql(dims: list[str], bits: int = BITS) -> str:
    """DuckDB SQL of the same index of three cells: a chain of tables that ends in ``curve`` (all columns of ``cells`` and ``curve``)."""
    n, last = len(dims), len(dims) - 1
    steps, now = [f"h0 AS (SELECT *, {', '.join(f'CAST({d} AS BIGINT) AS x{i}' for i, d in enumerate(dims))} FROM cells)"], 0
    keep = lambda x, k: f"SELECT * REPLACE ({', '.join(f'{e} AS x{i}' for i, e in enumerate(x))}) FROM h{k}"
    for s in range(n * (bits - 1)):
        q, j = 1 << (bits - 1 - s // n), s % n
        new = [f"x{i}" for i in range(n)]
        swap = f"(xor(x0, x{j}) & {q - 1})"
        new[0] = f"CASE WHEN x{j} & {q} <> 0 THEN xor(x0, {q - 1}) ELSE xor(x0, {swap}) END"
        if j:
            new[j] = f"CASE WHEN x{j} & {q} <> 0 THEN x{j} ELSE xor(x{j}, {swap}) END"
        steps.append(f"h{now + 1} AS ({keep(new, now)})")
        now += 1
    gray = ["x0"]
    for i in range(1, n):
        gray.append(f"xor({gray[-1]}, x{i})")
    steps.append(f"h{now + 1} AS ({keep(gray, now)})")
    now += 1
    flips = "0"
    for s in range(1, bits):
        flips = f"xor({flips}, CASE WHEN x{last} & {1 << s} <> 0 THEN {(1 << s) - 1} ELSE 0 END)"
    index = " + ".join(f"((xor(x{s % n}, t) >> {bits - 1 - s // n}) & 1) * {1 << (n * bits - 1 - s)}" for s in range(n * bits))
    steps.append(f"h{now + 1} AS (SELECT *, {flips} AS t FROM h{now})")
    names = ", ".join([*[f"x{i}" for i in range(n)], "t"])
    return ",\n".join([*steps, f"curve AS (SELECT * EXCLUDE ({names}), CAST({index} AS BIGINT) AS curve FROM h{now + 1})"])
