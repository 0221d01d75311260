"""Best-fit packing of token pieces after a Martello-Toth dominance reduction.

Only the histogram of piece lengths (at most ``capacity`` entries, however large the
corpus) reaches the driver. The reduction fixes sets that provably dominate every
other set with the same largest piece; best fit decreasing places the rest, whole
counts at a time. Pieces then find their place by length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, map_text, without
from .wordbpe import word_bpe

#: Pieces of one length are ranked in at least so many groups, and in groups of at most about so many pieces.
RANK_GROUPS, GROUP_ROWS = 64, 200_000


class Plan:
    """Places for ranks of lengths: rows (length, first rank, pieces, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        if any(not 0 < n <= capacity for n in counts):
            raise ValueError("lengths must be between 1 and the capacity")
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c}
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.ranked: dict[int, int] = defaultdict(int)
        self.sequences = self.fixed = 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _put(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.ranked[length], n, sequence, offset))
        self.ranked[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _fix(self, *lengths: int, times: int) -> None:
        """``times`` sequences, each with one piece of each of ``lengths``."""
        offset = 0
        for n in lengths:
            self._put(n, times, self.sequences, offset)
            offset += n
        self.sequences += times

    def _partner(self, length: int, sizes: list[int]) -> tuple[int, int] | None:
        """(size, times) of the one piece that dominates all that could go beside ``length``; size 0: none fits."""
        room = self.capacity - length
        spare = lambda n: self.left.get(n, 0) - (n == length)
        below = bisect_left(sizes, room + 1)
        best = next((n for n in reversed(sizes[:below]) if spare(n) > 0), 0)
        if not best:
            return 0, self.left[length]
        times = self.left[length] // 2 if best == length else min(self.left[length], self.left[best])
        if best == room:
            return best, times
        small: list[int] = []
        for n in sizes[:below]:
            small += [n] * min(3 - len(small), spare(n))
            if len(small) == 3:
                break
        if len(small) < 2 or small[0] + small[1] > room:
            return best, times
        if len(small) == 3 and sum(small) <= room:
            return None
        # No three fit: one piece dominates if no pair that fits weighs more.
        i, j, most = 0, below - 1, 0
        while i <= j:
            a, b = sizes[i], sizes[j]
            if a + b > room or spare(b) < 1:
                j -= 1
            elif spare(a) < 1 + (a == b):
                i += 1
            else:
                most, i = max(most, a + b), i + 1
        return (best, 1) if best >= most else None

    def _reduce(self) -> None:
        changed = True
        while changed and self.left:
            changed = False
            for length in sorted(self.left, reverse=True):
                while self.left.get(length) and (found := self._partner(length, sorted(self.left))):
                    size, times = found
                    self._fix(*([length, size] if size else [length]), times=times)
                    changed = True

    def _best_fit(self) -> None:
        rooms: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)

        def keep(room: int, first: int, n: int) -> None:
            if n and room:
                if not open_[room]:
                    insort(rooms, room)
                open_[room].append((first, n))

        for length in sorted(self.left, reverse=True):
            while n := self.left.get(length, 0):
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, m = open_[room].pop()
                    if not open_[room]:
                        rooms.pop(at)
                else:
                    room, m = self.capacity, -(-n // (self.capacity // length))
                    first = self.sequences
                    self.sequences += m
                each = room // length
                used, over = (m, 0) if n >= m * each else divmod(n, each)
                for k in range(each if used else 0):
                    self._put(length, used, first, self.capacity - room + k * length)
                for k in range(over):
                    self._put(length, 1, first + used, self.capacity - room + k * length)
                keep(room - each * length, first, used)
                if over:
                    keep(room - over * length, first + used, 1)
                keep(room, first + used + bool(over), m - used - bool(over))


def token_pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of the token ids of ``text`` and ``end_id``, cut after each ``capacity``.

    A null text counts as empty (one piece with the end id); a repeated row gives its pieces again.
    """

    def make():
        bpe, end = word_bpe(path), np.array([end_id], "<u4").tobytes()

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, first = bpe.encode(part.column("text"))
            raw, rows = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), []
            for doc, a, b in zip(part.column("doc_id").to_pylist(), first.tolist(), first[1:].tolist()):
                n = b - a + 1
                for k, s in enumerate(range(0, n, capacity)):
                    m = min(capacity, n - s)
                    whole = raw[4 * (a + s) : 4 * (a + min(s + m, n - 1))]
                    crc = zlib.crc32(whole)
                    rows.append((doc, k, s, m, zlib.crc32(end, crc) if s + m == n else crc))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return work

    return map_text(df.select(F.col("doc_id").cast("long"), "text"), "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is between 1 and ``capacity``.

    A piece of the whole capacity is a sequence alone, with a negative number, and needs no
    rank. Reads ``pieces`` three times, so pass a written table. Equal rows get places of
    their own; columns named ``sequence_id`` and ``offset`` are replaced, others are kept.
    """
    spark = pieces.sparkSession
    group, rank, before, n = fresh("group", "rank", "before", "n")
    rows = without(pieces, "sequence_id", "offset")
    key = [F.col(c) for c in rows.columns if c in ("doc_id", "piece")] or [F.col("length")]
    whole = rows.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rows = rows.filter(F.col("length").isNull() | (F.col("length") != capacity))
    sums = {int(r.length): int(r.n) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    groups = max(RANK_GROUPS, -(-max(sums.values(), default=0) // GROUP_ROWS))
    grouped = rows.withColumn(group, F.pmod(F.xxhash64(*key), F.lit(groups)))
    counts = grouped.groupBy("length", group).agg(F.count(F.lit(1)).alias(n))
    plan = Plan(sums, capacity)
    placed = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(placed)
    starts = counts.select("length", group, (F.sum(n).over(W.partitionBy("length").orderBy(group)) - F.col(n)).alias(before))
    ranked = grouped.withColumn(rank, F.row_number().over(W.partitionBy("length", group).orderBy(*key)) - 1)
    ranked = ranked.join(starts, ["length", group]).withColumn(rank, (F.col(rank) + F.col(before)).cast("long"))
    names = rows.columns

    def place(batches):
        table = held.value
        at = table[:, 0] << 40 | table[:, 1]
        for batch in batches:
            length, own = batch.column("length").to_numpy(), batch.column(rank).to_numpy()
            row = table[np.searchsorted(at, length.astype(np.int64) << 40 | own, side="right") - 1] if len(table) else np.zeros((0, 5), np.int64)
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 3] + own - row[:, 1]), pa.array(row[:, 4])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return ranked.select(*[F.col(f"`{c}`") for c in names], rank).mapInArrow(place, f"{schema}, sequence_id long, offset long").unionByName(whole)


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's pieces with their places in sequences of at most ``capacity`` tokens."""
    return pack(cut(token_pieces(df, path, capacity, end_id), "pieces"), capacity)
