"""Spelling variants: words one edit apart, by merging the light subtrees of a trie.

Words are counted, sorted and cut into ranges, each a part of one trie. Every node has a
heavy child, the one with most words below it; the others, and a word that ends at the
node, are light, so a word lies below as many light edges as the logarithm of the number of words
at most. Each light subtree is merged, small into large, with an error at its edge:

* its first character replaced by the heavy one, or the heavy one skipped before it
  (that is, put before it): its words then end where words of the heavy subtree end;
* its first character skipped: its words then end where words of the node end;
* its first character replaced by anything: words of two light subtrees then end together.

Two words part at one node, where one of them at least is light, so each pair one edit
apart ends together once. "Ends together" is a join on the changed word, over all ranges.

Any child can be the heavy one for right results, as long as all agree. Nodes that are
prefixes of a range's first key can have words in several ranges: their children are counted
over all words. All other nodes lie within one range.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cut, even_keys, handing_back, map_text, pieces, released, runs, values_of

#: A word's least code points and occurrences; how many times as frequent a form is.
LEAST_POINTS, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: Of the runs of a document, those whose checksum this divides lose a character.
DAMAGE = 199
#: Bytes of text counted at a time; of words in a range of the trie; sampled words a range; code points of a range's first key.
SLICE, RANGE_BYTES, RANGE_SAMPLE, KEY_POINTS = 4 << 20, 1 << 18, 32, 64

_TABLE = 64  # bytes of a word up to which checksums are looked up


def _shift_tables(longest: int = _TABLE) -> np.ndarray:
    """For n bytes and each byte of a checksum: what it adds to the checksum of a text with n more bytes (checksums are linear)."""
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    byte = np.arange(256)
    for n in range(longest + 1):
        zero = zlib.crc32(bytes(n), 0)
        bits = np.array([zlib.crc32(bytes(n), 1 << i) ^ zlib.crc32(bytes(n), 0) for i in range(32)], np.uint32) if n else np.array([1 << i for i in range(32)], np.uint32)
        assert n or zero == 0
        for k in range(4):
            for i in range(8):
                out[n, k] ^= np.where(byte >> i & 1, bits[8 * k + i], 0).astype(np.uint32)
    return out


def checksums(prefix: np.ndarray, length: np.ndarray, own: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """crc32 of the prefix and word together from theirs apart; ``length`` is the word's, in bytes, within the tables."""
    out = own.copy()
    for k in range(4):
        out ^= tables[length, k, prefix >> np.uint32(8 * k) & np.uint32(255)]
    return out


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case (A-Z only), offsets of texts, and start, end and code points of each run of A-Z, a-z and U+00C0 to U+00FF."""
    data, offsets = bytes_of(texts)
    lead = data == 0xC3  # begins each of U+00C0 to U+00FF, and nothing else
    small = data | 0x20
    ascii_ = (small >= 97) & (small <= 122)
    letter = ascii_ | lead
    letter[1:] |= lead[:-1]
    starts, ends = runs(letter, offsets)
    points = ends - starts
    if len(starts):
        points = points - np.diff(np.searchsorted(np.flatnonzero(lead), np.stack((starts, ends), axis=1)), axis=1).ravel()
    return np.where(ascii_, small, data), offsets, starts, ends, points


def count_words(docs: DataFrame, least_points: int = LEAST_POINTS, damage: int = DAMAGE) -> DataFrame:
    """``word`` and ``n``, its occurrences in ``docs`` (doc_id, text), of words of at least ``least_points`` code points.

    A run of letters whose checksum, of ``<doc_id>:<run in lower case>``, is a multiple of
    ``damage`` loses the code point at the checksum modulo its length. Null texts have no words; runs of
    rows with a null id lose nothing; repeated rows count each time.
    """

    def make():
        tables = _shift_tables()

        def work(part: pa.RecordBatch) -> pa.RecordBatch | None:
            data, offsets, starts, ends, points = letter_runs(part.column("text"))
            wanted = points >= least_points
            starts, ends, points = starts[wanted], ends[wanted], points[wanted]
            if not len(starts):
                return None
            found = pieces(data, starts, ends).dictionary_encode()
            code, seen = found.indices.to_numpy(), values_of(found.dictionary)
            length, own = np.array([len(w) for w in seen]), np.array([zlib.crc32(w) for w in seen], np.uint32)
            ids = part.column("doc_id").to_pylist()
            before = np.array([zlib.crc32(b"%d:" % i) if i is not None else 0 for i in ids], np.uint32)
            doc = np.searchsorted(offsets, starts, side="right") - 1
            inside = length[code] <= _TABLE
            mark = np.zeros(len(code), np.uint32)
            mark[inside] = checksums(before[doc[inside]], length[code[inside]], own[code[inside]], tables)
            for k in np.flatnonzero(~inside).tolist():
                mark[k] = zlib.crc32(seen[code[k]], int(before[doc[k]]))
            known = np.array([i is not None for i in ids], bool)
            hit = (mark % damage == 0) & known[doc]
            n = np.bincount(code[~hit], minlength=len(seen))
            counts: dict[str, int] = defaultdict(int)
            for k in np.flatnonzero(hit & (points > least_points)).tolist():
                word, at = seen[code[k]].decode(), int(mark[k]) % int(points[k])
                counts[word[:at] + word[at + 1 :]] += 1
            kept = np.flatnonzero(n)
            words = found.dictionary.take(pa.array(kept)).cast(pa.large_string()).cast(pa.string())
            words = pa.concat_arrays([words, pa.array(list(counts), pa.string())])
            return pa.RecordBatch.from_arrays([words, pa.array(np.concatenate((n[kept], np.fromiter(counts.values(), np.int64, len(counts)))), pa.int64())], ["word", "n"])

        return work

    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "word string, n long", make, limit=SLICE).groupBy("word").agg(F.sum("n").alias("n"))


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


def top_depth(word: str, keys: list[str], place: int) -> int:
    """How far a word of range ``place`` shares the first key of its range, or of the next."""
    return max(_common(word, keys[k]) for k in (place, place + 1) if 0 <= k < len(keys)) if keys else -1


def light_edges(words: list[str], shared: dict[str, tuple[str, int]]) -> Iterator[tuple[int, int, int, str, bool]]:
    """(first, past the last, depth, heavy character, whether two are light) of light edges within a range of sorted, distinct ``words``.

    Words from first on lie below the edge; an edge without a character holds the one word that ends at the node.
    Nodes in ``shared`` are left out.
    """
    open_: list[tuple[int, list[int]]] = []  # depth, and where the children start
    for i in range(1, len(words) + 1):
        same = _common(words[i - 1], words[i]) if i < len(words) else -1
        start = i - 1
        while open_ and open_[-1][0] > same:
            depth, starts = open_.pop()
            start = starts[0]
            if words[start][:depth] in shared:
                continue
            bounds = list(zip(starts, [*starts[1:], i]))
            edges = [(a, b) for a, b in bounds if len(words[a]) > depth]
            heavy = max(edges, key=lambda e: e[1] - e[0])
            for a, b in bounds:
                if (a, b) != heavy:
                    yield a, b, depth, words[heavy[0]][depth], len(edges) > 2
        if same >= 0:
            if open_ and open_[-1][0] == same:
                open_[-1][1].append(i)
            else:
                open_.append((same, [start, i]))


def _merged(word: str, depth: int, heavy: str, several: bool, least: int) -> Iterator[tuple[str, bool]]:
    """(Word changed at the light edge, whether by any character there); a zero byte stands for any."""
    before, own, after = word[:depth], word[depth : depth + 1], word[depth + 1 :]
    yield before + heavy + own + after, False
    if own:
        if heavy != own:
            yield before + heavy + after, False
        if several:
            yield before + "\0" + after, True
        if after[:1] != own and len(word) > least:  # else the same skip comes deeper, where the words part
            yield before + after, False


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of ``words`` (word, n; distinct, without null) that differ by one inserted, deleted or replaced code point, once.

    Words may be of any length and hold any code point but zero.
    """
    spark = words.sparkSession
    size = words.agg(F.sum(F.octet_length("word")).alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(F.length("word")).alias("least")).head()
    ranges, least = 1 + (size.bytes or 0) // RANGE_BYTES, size.least or 0
    keys: list[str] = []
    if ranges > 1:  # a sample bounded by the number of ranges
        share = min(1.0, ranges * RANGE_SAMPLE / size.n)
        drawn = words.filter(F.pmod(F.xxhash64("word", F.lit("cut")), F.lit(1 << 40)) < int(share * (1 << 40))).select(F.substring("word", 1, KEY_POINTS).alias("word"))
        drawn = sorted({r.word for r in drawn.collect()})
        keys = drawn[RANGE_SAMPLE // 2 :: RANGE_SAMPLE]
    held_keys = spark.sparkContext.broadcast(keys)

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = held_keys.value, defaultdict(int)
        for batch in batches:
            for word in values_of(batch.column(0)):
                for d in range(top_depth(word, keys, bisect.bisect_right(keys, word) - 1) + 1):
                    counts[word[:d], word[d : d + 1]] += 1
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["node", "child", "n"])

    shared: dict[str, tuple[str, int]] = {}
    if keys:
        by_node = words.select("word").mapInArrow(children, "node string, child string, n long").groupBy("node", "child").agg(F.sum("n").alias("n")).filter("child <> ''")
        heaviest = by_node.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "child")).alias("heavy"), F.count(F.lit(1)).alias("children"))
        shared = {r.node: (r.heavy.child, r.children) for r in heaviest.collect()}  # prefixes of ``keys``
    held = spark.sparkContext.broadcast(shared)
    even = even_keys(spark, len(keys) + 1)
    held_even = spark.sparkContext.broadcast(even)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, deal = held_keys.value, np.array(held_even.value)
        for batch in batches:
            at = np.fromiter((bisect.bisect_right(keys, w) for w in values_of(batch.column(0))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(deal[at])], ["word", "n", "range", "deal"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shared = held_keys.value, held.value
        own: list[tuple[int, str, int]] = []
        rows: tuple[list, list, list, list] = ([], [], [], [])

        def entries() -> Iterator[tuple[str, bool, str, int]]:
            words = [w for _, w, _ in own]
            for a, b, depth, heavy, several in light_edges(words, shared):
                for _, word, n in own[a:b]:
                    for key, any_ in _merged(word, depth, heavy, several, least):
                        yield key, any_, word, n
            for at, word, n in own:
                for d in range(top_depth(word, keys, at - 1) + 1):
                    heavy, edges = shared.get(word[:d], ("", 0))
                    if heavy and heavy != word[d : d + 1]:
                        for key, any_ in _merged(word, d, heavy, edges > 2, least):
                            yield key, any_, word, n

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.bool_(), pa.string(), pa.int64()))], ["key", "any", "a", "a_n"])
            for c in rows:
                c.clear()
            return out

        def finished() -> Iterator[pa.RecordBatch]:
            for row in entries():
                for c, x in zip(rows, row):
                    c.append(x)
                if len(rows[0]) >= 20_000:
                    yield flush()
            own.clear()

        for batch in batches:
            for word, n, at in zip(values_of(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if own and own[0][0] != at:
                    yield from finished()
                own.append((at, word, n))
        yield from finished()
        yield flush()

    placed = words.select("word", "n").mapInArrow(place, "word string, n long, range long, deal long")
    placed = placed.repartition(len(keys) + 1, "deal").sortWithinPartitions("range", "word").select("word", "n", "range")
    merged = cut(placed.mapInArrow(handing_back(merge), "key string, any boolean, a string, a_n long"), "merged")
    ended = merged.filter("NOT any").join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), F.col("key") == F.col("b")).select("a", "a_n", "b", "b_n")
    # Words that share such a key differ in its one character, so there are no more than letters.
    alike = merged.filter("any").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("a", "a_n"))).alias("w")).filter("size(w) > 1")
    alike = alike.select(F.posexplode("w").alias("i", "x"), "w").select("x", F.explode(F.expr("slice(w, i + 2, size(w))")).alias("y"))
    return ended.union(alike.select("x.a", "x.a_n", F.col("y.a").alias("b"), F.col("y.a_n").alias("b_n")))


def forms(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``words`` (word, n) and their ``form``, ``root``, ``n_near``, ``form_n``.

    A form is the near word of largest n (ties: the smallest), if that is ``ratio`` times
    the word's at least; a root follows forms to the last. Counts grow by ``ratio`` at
    each step, so chains are short and end.
    """
    pairs = one_edit_pairs(words)
    both = pairs.union(pairs.select("b", "b_n", "a", "a_n"))
    near = both.groupBy("a", "a_n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("form"))).alias("best"))
    taken = -F.col("best.m") >= ratio * F.col("a_n")
    near = cut(near.select(F.col("a").alias("word"), "n_near", F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.m")).alias("form_n")), "near")
    ahead = cut(near.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "ahead")
    while True:
        step = ahead.join(ahead.select(F.col("word").alias("root"), F.col("root").alias("far")), "root", "left")
        step = cut(step.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "ahead")
        moved = step.filter("moved").limit(1).count()
        released(ahead)
        ahead = step.drop("moved")
        if not moved:
            break
    out = words.join(near, "word", "left").join(ahead, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """Words of ``docs`` (doc_id, text) with at least ``least_count`` occurrences, and their forms and roots.

    Null and empty texts have no words, an empty table none either; other columns are not read.
    """
    return forms(cut(count_words(docs, least_points).filter(F.col("n") >= least_count), "words"), ratio)
