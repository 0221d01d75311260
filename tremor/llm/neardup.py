"""Near duplicates: MinHash signatures, a multi-index Hamming join, exact confirmation, components.

A signature has chunks of slots, values of ``VALUE_BITS`` bits each, as many as the
threshold needs (``Layout``). If two signatures differ in fewer than
``chunks * (ERRORS + 1)`` values, some chunk differs in at most ``ERRORS`` (pigeonhole);
each chunk is indexed once for every way to leave that many values out, so such pairs
always share a key. Two sets with the threshold's similarity miss every key with
probability ``MISS`` at most.

Documents with one set of shingles are one class, so exact copies are never paired.
A key's classes are first compared with one of them only (a star); most of a group
joins up that way. What is left, sets of different components under a common key, is compared
pair by pair as far as sizes and rarest shingles allow a link, so no link between
components is lost; links inside a component need not be found again.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, flat_text, fresh, handing_back, hash_filter, map_text, passing, released, text_slices, values_of, words_of

#: Words of a shingle; links have 100 * intersection >= percent * union, with this percent where none is given.
WIDTH, PERCENT = 5, 85
#: Values that may differ in a chunk, bits of a value, and most keys of a signature.
ERRORS, VALUE_BITS, MOST_KEYS = 1, 16, 96
#: Most probability that two sets that link share no key.
MISS = 3e-7
#: Stars around different members before pairs are compared one by one.
STARS = 2
#: Documents of one set from which on they are joined apart: a thousand at least, and so many that there are at most ``HOT_SETS`` such sets.
HOT, HOT_SETS = 1000, 100_000
#: So many numbers at most are broadcast to find the few rows that a join is about; with more, all rows are shuffled for it.
HELD_NUMBERS = 1_000_000
#: Sets with one shingle that are compared in a task: more are cut into blocks, and blocks compared in pairs.
BLOCK = 2000


@dataclass(frozen=True)
class Layout:
    """The signature and its index for one threshold."""

    percent: int
    chunks: int
    slots: int

    @property
    def size(self) -> int:
        return self.chunks * self.slots


@lru_cache
def layout(percent: int = PERCENT) -> Layout:
    """The longest chunks that keep to ``MISS`` with at most ``MOST_KEYS`` keys."""
    if not 60 <= percent <= 100:
        raise ValueError(f"a threshold of {percent} % is not between 60 and 100")
    t, found = percent / 100, (0, 0)
    for slots in range(2, 13):
        miss = 1 - t**slots - slots * t ** (slots - 1) * (1 - t)
        chunks = max(1, math.ceil(math.log(MISS) / math.log(miss))) if miss > 0 else 1
        if chunks * slots <= MOST_KEYS:
            found = chunks, slots
    return Layout(percent, *found)


def _odd(random: np.random.Generator, n: int) -> np.ndarray:
    return random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache
def _factors(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random factors by place in a shingle, and scale, shift, factor and tag by value of a signature."""
    random = np.random.default_rng(20240229)
    return tuple(_odd(random, n) for n in (WIDTH, size, size, size, size))


#: The default threshold's.
CHUNKS, SLOTS = layout().chunks, layout().slots
_BY_PLACE = _factors(CHUNKS * SLOTS)[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingles, as 64-bit hashes; null and blank texts have none.

    Words are runs between blanks and the controls 9 to 13, A-Z in lower case; with
    fewer words than a shingle has, the whole sequence is the one shingle.
    """
    flat = pc.replace_substring_regex(pc.ascii_lower(flat_text(texts)), "[\t-\r]", " ")
    index, seen, first = words_of(flat)
    if not len(index):
        return [np.zeros(0, np.uint64)] * len(texts)
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in values_of(seen.cast(pa.large_binary()))), np.uint64, len(seen))[index]
    rolled = sum((words[k : len(words) - WIDTH + 1 + k] * _BY_PLACE[k] for k in range(WIDTH)), np.uint64(0)) if len(words) >= WIDTH else np.zeros(0, np.uint64)
    rolled, out = mixed(rolled), []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(rolled[a : b - WIDTH + 1]))
        else:
            out.append(mixed(np.array([(words[a:b] * _BY_PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], lay: Layout) -> np.ndarray:
    """A row of ``lay.size`` values for each set, none of which is empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    _, scale, shift, _, _ = _factors(lay.size)
    out = np.empty((len(sets), lay.size), np.uint64)
    for k in range(lay.size):
        out[:, k] = np.minimum.reduceat(flat * scale[k] + shift[k], starts)
    return mixed(out) >> np.uint64(64 - VALUE_BITS)


def index_keys(values: np.ndarray, lay: Layout = layout()) -> np.ndarray:
    """For each chunk, a key for each value left out."""
    _, _, _, by_slot, tag = _factors(lay.size)
    scaled = (values * by_slot).reshape(-1, lay.chunks, lay.slots)
    return mixed(scaled.sum(axis=2, dtype=np.uint64)[:, :, None] - scaled + tag.reshape(lay.chunks, lay.slots)).reshape(len(values), -1)


def _sets_and_keys(docs: DataFrame, lay: Layout) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id, keys) of rows (doc_id, text, text_hash)."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(part.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            keys = index_keys(signatures([sets[i] for i in full], lay), lay) if full else np.zeros((0, lay.size), np.uint64)
            counts = np.zeros(len(sets), np.int64)
            counts[full] = 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts * lay.size))), pa.int32()), pa.array(keys.view(np.int64).ravel()))
            return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), lists], ["doc_id", "text_hash", "n_shingles", "set_id", "keys"])

        return work

    return map_text(docs, "doc_id long, text_hash long, n_shingles long, set_id binary, keys array<long>", make)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                both = pa.concat_arrays([part.column("text_a"), part.column("text_b")]).dictionary_encode()
                sets, at = shingle_sets(both.dictionary), both.indices.to_numpy()
                n, good = part.num_rows, []
                for i in range(n):
                    s, t = sets[at[i]], sets[at[n + i]]
                    small, large = sorted((len(s), len(t)))
                    common = 0
                    if large and 100 * small >= percent * large:
                        near = np.minimum(np.searchsorted(t, s), len(t) - 1)
                        common = int((t[near] == s).sum())
                    good.append(common > 0 and 100 * common >= percent * (small + large - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return rows.select("a", "b", "text_a", "text_b").mapInArrow(handing_back(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id that it reaches.

    Alternates large stars and small stars; each round is written, and the edges stop
    changing after a number of rounds that grows with the logarithm of the longest path.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    size = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).head())
    before = size(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        old, now = now, cut(small.filter("u != v").distinct(), "edges")
        released(old)
        after = size(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _linked(df: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component, least) of every row: ``component`` is the number of a group of
    linked sets (null without words or id), ``least`` the smallest (doc_id, text_hash) in it.

    Rows with one set are one class, with a number of its own, so rows that share an id are
    not mixed up.
    """
    lay = layout(percent)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    # A row's number is written with it, so that it stays.
    base = cut(_sets_and_keys(docs, lay).withColumn("row", F.monotonically_increasing_id()), "sets")
    own = F.struct("doc_id", "text_hash")
    full = base.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("set_id").agg(F.min(own).alias("own"), F.min_by("row", F.struct("doc_id", "text_hash", "row")).alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    reps = cut(_first_of_sets(full.select("set_id", "row", "keys"), classes), "reps")
    # Keys are summed with partial sums, so a frequent one is no single task's; the rows of common keys, which are few, are then joined.
    common = reps.select("id", F.explode("keys").alias("key")).groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    common = cut(common.filter("first != last").drop("last"), "common")
    shared = cut(_rows_of(reps, common).join(common, "key"), "shared")
    names = cut(base.select(F.col("row").alias("id"), "doc_id", "text_hash", "n_shingles").join(shared.select("id").distinct(), "id"), "names")
    texts = cut(_texts_of(docs, names), "texts")
    tested = cut(shared.filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    edges = cut(_confirmed(tested, texts, percent), "links")
    comps, gone = components(edges), []
    left = cut(_open(shared, comps), "open")
    for turn in range(1, STARS):
        if left.isEmpty():
            break
        middle = F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(turn)))
        stars = left.join(left.groupBy("key").agg(middle.alias("m")), "key").filter("m.component != component").select(F.least("m.id", "id").alias("a"), F.greatest("m.id", "id").alias("b")).distinct()
        fresh_pairs = cut(stars.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested, edges, gone = tested.union(fresh_pairs), edges.union(cut(_confirmed(fresh_pairs, texts, percent), "links")), [*gone, comps, left]
        comps = components(edges)
        left = cut(_open(shared, comps), "open")
    open_rows = left
    left = _linkable(left.join(texts.select("id", "n_shingles"), "id"), texts, percent)
    if not left.isEmpty():
        fresh_pairs = cut(_close_pairs(left, texts, lay).join(tested, ["a", "b"], "left_anti"), "pairs")
        edges, gone = edges.union(cut(_confirmed(fresh_pairs, texts, percent), "links")), [*gone, comps]
        comps = components(edges)
    groups = classes.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = groups.groupBy("component").agg(F.min("own").alias("least"))
    groups = cut(groups.join(least, "component").select("set_id", "n", "component", "least"), "groups")
    released(reps, common, shared, names, texts, tested, edges, comps, left, open_rows, *gone)
    return _per_document(base.drop("keys", "row"), groups)


def _first_of_sets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, keys): the row of ``rows`` (set_id, row, keys) that stands for each class.

    Sets that one document has, most of them, are their own; only others are joined.
    """
    several = cut(classes.filter("n > 1").select("set_id", "id"), "several")
    number = F.xxhash64("set_id")
    if several.count() <= HELD_NUMBERS:
        held = F.broadcast(several.select(number.alias("_number")).distinct())
        alone = rows.join(held, number == F.col("_number"), "left_anti")
        rest = rows.join(held, number == F.col("_number"), "left_semi").join(several, "set_id", "left").filter("id IS NULL OR id = row").drop("id")
        rows = alone.unionByName(rest)
    else:
        rows = rows.join(several, "set_id", "left").filter("id IS NULL OR id = row")
    return rows.select(F.col("row").alias("id"), "keys")


def _texts_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(id, n_shingles, text) of the documents in ``names`` (id, doc_id, text_hash, n_shingles); other texts stay where they are."""
    own = ["doc_id", "text_hash"]
    number = F.xxhash64(*own)
    if names.count() <= HELD_NUMBERS:
        held = F.broadcast(names.select(number.alias("_number")).distinct())
        docs = docs.join(held, number == F.col("_number"), "left_semi")
    return docs.join(names, own).select("id", "n_shingles", "text").dropDuplicates(["id"])


def _rows_of(reps: DataFrame, common: DataFrame) -> DataFrame:
    """(id, key) of ``reps`` (id, keys) under keys that a filter of ``common`` (key) lets pass: all of these, and few others."""
    held = reps.sparkSession.sparkContext.broadcast(hash_filter(common.select("key")))

    def run(batches):
        for batch in batches:
            lists = batch.column("keys")
            keys = lists.flatten().to_numpy().view(np.uint64)
            at = passing(held.value, keys)
            owner = np.searchsorted(lists.offsets.to_numpy() - lists.offsets[0].as_py(), at, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array(keys[at].view(np.int64))], ["id", "key"])

    return reps.mapInArrow(handing_back(run), "id long, key long")


def _per_document(base: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row of ``base`` with its set's group.

    Sets of many documents, of which there are few, are broadcast, so their rows stay where they are.
    """
    hot = max(HOT, -(-base.count() // HOT_SETS))
    often = F.broadcast(groups.filter(F.col("n") >= hot).drop("n"))
    rare = groups.filter(F.col("n") < hot).drop("n")
    placed = base.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    rest = base.filter("set_id IS NULL OR doc_id IS NULL").withColumns({"component": F.lit(None).cast("long"), "least": F.lit(None).cast(groups.schema["least"].dataType)})
    found = placed.join(often, "set_id").unionByName(placed.join(often, "set_id", "left_anti").join(rare, "set_id"))
    return found.unionByName(rest).select("doc_id", "text_hash", "n_shingles", "component", "least")


def near_duplicates(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) of every row of ``df`` (doc_id, text).

    Documents link whose shingles' intersection has at least ``percent`` hundredths of their union.
    ``component_id`` is the smallest id that a row's text reaches. A document without words is
    alone. A null id links with nothing: its component is null, and it is kept. Repeated rows have equal results.
    """
    component = F.coalesce(F.col("least.doc_id"), F.col("doc_id"))
    return _linked(df, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _shingles_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, shingle) of the texts with these ids."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(part.column("text"))
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(owner)), pa.array(np.concatenate(sets).view(np.int64))], ["id", "shingle"])

    return texts.join(ids.select("id"), "id", "left_semi").select("id", "text").mapInArrow(handing_back(run), "id long, shingle long")


def _close_pairs(left: DataFrame, texts: DataFrame, lay: Layout) -> DataFrame:
    """Pairs (a, b) of ids under open keys, of different components, that sizes and rarest shingles allow to link.

    In the order of how many sets have a shingle, two sets that link share one of the
    first n - o + 1 of each, where o is the least intersection that links them. With the
    larger set's size at least the smaller's, o is 2t/(1+t) of the smaller set and t of
    the larger at least (t: the threshold). Of two equal sizes, the set with the rarer
    shingles counts as the smaller. Sets of a frequent shingle are cut into blocks, and each
    pair of blocks meets apart.
    """
    percent = lay.percent
    ids = left.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n_shingles", "component", "alone")])
    each = _shingles_of(ids, texts)
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    rows = each.join(often, "shingle").join(ids, "id")
    n = F.col("n_shingles")
    rows = rows.withColumn("place", F.col("alone") + F.row_number().over(W.partitionBy("id").orderBy("often", "shingle")))
    rows = rows.withColumn("long", n - F.expr(f"({percent} * n_shingles + 99) div 100") + 1).filter(F.col("place") <= F.col("long"))
    rows = rows.withColumn("short", n - F.expr(f"({2 * percent} * n_shingles + {99 + percent}) div {100 + percent}") + 1)
    rows = rows.withColumn("weight", F.sum(F.when(F.col("place") <= F.col("short"), F.col("often"))).over(W.partitionBy("id"))).drop("long")
    blocks = F.ceil(F.col("often") / F.lit(BLOCK)).cast("int")
    rows = cut(rows.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), blocks).cast("int")}).drop("often"), "rarest")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = rows.filter("place <= short").withColumnRenamed("own", "i").withColumn("j", every).alias("a")
    b = rows.withColumnRenamed("own", "j").withColumn("i", every).alias("b")
    order = lambda x: F.struct(f"{x}.n_shingles", f"{x}.weight", f"{x}.id")
    # The intersection has none of the shingles that one of the sets has alone.
    common = F.least(F.col("a.n_shingles") - F.col("a.alone"), F.col("b.n_shingles") - F.col("b.alone"))
    near = (F.col("a.component") != F.col("b.component")) & (order("a") < order("b")) & (100 * F.col("a.n_shingles") >= percent * F.col("b.n_shingles"))
    near = near & (100 * common >= percent * (F.col("a.n_shingles") + F.col("b.n_shingles") - common))
    same = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    return a.join(b, same & near).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def _linkable(left: DataFrame, texts: DataFrame, percent: int, rounds: int = 3) -> DataFrame:
    """Rows of ``left`` whose sets can still link with another one in it, with ``alone``, the shingles that no other has.

    A link leaves at most 100 - ``percent`` hundredths of a set outside the other. Shingles that no other set of
    ``left`` has are outside all of them, so a set with more of these links with none. As
    sets go, more shingles become single, hence the rounds. Each counts shingles once,
    in proportion to the sets, while pairs would grow with their square.
    """
    for _ in range(rounds):
        if left.isEmpty():
            return left
        ids = left.select("id", "n_shingles").distinct()
        each = _shingles_of(ids, texts)
        # By shingle: an id, and whether there is another.
        single = each.groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other")).filter("id = other")
        alone = cut(single.groupBy("id").agg(F.count(F.lit(1)).alias("alone")), "alone")
        rest = left.drop("alone").join(alone, "id", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
        rest = rest.filter(F.col("alone") * 100 <= (100 - percent) * F.col("n_shingles"))
        span = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
        before, left = ids.count(), cut(rest.join(span, "key", "left_semi"), "open")
        if left.select("id").distinct().count() == before:
            break
    return left


def _open(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of ``shared`` under keys whose ids are in more than one component."""
    rows = shared.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    span = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    return rows.join(span, "key", "left_semi").drop("first")


def drop_near_duplicates(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, with the columns of ``df``.

    Rows that share an id but not their text are documents of their own; of rows with equal id
    and text that link, one stays. Rows without an id stay, and so do rows without words,
    which link with nothing.
    """
    h, d = fresh("hash", "doc")
    found = cut(_linked(df, percent).filter("doc_id IS NOT NULL"), "groups")
    first = found.filter("component IS NOT NULL AND doc_id = least.doc_id AND text_hash = least.text_hash").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    plain = found.filter("component IS NULL").select("doc_id", "text_hash", F.lit(1).cast("long").alias("n")).distinct()
    kept = cut(first.unionByName(plain).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h), "n"), "kept")
    same = (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64("text") == F.col(h))
    columns = [F.col(f"`{c}`") for c in df.columns]
    once = df.join(kept.filter("n = 1").drop("n"), same, "left_semi")
    again = df.join(kept.filter("n > 1").drop("n"), same).dropDuplicates([d, h]).select(*columns)
    return once.unionByName(again).unionByName(df.filter("doc_id IS NULL"))
