"""Each method against brute force, an exact round trip, or held-out accuracy."""

from __future__ import annotations

import itertools
import math
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import MIDDLE, ROOT
from tests.helpers import canonical, duck
from tremor.llm import common, decontam, hilbert, idstore, langid, neardup, packing, queries, spotsigs, toxicity, transcripts, wordbpe, wordpiece
from tremor.llm.common import new_folder, text_slices, words_of

PATH = public_tokenizers.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return documents.orderBy("doc_id").collect()


def test_words_of_slices():
    texts = ["a  b\nc", None, "", " x ", "é" * 50 + " y"] * 40
    for part in text_slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), limit=100):
        index, seen, first = words_of(part.column("text"))
        seen = seen.to_pylist()
        for t, a, b in zip(part.column("text").to_pylist(), first, first[1:]):
            assert [seen[i] for i in index[a:b]] == (t or "").split()


def test_encoder_is_the_library(rows):
    bpe = wordbpe.WordBpe(PATH)
    odd = ["", None, "a<|endoftext|>b it's don't'll", "Ünḯ İstanbul ΑΣ Σ x\ty\r\nz 你好 12a'sb", "  \n x ", "'s't  '  ve", "İ ı é ẞ", "tab\tsep\x0b\x0c\x85 end", "a, b., c.,d . , ,e", "x., y"]
    batch = pa.RecordBatch.from_arrays([pa.array(odd + [r.text for r in rows])], ["text"])
    got = []
    for part in text_slices(batch, limit=200_000):
        ids, first = bpe.encode(part.column("text"))
        got += [ids[a:b].tolist() for a, b in zip(first, first[1:])]
    want = [e.ids for e in bpe.full.encode_batch_fast([t or "" for t in batch.column("text").to_pylist()], add_special_tokens=False)]
    assert got == want


def test_language_held_out(spark, rows):
    got = {r.doc_id: r for r in queries.op1_rank_order_langid(spark, MIDDLE).collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held) and sum(g.held_out for g in got.values()) == len(held)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.99


def test_distance_by_hand():
    def grams(text):
        letters = re.sub(r"[^a-z]+", " ", f" {text.lower()} ")
        counts = {}
        for n in (1, 2, 3):
            for i in range(len(letters) - n + 1):
                g = letters[i : i + n]
                if g != " ":
                    code = 0
                    for c in g:
                        code = code << 13 | ord(c)
                    counts[code] = counts.get(code, 0) + 1
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]

    a, b = grams("the cat and the hat on the mat"), grams("der hund und der mann")
    ranks = {g: (a.index(g) if g in a else 40, b.index(g) if g in b else 40) for g in sorted({*a[:40], *b[:40]})}
    ranks = {g: tuple(r if r < 40 else 40 for r in v) for g, v in ranks.items()}
    model = langid.Profiles(["a", "b"], np.array(list(ranks)), np.array(list(ranks.values())), 40)
    text = "the man on the mat"
    own = grams(text)[:40]
    want = [sum(40 if ranks.get(g, (40, 40))[k] == 40 else abs(i - ranks[g][k]) for i, g in enumerate(own)) / (40 * len(own)) for k in (0, 1)]
    got, n = model.distances(pa.array([text, ""]))
    assert np.allclose(got[0], want) and n[1] == 0 and model.predict(pa.array([text]))[0] == ["a"]


def test_spotsigs_by_hand(spark, documents, rows):
    got = {r.doc_id: r for r in spotsigs.fingerprints(documents).collect()}
    for r, after in list(zip(rows, [*rows[1:], rows[0]]))[::37]:
        n = len(r.text) // 4
        changed = r.text[: len(r.text) - n] + after.text[:n]

        def plain(text):
            words = re.findall(r"[^\W_]+", text.lower())
            out = set()
            for i, w in enumerate(words):
                if w in spotsigs.ANCHORS:
                    rest = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS]
                    if len(rest) >= 2:
                        out.add((w, *rest[:2]))
            return out or {text}

        a, b, c = plain(r.text), plain(changed), plain(after.text)
        assert got[r.doc_id].near_edited == pytest.approx(len(a & b) / len(a | b))
        assert got[r.doc_id].near_next == pytest.approx(len(a & c) / len(a | c))
        assert got[r.doc_id].n_chars == len(r.text)


def test_spotsigs_pairs_are_all_pairs(documents, rows):
    members, pairs = spotsigs.near_pairs(documents)
    classes = {}
    for r in rows:
        classes.setdefault(spotsigs.signature_set(r.text), r.doc_id)
    want = {(a, b) for (s, a), (t, b) in itertools.combinations(sorted(classes.items(), key=lambda x: x[1]), 2) if spotsigs.likeness(s, t) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert members.count() == len(rows) and members.select("class_id").distinct().count() == len(classes)


def test_size_partitions():
    for n in range(1, 400):
        for m in range(n, 400):
            if n >= 0.8 * m:
                assert spotsigs.size_partition(m) - spotsigs.size_partition(n) in (0, 1)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    model = transcripts.Model(*(np.log(rng.dirichlet(np.ones(n), s)) for n, s in ((6, None), (6, 6), (4, 6))), np.log(rng.dirichlet(np.ones(2), (6, transcripts.FORMS))))
    lines = ["User: hi?", "there", "", "- list", "AI: yes"]
    own = [model.line(x) for x in lines]

    def value(path):
        return model.start[path[0]] + sum(model.trans[a, b] for a, b in zip(path, path[1:])) + sum(o[s] for o, s in zip(own, path))

    best = max(itertools.product(range(6), repeat=len(lines)), key=value)
    assert value(model.viterbi(lines)) == pytest.approx(value(best))
    many = lines * 300
    assert len(model.viterbi(many)) == len(many)


def test_roles_recovered(spark):
    got = queries.op3_hmm_transcripts(spark, MIDDLE).toPandas()
    turns = spark.read.parquet(f"{MIDDLE}/conversations.parquet").toPandas()
    both = got.merge(turns, on=["conv_id", "turn"])
    assert len(both) == len(turns) and (both[both.marked].role == both[both.marked].role_pred).all()
    assert (both.role == both.role_pred).mean() > 0.85
    assert all(r.rendered == f"<|{r.role_pred}|>\n{r.text}\n<|end|>\n" for r in both.itertuples())


def test_pieces_change_nothing(spark):
    """A conversation cut over many runs is parsed as in one, and counts are the same."""
    rng = random.Random(8)
    rows = [(c, t, ("user", "assistant")[t % 2] if rng.random() < 0.8 else None, rng.choice(["yes?", "well\nthen", "- item\nq: x", "no"]) + str(rng.random())) for c in (1, 2) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    results, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            model = transcripts.learn(df)
            results.append((model, sorted((r.conv_id, r.turn, r.marked, r.role_pred, r.starts, r.rendered) for r in transcripts.parse(df, model).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for model, got in results[1:]:
        assert got == results[0][1] and len(got) == len(rows)
        for name in ("start", "trans", "marks", "forms"):
            assert np.allclose(getattr(model, name), getattr(results[0][0], name))


def test_markers():
    for line, role in (("User: x", 1), ("### Assistant: y", 2), ("[system] z", 0), ("**Human:** q", 1), ("Q: a", 1), ("users: no", 3), ("The system: no", 3)):
        assert transcripts.marker(line)[0] == role, line


def test_neardup_is_the_sql(spark):
    got, want = queries.op4_minhash_neardup(spark, MIDDLE).toPandas(), duck(MIDDLE).sql(queries.oracle_sql()["op4_minhash_neardup"]).df()
    assert canonical(got) == canonical(want)


def test_neardup_hard_groups(spark):
    """Copies with random edits around the threshold, chains, and a passage that all share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for edits in [0, 1, 1, 2, 2, 2, 3, 3, 4, 5] * 12:
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [word() for _ in range(rng.randint(2, 90))]) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    sets = neardup.shingle_sets(pa.array(texts))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    assert got == {i: root(i) for i in range(len(texts))}


def test_pigeonhole():
    rng = np.random.default_rng(1)
    k = neardup.CHUNKS * neardup.SLOTS
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, k), dtype=np.uint64)
        b = a.copy()
        at = rng.choice(k, neardup.CHUNKS * (neardup.ERRORS + 1) - 1, replace=False)
        b[0, at] = rng.integers(0, 1 << 16, len(at), dtype=np.uint64)
        assert set(neardup.index_keys(a)[0]) & set(neardup.index_keys(b)[0])


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.id: r.component for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_curve_steps_to_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (3, 3), (4, 2)):
        side = 1 << bits
        cells = spark.range(side**n).select(*[(F.shiftright("id", bits * i) % side).cast("int").alias(f"x{i}") for i in range(n)])
        got = hilbert.curve_index(cells, [F.col(f"x{i}") for i in range(n)], "h", bits).orderBy("h").collect()
        assert [r.h for r in got] == list(range(side**n))
        for a, b in itertools.pairwise(got):
            assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def test_shards_are_the_sql(spark):
    from tests.conftest import SMALL
    from tests.helpers import canonical, duck
    from tremor.llm import queries as text

    got = text.op5_hilbert_shards(spark, SMALL).toPandas()
    assert canonical(got) == canonical(duck(SMALL).sql(text.SHARDS_SQL).df())


def test_keys_are_dealt_evenly(spark):
    keys = common.even_keys(spark, 37)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(37, "k").select(F.spark_partition_id().alias("p"), "k")
    assert {r.k: r.p for r in df.collect()} == {k: i for i, k in enumerate(keys)}


def test_store_reads_few_blocks(spark, documents):
    folder = new_folder(spark, "ids")
    idstore.write_store(documents, folder, PATH, 2)
    blocks = spark.read.schema(idstore.BLOCKS).parquet(f"{folder}/blocks")
    assert blocks.filter("first_id <= 7 AND last_id >= 7").count() == 1 < blocks.count()
    plan = blocks.filter("first_id <= 7 AND last_id >= 7").select("body")._jdf.queryExecution().executedPlan().toString()
    assert "first_id" in plan.split("PushedFilters")[1] and "last_id" in plan.split("PushedFilters")[1]


def test_shards_are_even_runs(spark, rows):
    got = queries.op5_hilbert_shards(spark, MIDDLE).toPandas()
    counts = got.groupby("shard").size()
    assert sorted(counts.index) == list(range(8)) and counts.max() - counts.min() <= 1
    order = got.sort_values(["shard", "slot"])
    assert (order.curve.diff().dropna() >= 0).all()
    by = got.set_index("doc_id")
    for r in rows[::29]:
        raw = r.text.encode()
        assert by.loc[r.doc_id, "size"] == len(raw) + 1 and by.loc[r.doc_id, "text_crc32"] == zlib.crc32(raw)


@pytest.mark.parametrize("seed", range(60))
def test_plan_places_all_and_beats_best_fit(seed):
    r = random.Random(seed)
    c = r.choice([10, 17, 30, 100, 2048])
    items = [r.randint(1, c) if r.random() < 0.7 else r.randint(max(1, c // 4), c) for _ in range(r.randint(0, 300))]
    if seed % 3 == 0:
        items = [max(1, x) if x > c // 3 else c // 3 + 1 for x in items]
    counts = {n: items.count(n) for n in set(items)}
    plan = packing.Plan(counts, c)
    places = [(s + i, o, n) for n, _, m, s, o in plan.rows for i in range(m)]
    assert sorted(n for *_, n in places) == sorted(items)
    for _, group in itertools.groupby(sorted(places), key=lambda x: x[0]):
        end = 0
        for _, o, n in group:
            assert o == end
            end += n
        assert end <= c
    bins = []
    for x in sorted(items, reverse=True):
        fit = [i for i, b in enumerate(bins) if b >= x]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= x
        else:
            bins.append(c - x)
    assert plan.sequences <= len(bins)


def fewest(items, c):
    """Fewest bins by search."""
    best = len(items)
    items = sorted(items, reverse=True)

    def walk(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for b in sorted({x for x in bins if x >= items[i]}):
            rest = list(bins)
            rest.remove(b)
            walk(i + 1, [*rest, b - items[i]])
        walk(i + 1, [*bins, c - items[i]])

    walk(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum(seed):
    r = random.Random(seed)
    c, items = 12, [r.randint(2, 11) for _ in range(9)]
    plan = packing.Plan({n: items.count(n) for n in set(items)}, c)
    fixed = sorted(n for n, _, m, s, _ in plan.rows for i in range(m) if s + i < plan.fixed)
    rest = list(items)
    for n in fixed:
        rest.remove(n)
    assert plan.fixed + fewest(rest, c) == fewest(items, c)


def test_pieces_are_the_ids(spark, rows):
    from tokenizers import Tokenizer

    full, got = Tokenizer.from_file(PATH), {}
    for r in queries.op6_best_fit_packing(spark, MIDDLE).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in rows[::41]:
        ids = np.array([*full.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(got[r.doc_id], key=lambda p: p.piece)
        assert [p.start for p in parts] == list(range(0, len(ids), 2048))
        assert [p.ids_crc32 for p in parts] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in parts]


@pytest.mark.parametrize("seed", range(300))
def test_automaton_is_greedy(seed):
    r = random.Random(seed)
    letters = "abc"[: r.randint(1, 3)]
    vocabulary = {"".join(r.choice(letters) for _ in range(r.randint(1, 5))) + (wordpiece.END if r.random() < 0.4 else "") for _ in range(r.randint(1, 14))}
    if r.random() < 0.5:
        vocabulary |= set(letters) | {a + wordpiece.END for a in letters}
    automaton = wordpiece.LongestMatch(vocabulary)
    for _ in range(20):
        w = "".join(r.choice(letters + ("d" if r.random() < 0.1 else "")) for _ in range(r.randint(0, 12))) + wordpiece.END
        assert automaton.count(w) == wordpiece.greedy_count(w, vocabulary)


def test_counts_by_hand(spark, rows):
    vocabulary, chars = set(wordpiece.end_marked_vocabulary(PATH)), wordpiece.byte_chars()
    got = {r.doc_id: r for r in queries.op7_linear_longest_match(spark, MIDDLE).collect()}
    for r in rows[::97]:
        words = re.findall(r"[^\W\d_]+|\d|[^\s\w]+|_+", r.text.lower())
        assert got[r.doc_id].n_words == len(words)
        assert got[r.doc_id].n_tokens == sum(wordpiece.greedy_count("".join(chars[b] for b in w.encode()) + wordpiece.END, vocabulary) for w in words)


def test_store_round_trip(spark, rows):
    from tokenizers import Tokenizer

    full, start = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in queries.op8_zstd_id_store(spark, MIDDLE).collect()}
    for r in rows:
        ids = np.array([*full.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_alignment_by_hand():
    def table(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH), h[i - 1][j] + decontam.GAP, h[i][j - 1] + decontam.GAP)
        return max(map(max, h))

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 12))] for _ in range(2))
        score, matches, columns, first, end = decontam.align(np.array(a), np.array(b))
        assert score == table(a, b) and matches <= columns and first <= end


def test_edited_copies_are_found_and_clean_text_is_not(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(30)]
    docs = []
    for i in range(300):
        body = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        if i < 90:
            passage = items[i % 30][1].split()
            if i >= 60:
                for _ in range(8):
                    passage[rng.randrange(40)] = rng.choice(words)
            at = rng.randrange(len(body))
            body[at:at] = [w.capitalize() + ("," if k % 9 == 8 else "") for k, w in enumerate(passage)]
        docs.append((i, " ".join(body)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.copies(d, decontam.benchmark_items(b)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i % 30) for i in range(90)}
    for r in got:
        if r.doc_id < 60:
            assert re.sub(r"\W+", " ", docs[r.doc_id][1][r.begin : r.end].lower()).split() == items[r.item_id][1].split()


def test_every_copy_of_the_small_tables_is_found(spark, rows):
    """All documents against all items, aligned whole: the join misses none, and finds no more."""
    from tests.conftest import SMALL

    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontam.copies(docs, decontam.benchmark_items(bench)).collect()}
    texts, items = docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect()
    numbers: dict[str, int] = {}
    words = lambda t: np.array([numbers.setdefault(c, len(numbers)) for c in (decontam.core(m) for m in (t or "").split()) if c], np.int64)
    own = [(r.item_id, words(r.text)) for r in items]
    want = set()
    for d in texts:
        ids = words(d.text)
        for name, item in own:
            if len(item) >= decontam.SEED and len(np.intersect1d(item, ids)) >= 0.4 * len(set(item.tolist())):
                _, matches, columns, _, _ = decontam.align(item, ids)
                if matches >= decontam.IDENTITY * columns and (matches >= decontam.COVERAGE * len(item) or matches >= decontam.MATCHED):
                    want.add((d.doc_id, name))
    assert got == want and want


def test_common_runs_are_no_seeds(spark):
    """A phrase with many neighbours is no seed where its item has others; a leaked run is, however often it occurs."""
    rows = [("t", 1, 0, i) for i in range(50)] + [("t", 2, 0, 7)] * 1000 + [("t", 2, 0, i) for i in range(30)] + [("t", 3, 0, i) for i in range(50)]
    seen = spark.createDataFrame(rows, "text_hash string, run long, at int, around long")
    items = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 0, 1), (3, 1, 0, 0)], "run long, item long, segment int, place int")
    assert {(r.run, r.item) for r in decontam.rare_runs(seen, items).collect()} == {(2, 0), (3, 1)}


def test_long_and_short_items(spark):
    """An item of several segments is one copy; segments in unrelated places are none; short items need an equal text."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(4000)]
    long = [rng.choice(words) for _ in range(700)]
    other = [rng.choice(words) for _ in range(400)]
    docs = [(1, " ".join(other[:200] + long + other[200:])), (2, " ".join(long[:20] + other + long[300:309])), (3, "two words"), (4, "two words more"), (5, " ".join(long[100:500]))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(10, " ".join(long)), (11, "Two, words!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.copies(d, decontam.benchmark_items(b)).collect()}
    assert set(got) == {(1, 10), (3, 11), (5, 10)} and got[1, 10].matched == 700
    assert docs[0][1][got[1, 10].begin : got[1, 10].end].split() == long


def test_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(2000)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    docs = [(i, " ".join([rng.choice(words) for _ in range(80)] + ([passage] if i % 3 == 0 else []))) for i in range(300)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.copies(d, decontam.benchmark_items(b)).collect()) == list(range(0, 300, 3))


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(7)
    field = toxicity.Field({"bad": 3.0, "evil": 2.0, "good": -1.0}, -1.5, rng.normal(size=2), rng.normal(size=(2, 2)), np.zeros(4))
    words = ["x", "bad", "y", "z", "evil", "good", "w", "bad"]
    logs = [field.bias + field.weights.get(w, 0.0) for w in words]

    def weight(path):
        return math.exp(field.start[path[0]] + sum(field.trans[a, b] for a, b in zip(path, path[1:])) + sum(e for s, e in zip(path, logs) if s))

    paths = list(itertools.product((0, 1), repeat=len(words)))
    total = sum(map(weight, paths))
    places = [i for i, w in enumerate(words) if w in field.weights]
    want = [sum(weight(p) for p in paths if p[i]) / total for i in places]
    assert field.marginals(places, [logs[i] for i in places], len(words)) == pytest.approx(want)
    counts, found = field.tagged(pa.array([" ".join(words), None, ""]))
    assert counts.tolist() == [8, 0, 0] and [k for k, _ in found[0]] == places


def test_toxicity_held_out(spark):
    got = queries.op10_crf_toxicity(spark, MIDDLE).toPandas()
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.toxic == held.predicted).mean() > 0.95
    assert all(zlib.crc32(str(d).encode()) % 5 == 0 for d in held.doc_id)
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").toPandas().set_index("doc_id").text
    spans = [docs[r.doc_id][s["begin"] : s["end"]].lower() for r in got.itertuples() for s in r.spans]
    assert any("idiot" in s for s in spans)


def test_grams_of_long_texts_in_pieces(monkeypatch):
    """Pieces of any length give the counts of the whole, also where they cut words, blanks and texts."""
    draw = random.Random(8)
    texts = ["".join(draw.choices("abÉ .,\n", k=draw.randint(0, 300))) for _ in range(20)] + [None, "", "   ", "x" * 50]
    whole = langid.ranked_grams(pa.array(texts))
    grouped = langid.ranked_grams(pa.array(texts), np.arange(len(texts)) % 3)
    for piece in (1, 2, 3, 7, 64, 1000):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert all((a == b).all() for a, b in zip(whole, langid.ranked_grams(pa.array(texts))))
        assert all((a == b).all() for a, b in zip(grouped, langid.ranked_grams(pa.array(texts), np.arange(len(texts)) % 3)))


def test_memory_of_a_very_long_text():
    """The n-grams of thirty million characters in a process that may grow by 700 MB; all at once took 90 bytes a character."""
    code = """
import resource, pyarrow as pa
from tremor.llm import langid
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
text = pa.array(["the quick brown fox, jumps over a lazy dog in 12 days. " * 550_000])
langid.ranked_grams(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 700


def test_transcripts_without_markers(spark):
    """Held-out conversations: of the turns without a marker, the roles and the starts that the model recovers, apart from those that a marker tells."""
    turns = spark.read.parquet(f"{MIDDLE}/conversations.parquet")
    got = queries.op3_hmm_transcripts(spark, MIDDLE).collect()
    held = [r for r in got if zlib.crc32(str(r.conv_id).encode()) % 4 == 2]
    marked = [r for r in held if r.marked]
    bare = [r for r in held if not r.marked]
    truth = {(r.conv_id, r.turn): r.role for r in turns.collect()}
    role = lambda rows: np.mean([r.role_pred == truth[r.conv_id, r.turn] for r in rows])
    assert len(got) == len(truth) and len(bare) > 30
    print(f"held out: {len(bare)} turns without a marker, role {role(bare):.2f}, start {np.mean([r.starts for r in bare]):.2f}")
    assert role(marked) > 0.99 and role(bare) > 0.55 and np.mean([r.starts for r in bare]) > 0.4
