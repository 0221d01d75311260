"""Each operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tremor.llm import decontam, hilbert, idstore, langid, neardup, packing, spotsigs, toxicity, transcripts, wordpiece
from tremor.llm.common import new_folder
from tremor.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "many words in one very long text of some thousand words " * 3000
ODD = [
    (1, "The cat sat on the mat and the dog ran away from the house", "en", "a", 5),
    (1, "The cat sat on the mat and the dog ran away from the house", "en", "a", 5),
    (2, "The cat sat on the mat and the dog ran away from the house", "en", "b", 5),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \n\t ", "en", "a", 0),
    (6, LONG, "en", "a", len(LONG)),
    (7, "12 345 !!! ...", None, "a", 3),
    (None, "a row without an id that has a few words", "en", None, 1),
    (8, "Ünïcode 你好 İstanbul <|endoftext|> Σας \x00 nul", "de", "a", 1),
    (9, "x" * 70000, "de", "c", 70000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df, *names):
    return df.withColumns({n: F.lit("own") for n in names})


def test_langid(spark, odd, empty):
    profiles = langid.learn(odd)
    got = langid.identify(clash(odd, "Lang_Pred", "score"), profiles).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 3, 4, 5, 7)] == ["en", "und", "und", "und", "und"]
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.learn(empty)).collect()} == {"und"}
    kept = langid.keep_known_languages(odd, profiles)
    assert kept.columns == odd.columns and {3, 4, 5, 7}.isdisjoint({r.doc_id for r in kept.collect()})


def test_spotsigs(spark, odd, empty):
    got = spotsigs.fingerprints(clash(odd, "fingerprint")).collect()
    assert len(got) == len(ODD)
    one = [r for r in got if r.doc_id in (1, 2)]
    assert len({r.fingerprint for r in one}) == 1 and sorted(r.near_next for r in one)[-1] == 1.0
    assert [r.n_chars for r in got if r.doc_id == 3] == [0] and all(0 <= r.near_edited <= 1 for r in got)
    assert spotsigs.fingerprints(empty).count() == 0
    lone = spotsigs.fingerprints(odd.filter("doc_id = 6")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    members, pairs = spotsigs.near_pairs(odd)
    assert {r.class_id for r in members.filter("doc_id IN (1, 2)").collect()} == {1} and pairs.count() == 0
    assert spotsigs.near_pairs(empty)[0].count() == 0


def test_transcripts(spark):
    schema = "conv_id long, turn long, role string, text string, rendered string"
    rows = [(1, 0, "user", "Hi?", "x"), (1, 1, "assistant", "Hello\nthere", "x"), (1, 1, "assistant", "Hello\nthere", "x"), (1, None, None, None, None), (None, 0, "user", "", "x"), (2, 0, "robot", "User: what?", "x"), (3, 0, "user", "long line\n" * 5000, "x")]
    df = spark.createDataFrame(rows, schema)
    model = transcripts.learn(df)
    got = transcripts.parse(df, model).collect()
    assert len(got) == len(rows) and all(r.rendered.startswith(f"<|{r.role_pred}|>\n") for r in got)
    assert [r.role_pred for r in got if r.conv_id == 2] == ["user"]
    assert transcripts.parse(df.limit(0), transcripts.learn(df.limit(0))).count() == 0


def test_neardup(spark, odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(clash(odd, "kept", "component_id")).collect()}
    assert {(1, 10, 1, True), (2, 10, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (7, 1, 7, True), (9, 1, 9, True)} <= got
    assert any(d is None and c is None and k for d, _, c, k in got)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, None]


def test_neardup_keeps_documents_that_share_an_id(spark):
    """Two texts under one id are two documents; repeats and copies under other ids go; any column names do."""
    words = [f"w{i} x{i * 7 % 13}" for i in range(60)]
    one, two = " ".join(words[:30]), " ".join(words[30:])
    rows = [(5, one, "a"), (5, two, "b"), (5, two, "b"), (7, one, "c"), (8, two.upper(), "d"), (9, "other words here", "e"), (None, one, "f"), (None, one, "f"), (6, None, "g"), (6, None, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string").withColumns({n: F.lit("own") for n in ("component", "n", "least", "Id")})
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text, r._row) for r in kept.collect()), key=str)
    want = [(5, one, "a"), (5, two, "b"), (9, "other words here", "e"), (None, one, "f"), (None, one, "f"), (6, None, "g"), (6, None, "g")]
    assert got == sorted(want, key=str)


def test_stages_keep_odd_rows(spark, odd):
    """Each filtering stage returns rows of its input as they are, the clean ones all of them."""
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "nothing of this is anywhere in any of these texts at all")], "item_id long, text string")
    more = clash(odd, "_row", "component", "n", "text_hash", "_contaminated")
    for out in (toxicity.keep_clean(more, toxicity.learn(more, labels)), decontam.drop_contaminated(more, decontam.benchmark_items(bench))):
        assert out.columns == more.columns and out.exceptAll(more).isEmpty() and more.exceptAll(out).isEmpty()


def test_hilbert(spark, odd, empty):
    got = hilbert.shard_documents(clash(odd, "shard", "curve"), 8).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, sizes.values())) == len(ODD) and all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert {r.size for r in got if r.doc_id in (3, 4)} == {1} and {r.text_crc32 for r in got if r.doc_id in (3, 4)} == {0}
    assert hilbert.shard_documents(empty).count() == 0
    for df in (odd, clash(odd, "Shard", "_x", "_at"), empty):
        folder = new_folder(spark, "shards")
        name = hilbert.write_shards(df, folder, 4)
        back = spark.read.parquet(folder) if df is not empty else df.withColumn(name, F.lit(0))
        assert name == ("shard_1" if "Shard" in df.columns else "shard")
        plain = back.select(*df.columns)
        assert plain.exceptAll(df).isEmpty() and df.exceptAll(plain).isEmpty()


def test_cells():
    """Cells of sizes change at the powers of the root of 2."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = [r[0] for r in spark.createDataFrame([(None,), (0,), (1,), (2,), (3,), (4,), (5,), (6,), (8,), (1 << 40,)], "v long").select(hilbert.by_log(F.col("v"))).collect()]
    assert got == [0, 0, 0, 2, 3, 4, 4, 5, 6, 31]


def test_packing(spark, odd, empty):
    got = packing.pack_documents(clash(odd, "piece", "offset"), PATH, 2048, 0).collect()
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in used.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= 2048
    assert {r.length for r in got if r.doc_id in (3, 4, 5)} == {1} and len([r for r in got if r.doc_id == 1]) == 2
    assert packing.pack_documents(empty, PATH).count() == 0
    full = spark.createDataFrame([(1, 2048)] * 5 + [(2, 100)] * 3 + [(3, 1948)] * 3, "_rank long, length long").withColumn("_group", F.lit("own"))
    placed = packing.pack(full).collect()
    assert {r._group for r in placed} == {"own"} and len({r.sequence_id for r in placed if r.length == 2048}) == 5 and len({r.sequence_id for r in placed}) == 8


def test_wordpiece(spark, odd, empty):
    got = {r.doc_id: r for r in wordpiece.count_tokens(clash(odd, "n_tokens"), PATH).collect()}
    assert got[3].n_tokens == got[4].n_tokens == got[5].n_tokens == 0 and got[9].longest_word == 70000
    assert wordpiece.count_tokens(empty, PATH).count() == 0


def test_idstore(spark, odd, empty):
    from tokenizers import Tokenizer

    folder = new_folder(spark, "ids")
    idstore.write_store(clash(odd, "start"), folder, PATH)
    got = sorted(idstore.read_store(spark, folder).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    full = Tokenizer.from_file(PATH)
    for doc, text, *_ in ODD:
        if doc is not None:
            ids = [*full.encode(text or "", add_special_tokens=False).ids, 2]
            assert idstore.read_document(spark, folder, doc) == ids
            raw = b"".join(i.to_bytes(4, "little") for i in ids)
            assert {(r.n_tokens, r.ids_crc32) for r in got if r.doc_id == doc} == {(len(ids), zlib.crc32(raw))}
    assert idstore.read_document(spark, folder, 77) is None
    folder = new_folder(spark, "ids")
    idstore.write_store(empty, folder, PATH)
    assert idstore.read_store(spark, folder).count() == 0


def test_decontam(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran away"), (2, None), (3, ""), (4, "two words"), (None, "many words in one very long text of some thousand words"), (1, "the cat sat on the mat and the dog ran away")], "item_id long, text string")
    blocks = decontam.benchmark_items(bench)
    got = decontam.copies(clash(odd, "item_id", "score"), blocks).collect()
    assert {r.doc_id for r in got} == {1, 2, 6} and all(r.begin == 0 for r in got if r.doc_id != 6)
    kept = decontam.drop_contaminated(odd, blocks)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    assert decontam.copies(odd, decontam.benchmark_items(bench.limit(0))).count() == 0
    assert decontam.copies(empty, decontam.benchmark_items(bench)).count() == 0


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(1, 10)] + [(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    field = toxicity.learn(odd, labels)
    got = toxicity.score(clash(odd, "Score", "spans"), field).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    nothing = toxicity.learn(empty, labels.limit(0))
    assert toxicity.score(odd, nothing).filter("predicted = 1").count() == 0
    assert toxicity.score(empty, field).count() == 0
    assert toxicity.keep_clean(odd, nothing).columns == odd.columns
