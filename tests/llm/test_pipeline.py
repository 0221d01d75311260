"""The pipeline keeps what it should, stage by stage."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tremor.llm import langid, neardup
from tests.conftest import MIDDLE


def test_stages(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, MIDDLE), name)
        assert out.columns == docs.columns and out.select("doc_id").distinct().count() == out.count()
        assert out.join(docs, "doc_id", "left_anti").isEmpty()
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4] > 0.6 * counts[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, MIDDLE)
    assert packed.select("doc_id").distinct().count() == counts[4]


def test_no_rows(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, MIDDLE), name)
        assert docs.count() == 0


def test_near_duplicate_stage_links_from_four_fifths(spark):
    """The stage against all pairs: one document of each group linked at 0.80, where 0.85 would leave more."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 160))]
        for edits in (0, 1, 2, 3, 4):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = neardup.shingle_sets(pa.array(texts))

    def groups(percent):
        root = list(range(len(texts)))
        for i, j in itertools.combinations(range(len(texts)), 2):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
        return set(root)

    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    assert kept == groups(80) and len(groups(80)) < len(groups(85))


def test_language_stage_rejects_other_latin_text(spark):
    """Gibberish, base64 and languages that were not learnt go; labelled documents of all lengths stay."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    foreign = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 10))) for _ in range(n)) for n in (5, 10, 30, 300, 3000)]
    foreign.append("".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(2000)))
    foreign.append("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem")
    foreign.append("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto")
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    profiles = langid.learn(docs)
    rows = [(-1 - i, t, "en", "web", len(t)) for i, t in enumerate(foreign)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, more, MIDDLE).select("doc_id").collect()}
    assert not {d for d in kept if d < 0}
    assert kept == {r.doc_id for r in docs.filter("text RLIKE '[a-zA-Z]'").select("doc_id").collect()}
    assert kept == {r.doc_id for r in langid.keep_known_languages(more, profiles).collect()}
