"""The filter audit against SQL, brute force and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import MIDDLE
from tests.helpers import canonical, duck
from tremor.llm import filter_audit, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_mask(text: str | None) -> int:
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * len(text)) << 2 | bool(re.search("[#$%&*|]", text)) << 3


def test_query_is_its_sql(spark):
    got = queries.op12_filter_audit(spark, MIDDLE)
    want = duck(MIDDLE).sql(queries.AUDIT_SQL).df()
    assert canonical(got.toPandas()) == canonical(want) and len(want)


def test_text_failures():
    draw = random.Random(2)
    texts = [None, "", " ", "\x1c\x85 a\tb", "É" * 99 + "AA", "é" * 97 + "AAA", "a b a b", "x|y"]
    texts += [" ".join(draw.choices(["one", "Two", "drei ", "\n", "vierß#", "Ünf"], [5, 1, 3, 1, 0.01, 1], k=draw.randint(1, 400))) for _ in range(200)]
    assert filter_audit.text_failures(pa.array(texts)).tolist() == [plain_mask(t) for t in texts]


@pytest.fixture(params=["one range", "many ranges"])
def ranges(request, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_BYTES", 32 << 20 if request.param == "one range" else 300)


def test_duplicates_across_ranges(spark, ranges):
    """Groups of equal texts that span many ranges, among them a hot one, with null and repeated ids."""
    draw = random.Random(3)
    rows = [(draw.randint(0, 300), draw.choice(["hot text", "hot text", "hot text", None, "", f"text {i % 40}"]), "en", draw.choice(["a", "b", None, ""]), 1) for i in range(900)]
    rows += [(None, "hot text", "en", "a", 1), (None, "only without id", "en", "a", 1), (None, "only without id", "en", "a", 1), (5, "x" * 70000, None, "b", 1), (6, "x" * 70000, None, "b", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("own") for n in ("print", "part", "mask", "range")}).repartition(7)
    least: dict[str, int] = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    want = sorted((i if i is not None else -1, s or "", plain_mask(t) | (16 if i is not None and i > least[t or ""] else 0)) for i, t, _, s, _ in rows)
    got = filter_audit.failure_masks(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.part, r["mask"]) for r in got) == want


def test_orders_by_applying_filters(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["p", "q", None]), draw.randrange(32)) for i in range(300)]
    labels = [(i, draw.randint(0, 1), draw.randint(0, 1)) for i in range(0, 300, 2)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    counts = filter_audit.mask_counts(spark.createDataFrame([(s or "", i, m) for i, s, m in rows], "part string, doc_id long, mask int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want, shapley = {}, {}
    for part in ("p", "q", ""):
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = [(i, m) for i, s, m in rows if (s or "") == part], []
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                out = [(i, m) for i, m in left if m & bit]
                alone = sum(m == bit for i, s, m in rows if (s or "") == part)
                left = [(i, m) for i, m in left if not m & bit]
                want[part, order, step] = (len(left), len(out), sum(bool(m & bit) for _, m in gone), alone, sum(i in good for i, _ in out), sum(i in toxic for i, _ in out), letter)
                gone += out
                shapley[part, letter] = shapley.get((part, letter), 0) + len(out)
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.interactions(counts).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want[k][:6] and r.shapley == shapley[k[0], want[k][6]]


@pytest.mark.parametrize("limit", [1, 60, 1 << 20])
def test_slices_of_a_batch(limit):
    """Rows that reach a task in one batch but are handled in several slices, groups across them."""
    rows = sorted((hashlib.sha256(t.encode()).digest(), t, i) for i in range(200) for t in [f"text {i % 7} of some length"])
    batch = pa.RecordBatch.from_arrays([pa.array([i for _, _, i in rows], pa.int64()), pa.array(["a"] * 200), pa.array([t for _, t, _ in rows]), pa.array([p for p, _, _ in rows], pa.binary())], ["doc_id", "part", "text", "print"])
    out = pa.Table.from_batches(list(filter_audit.judged(3, iter([batch.slice(0, 50), batch.slice(50)]), limit))).to_pylist()
    body, last = out[:-1], out[-1]
    assert [r["doc_id"] for r in body] == [i for _, _, i in rows]
    heads = [r for r in body if not r["mask"] & 16]
    assert sorted(r["doc_id"] for r in heads) == list(range(7)) and [r["print"] is not None for r in heads] == [True] + [False] * 6
    assert last["ided"] and last["print"] == rows[-1][0] and last["length"] == len(rows[-1][1]) and last["range"] == 3


def test_empty(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    got = filter_audit.audit(one, labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and {r.removed for r in got if r.filter_order[0] == "A" and r.step == 1} == {1}
