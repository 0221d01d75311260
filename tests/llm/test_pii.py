"""Patterns against plain ones, message passing against enumeration, and what the field adds."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import MIDDLE
from tremor.llm import pii, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """The contract's patterns as they are written."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == 3 or plain_luhn(digits)):
                out.append((kind, *m.span()))
    return out


def in_points(text: str) -> list[tuple[int, int, int]]:
    raw = text.encode()
    found, _ = pii.base_spans(raw)
    at = pii._points(raw, [p for _, a, b in found for p in (a, b)])
    return [(k, at[a], at[b]) for k, a, b in found]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="+@.-() 0145é aZ_%,", max_size=40) | st.lists(st.sampled_from(["a@b.c", "@", ".d", "1.2.3.4", "256", ".", "4381893557741609", "+1 (743) 555-3824", " ", "-", "é", "x", "+", "7", "\n"]), max_size=14).map("".join))
def test_patterns_are_the_plain_ones(text):
    assert in_points(text) == plain_spans(text)


def test_patterns_take_linear_time():
    for text in (b"x" * 3_000_000 + b"@", b"1" * 3_000_000, b"1." * 1_000_000, b"1 " * 1_000_000, b"+1" + b"(" * 2_000_000, b"a@b" * 500_000):
        pii.base_spans(text)


def exact(g, own, step, skip):
    """Marginals of all labellings."""
    n, out = len(own), np.zeros_like(own)
    for y in itertools.product(range(7), repeat=n):
        p = np.prod([own[i, y[i]] for i in range(n)])
        for i in range(n):
            p *= step[y[g.left[i]], y[i]] if g.left[i] >= 0 else step[0, y[i]]
            p *= step[y[i], 0] if g.right[i] < 0 else 1
            p *= skip[y[g.back[i]], y[i]] if g.back[i] >= 0 else 1
        for i in range(n):
            out[i, y[i]] += p
    return out / out.sum(axis=1, keepdims=True)


def graph(text: str):
    raw = text.encode()
    return pii.graph_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


@pytest.mark.parametrize("text, loop", [("a1 b2 and c3 then d4", False), ("a1 x a1 y a1 z b2", False), ("a1 b2 x b2 c3", False), ("a1 b2 x a1 b2", True)])
def test_messages(text, loop):
    rng = np.random.default_rng(1)
    g = graph(text)
    own = rng.uniform(0.2, 3, (len(g.words), 7))
    step = np.exp(rng.normal(0, 0.6, (7, 7))) * pii.ALLOWED
    skip = np.exp(0.8 * pii.SAME + 0.4 * pii.OUTSIDE)
    got, _ = pii.pass_messages(g, own, step, skip, 24)
    want = exact(g, own, step, skip)
    assert np.abs(got - want).max() < (0.05 if loop else 1e-9)


def test_graph():
    g = graph("call 555-1234, x 99 100 y +1 555-1234 z")
    assert g.words == [b"555-1234,", b"99", b"100", b"+1", b"555-1234"]
    assert g.left.tolist() == [-1, -1, 1, -1, 3] and g.ahead.tolist() == [4, -1, -1, -1, -1] and g.back.tolist() == [-1, -1, -1, -1, 0]
    two = pii.graph_of(np.frombuffer(b"a1b2 b2", np.uint8), np.array([0, 0, 2, 4, 7]))
    assert two.doc.tolist() == [1, 2, 3] and two.words == [b"a1", b"b2", b"b2"] and (two.back == -1).all()  # texts share nothing


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(spark.read.parquet(f"{MIDDLE}/documents.parquet"))


def found(spark, model, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.pii for r in sorted(pii.find(df, model).collect(), key=lambda r: r.doc_id)]


def test_field_adds_what_patterns_miss(spark, model):
    """Two cards in a row, a card after a phone, and a phone without its prefix that stands in full elsewhere."""
    a, b, phone = "4381893557741609", "4465758382889437", "+1 (743) 555-3824"
    texts = [f"pay {a} {b} now", f"call {phone} {a} now", f"call {phone} or, much later in the text, (743) 555-3824 again", "in 2024 there were 12 of 345 and 1,000", "version 3.11 of 4 by @home"]
    got = [[(s.kind, texts[i][s.start : s.end]) for s in spans if not s.base] for i, spans in enumerate(found(spark, model, texts))]
    assert got[0] == [("card", a), ("card", b)]
    assert got[1] == [("phone", phone), ("card", a)]
    assert got[2] == [("phone", "(743) 555-3824")]
    assert got[3] == got[4] == []


def test_skip_carries_a_label(model):
    """The chance that a bare number is a phone rises with a like number elsewhere, and not with an unlike one."""
    def chance(text):
        g = graph(text)
        belief = model.beliefs(g)
        return belief[-1, 5] + belief[-1, 6]

    alone, like, unlike = (chance(t) for t in ("or 555-3824", "call +1 (743) 555-3824 now, or 555-3824", "call +1 (743) 555-3825 now, or 555-3824"))
    assert like > 2 * alone and like > unlike


def test_held_out_agreement(spark, model):
    """On documents that the fit may not have seen the field alone finds what the patterns find."""
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").filter("text RLIKE '[0-9@]'").collect()
    held = [r.text for r in rows if r.doc_id % 2]
    fitted = pii.fit([r.text.encode() for r in rows if not r.doc_id % 2])
    right = total = 0
    for text in held:
        raw = text.encode()
        g = graph(text)
        want = pii._labels(g, [raw])
        states = fitted.beliefs(g).argmax(axis=1) if len(g.doc) else want
        right += int(((states == want) & (want >= 0)).sum())
        total += int((want >= 0).sum())
    assert total and right / total > 0.97


def test_query(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = queries.op11_skip_chain_pii(spark, MIDDLE).collect()
    assert len(got) == len(rows) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
    for r in got:
        want = plain_spans(rows[r.doc_id] or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in want) for i in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(text.split(",") if text else []) <= set(spans) and len(spans) == len(want) + r.n_added
        key = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert key == sorted(key)
        if not re.search("[0-9@]", rows[r.doc_id] or ""):
            assert not spans


def test_odd_rows(spark, model):
    long_ = "words é and 12 then " * 30_000 + "a@b.cd " * 1000
    rows = [(1, None, None, None, None), (1, "", "en", "a", 0), (None, "to a@b.cd", "en", None, 1), (2, "é a@b.cd", "en", "a", 1), (2, "é a@b.cd", "en", "a", 1), (3, long_, "en", "a", 1), (4, "7" * 70000, "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pii", F.lit("own")).withColumn("spans", F.lit("own")).repartition(3)
    out = pii.find(df, model)
    got = pii.digest(out).collect()
    assert len(got) == len(rows) and sorted(r.n_email for r in got) == [0, 0, 0, 1, 1, 1, 1000]
    assert [r.spans for r in got if r.doc_id == 2] == ["email:2:8"] * 2
    assert sorted(r.text for r in pii.masked(out.filter("doc_id = 2")).collect()) == ["é [email]"] * 2
    none = df.limit(0)
    assert pii.digest(pii.find(none, pii.learn(none))).count() == 0
    assert {r.n_email for r in pii.digest(pii.find(df.filter("doc_id = 2"), pii.learn(none))).collect()} == {1}
