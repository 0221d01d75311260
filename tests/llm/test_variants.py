"""Spelling variants against SQL, brute force and odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.helpers import canonical, duck
from tremor.llm import queries, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_near(words: list[str]) -> set[tuple[str, str]]:
    """By shared deletions, each confirmed."""
    by: dict[str, set[str]] = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(key, set()).add(w)
    return {(a, b) for group in by.values() for a in group for b in group if a < b and near(a, b)}


def pairs_of(spark, words: dict[str, int]) -> list[tuple]:
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    return [(r.a, r.a_n, r.b, r.b_n) for r in variants.one_edit_pairs(df).collect()]


def check_pairs(got: list[tuple], words: dict[str, int]) -> None:
    assert all(words[a] == n and words[b] == m for a, n, b, m in got)
    found = [tuple(sorted((a, b))) for a, _, b, _ in got]
    assert len(found) == len(set(found)) and set(found) == all_near(list(words))


@pytest.mark.parametrize("seed", range(4))
def test_pairs_are_all(spark, monkeypatch, seed):
    draw = random.Random(seed)
    alphabet = ["ab", "abc", "aé", "abcdefghijklmnop"][seed]
    words = {"".join(draw.choices(alphabet, k=draw.randint(1, 7))): draw.randint(1, 99) for _ in range(600)}
    words |= {"a" * n: 1 for n in range(1, 12)} | {"é" * 300 + c: 2 for c in "xyz"} | {"é" * 301: 2, "é" * 300: 2}
    check_pairs(pairs_of(spark, words), words)
    monkeypatch.setattr(variants, "RANGE_BYTES", 200)  # many ranges, whose nodes are shared
    monkeypatch.setattr(variants, "RANGE_SAMPLE", 4)
    check_pairs(pairs_of(spark, words), words)


def test_light_edges_are_few():
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("abcd", k=draw.randint(3, 9))) for _ in range(5000)})
    depth = Counter()
    for a, b, _, _, _ in variants.light_edges(words, {}):
        depth.update(range(a, b))
    assert max(depth.values()) <= np.log2(len(words)) + 1  # and one for a word's end


def test_checksums_add():
    draw, tables = random.Random(1), variants._shift_tables(20)
    for _ in range(200):
        a, b = draw.randbytes(draw.randint(0, 9)), draw.randbytes(draw.randint(0, 20))
        got = variants.checksums(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]), np.array([zlib.crc32(b)], np.uint32), tables)
        assert int(got[0]) == zlib.crc32(a + b)


def counted(rows: list[tuple]) -> Counter:
    """Plainly, by a loop over characters."""
    out: Counter = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if doc_id is not None and h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 6:
                    out[run] += 1
            run = ""
    return out


def test_words_are_counted(spark):
    long_ = "Ünïcödeß" * 40
    rows = [(i, f"Straßenbahn{i % 3} ÀÈ×÷ÿabc {long_} naïveté-naïveté {'abcdefg' * (i % 5)}") for i in range(400)] + [(7, None), (8, ""), (None, "without any ident"), (9, "endswithword"), (10, "beginsword"), (10, "beginsword"), (11, "x" * 70000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.word: r.n for r in variants.count_words(df).collect()} == dict(counted(rows))


def test_query_is_its_sql(spark):
    got = queries.op13_errata_variants(spark, SMALL)
    want = duck(SMALL).sql(queries.VARIANTS_SQL).df()
    assert canonical(got.toPandas()) == canonical(want) and len(want)


def test_forms_and_roots(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 9, "zzzzzy": 44, "qqqqqq": 5, "qqqqqa": 30, "qqqqqb": 30}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r for r in variants.forms(rows).collect()}
    assert len(got) == len(words)
    assert got["aaaaaa"].form == "aaaaab" and got["aaaaaa"].root == "aaabbb" and got["aaabbb"].root == "aaabbb"
    assert got["zzzzzz"].form is None and got["zzzzzz"].n_near == 1 and got["qqqqqq"].form == "qqqqqa" and got["qqqqqq"].form_n == 30


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "variant variant variant variant variant", None, None, 1), (3, "variant varient Variant VARIANT", "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("own") for n in ("word", "n", "root")})
    got = variants.spelling_variants(df).collect()
    assert [(r.word, r.root, r.n) for r in got] == [("variant", "variant", 8)]
    assert variants.spelling_variants(df.limit(0)).count() == 0
