"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are of documents, the field's labels are of tokens, so training first labels
tokens: a feature is toxic if it is far more frequent, by a likelihood ratio, in the
contexts (previous word, word, next word) of toxic documents than of clean ones;
counting distinct contexts keeps copies from counting twice. In toxic documents, tokens
with a toxic feature carry the label. The field is fitted to these by its likelihood.

Tokens without a known feature all have the same factors, so forward-backward crosses a
run of them by a power of one 2 x 2 matrix; this is exact, and a document costs as
many steps as it has tokens with features. Marginals are added up over these tokens;
a logistic model on that sum and the length, fitted on the same rows, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, fitted_in_task, flat_text, map_text, released, values_of, within_bytes, without, words_of
from .neardup import mixed

#: At most about so many labelled rows of each class are learnt from.
TRAIN_DOCS = 800
#: Their texts have at most about so many bytes; a document that would go beyond is not learnt from.
TRAIN_BYTES = 6 << 20
#: Least likelihood ratio of a feature, and of one that labels tokens; least ratio of its rates.
FEATURE_LLR, LABEL_LLR, LABEL_RATIO = 10.8, 30.0, 8.0
#: Steps and tokens of a sequence in training.
STEPS, WINDOW = 60, 128
PREFIXES = (4, 5)

_RUN = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile("[^ \t-\r]+")


def features(token: str) -> list[str]:
    """Of a lower-case token: its letter runs, and their prefixes."""
    found = []
    for run in _RUN.findall(token):
        found.append(run)
        found += [f"{run[:n]}*" for n in PREFIXES if len(run) >= n]
    return found


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``words_of`` the lower-case texts; tokens are runs between blanks and the controls 9 to 13."""
    flat = pc.replace_substring_regex(flat_text(texts), "[\t-\r]", " ")
    return words_of(pc.utf8_lower(flat))


@dataclass
class Field:
    """Weights of the field, of two states (0 clean, 1 toxic), and of the document model."""

    weights: dict[str, float]
    bias: float
    start: np.ndarray
    trans: np.ndarray
    doc: np.ndarray

    def __post_init__(self) -> None:
        self._known: dict[str, float | None] = {}
        step, own = np.exp(self.trans), np.array([1.0, math.exp(self.bias)])
        run = step * own
        half, root = (run[0, 0] + run[1, 1]) / 2, math.sqrt((run[0, 0] - run[1, 1]) ** 2 / 4 + run[0, 1] * run[1, 0])
        hi, lo = half + root, half - root
        self._step, self._own, self._first = step, own, np.exp(self.start)
        self._stay, self._fade, self._rate = (run - lo * np.eye(2)) / (hi - lo), (run - hi * np.eye(2)) / (hi - lo), lo / hi

    def _over(self, n: int) -> np.ndarray:
        """What ``n`` tokens without features multiply by, up to a factor."""
        return self._stay - self._rate**n * self._fade

    def emission(self, token: str) -> float | None:
        """Log factor of the toxic state; None without a known feature."""
        if token not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            own = [self.weights[f] for f in features(token) if f in self.weights]
            self._known[token] = min(30.0, self.bias + sum(own)) if own else None
        return self._known[token]

    def marginals(self, places: list[int], logs: list[float], n: int) -> list[float]:
        """Probability of the toxic state at ``places`` of ``n`` tokens, all others without features."""
        if not places:
            return []
        own = [np.array([1.0, math.exp(x)]) for x in logs]
        ahead, last = [], -1
        for p, e in zip(places, own):
            if not ahead:
                a = self._first * e if p == 0 else ((self._first * self._own) @ self._over(p - 1) @ self._step) * e
            else:
                a = (ahead[-1] @ self._over(p - last - 1) @ self._step) * e
            ahead.append(a / a.sum())
            last = p
        back, out = self._over(n - 1 - last) @ np.ones(2), []
        for i in range(len(places) - 1, -1, -1):
            both = ahead[i] * back
            out.append(float(both[1] / both.sum()))
            if i:
                back = self._over(places[i] - places[i - 1] - 1) @ (self._step @ (own[i] * back))
                back = back / back.sum()
        return out[::-1]

    def tagged(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, float]]]]:
        """Tokens of each text, and its (token, marginal) where features are known."""
        index, seen, first = tokens_of(texts)
        logs = [self.emission(t) for t in values_of(seen)]
        known = np.fromiter((x is not None for x in logs), bool, len(logs))
        at = np.flatnonzero(known[index]) if len(index) else np.zeros(0, np.int64)
        owner = np.searchsorted(first, at, side="right") - 1
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(texts))]
        cut = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i in np.unique(owner).tolist():
            mine = at[cut[i] : cut[i + 1]]
            places = (mine - first[i]).tolist()
            out[i] = list(zip(places, self.marginals(places, [logs[k] for k in index[mine]], int(first[i + 1] - first[i]))))
        return np.diff(first), out

    def score(self, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(counts, sums) @ self.doc, -500, 500)))


def _inputs(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Of the document model: 1, logs of the summed marginals and of the length, and their likeness to none."""
    return np.stack([np.ones(len(sums)), np.log(sums + 0.01), np.log(counts + 1.0), np.minimum(sums, 2.0)], axis=1)


def _ratio(t: float, c: float, all_t: float, all_c: float) -> float:
    """Likelihood ratio statistic of two rates being one."""
    p = (t + c) / (all_t + all_c)
    return 2 * sum(x * math.log(x / (p * n)) for x, n in ((t, all_t), (c, all_c)) if x)


def _selected(index: np.ndarray, first: np.ndarray, own: list[list[str]], toxic: list[int]) -> tuple[set[str], set[str]]:
    """Features more frequent in toxic documents, and those among them that label tokens.

    ``index`` is each token's place in the distinct ones, whose features are ``own``.
    """
    before, after = np.roll(index, 1), np.roll(index, -1)
    starts, ends = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
    before[starts], after[ends] = -1, -1
    triple = mixed(mixed(mixed(before.astype(np.uint64)) + index.astype(np.uint64)) + after.astype(np.uint64))
    label = np.repeat(np.array(toxic, np.int64), np.diff(first))
    counts: tuple[dict, dict] = (defaultdict(int), defaultdict(int))
    totals = [1, 1]
    for y in (0, 1):
        mine = np.flatnonzero(label == y)
        distinct = mine[np.unique(triple[mine], return_index=True)[1]]
        totals[y] = max(1, len(distinct))
        by_token = np.bincount(index[distinct], minlength=len(own))
        for k in np.flatnonzero(by_token).tolist():
            for f in own[k]:
                counts[y][f] += int(by_token[k])
    (all_c, all_t), wide, strict = totals, set(), set()
    for f, t in counts[1].items():
        c = counts[0].get(f, 0)
        if t * all_c > 2 * c * all_t and (g := _ratio(t, c, all_t, all_c)) >= FEATURE_LLR:
            wide.add(f)
            if g >= LABEL_LLR and t / all_t >= LABEL_RATIO * (c + 0.5) / all_c:
                strict.add(f)
    return wide, strict


def _fit_field(index: np.ndarray, first: np.ndarray, tokens: list[str], toxic: list[int]) -> Field:
    """The field of the documents ``tokens[index[first[d]:first[d + 1]]]``.

    Documents are cut into windows; windows of one length without a known feature are all
    alike and stand as one row with their number as its weight.
    """
    own = [features(t) for t in tokens]
    wide, strict = _selected(index, first, own, toxic)
    names = sorted(wide)
    number = {f: i for i, f in enumerate(names)}
    lists = [[number[f] for f in fs if f in number] for fs in own]
    marked = np.array([any(f in strict for f in fs) for fs in own], bool)
    sizes = np.array([len(x) for x in lists], np.int64)
    length = np.diff(first)
    doc = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(index)) - first[doc]
    per_doc = -(-length // WINDOW)
    base = np.cumsum(per_doc) - per_doc
    window = base[doc] + place // WINDOW
    n = np.bincount(window, minlength=int(per_doc.sum()))
    known = np.flatnonzero(sizes[index] > 0)
    held = np.unique(window[known])
    plain = np.bincount(np.delete(n, held), minlength=WINDOW + 1)
    row_of = np.full(len(n), -1)
    row_of[held] = np.arange(len(held))
    n = np.concatenate((n[held], np.flatnonzero(plain)))
    weight = np.concatenate((np.ones(len(held)), plain[plain > 0]))
    rows = len(n)
    at = row_of[window[known]] * WINDOW + place[known] % WINDOW
    owner = np.repeat(at, sizes[index[known]])
    feat = np.array([f for k in index[known].tolist() for f in lists[k]], np.int64)
    y = np.zeros((rows, WINDOW), np.int8)
    y.ravel()[at[marked[index[known]] & (np.array(toxic, np.int64)[doc[known]] == 1)]] = 1
    real = np.arange(WINDOW) < n[:, None]
    total = max(1.0, float((n * weight).sum()))
    pairs = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            pairs[a, b] = (((y[:, :-1] == a) & (y[:, 1:] == b) & real[:, 1:]) * weight[:, None]).sum()
    firsts = np.bincount(y[:, 0], weight, 2)[:2] if rows else np.zeros(2)
    marks = float(y.sum())
    by_feature = np.bincount(feat, y.ravel()[owner], len(names)) if len(feat) else np.zeros(len(names))
    w = np.zeros(len(names) + 7)  # features, bias, start, transitions
    w[len(names)] = math.log((marks + 1) / (total - marks + 1)) / 2
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        bias, start, trans = w[len(names)], w[len(names) + 1 : len(names) + 3], w[len(names) + 3 :].reshape(2, 2)
        emit = np.full(rows * WINDOW, bias)
        if len(owner):
            emit += np.bincount(owner, w[feat], rows * WINDOW)
        e = np.exp(np.clip(emit, -30, 30)).reshape(rows, WINDOW)
        psi = np.exp(trans)
        ahead = np.empty((WINDOW, rows, 2))
        a = np.stack([np.exp(start[0]) * np.ones(rows), np.exp(start[1]) * e[:, 0]], axis=1)
        ahead[0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, WINDOW):
            a = ahead[t - 1] @ psi
            a[:, 1] *= e[:, t]
            ahead[t] = np.where(real[:, t, None], a / a.sum(axis=1, keepdims=True), ahead[t - 1])
        back = np.ones((rows, 2))
        probs, expect = np.zeros((rows, WINDOW)), np.zeros((2, 2))
        for t in range(WINDOW - 1, -1, -1):
            both = ahead[t] * back
            probs[:, t] = both[:, 1] / both.sum(axis=1) * real[:, t]
            if t:
                inner = back.copy()
                inner[:, 1] *= e[:, t]
                joint = ahead[t - 1][:, :, None] * psi * inner[:, None, :]
                expect += (joint / joint.sum(axis=(1, 2), keepdims=True) * (real[:, t] * weight)[:, None, None]).sum(axis=0)
                new = inner @ psi.T
                back = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), back)
        grad = np.zeros_like(w)
        if len(feat):
            grad[: len(names)] = by_feature - np.bincount(feat, probs.ravel()[owner], len(names))
        grad[len(names)] = marks - float(probs.sum(axis=1) @ weight)
        began = float(probs[:, 0] @ weight)
        grad[len(names) + 1 : len(names) + 3] = firsts - np.array([weight.sum() - began, began])
        grad[len(names) + 3 :] = (pairs - expect).ravel()
        grad = grad / total - 1e-6 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        w = w + 0.25 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    k = len(names)
    return Field(dict(zip(names, w[:k].tolist())), float(w[k]), w[k + 1 : k + 3], w[k + 3 :].reshape(2, 2), np.zeros(4))


def fit(texts: list[str], toxic: list[int], rates: tuple[float, float] = (1.0, 1.0)) -> Field:
    """A field and its document model; ``rates`` are the rows that one sample row of each class stands for."""
    if not texts:
        return Field({}, -5.0, np.zeros(2), np.zeros((2, 2)), np.array([-5.0, 0.0, 0.0, 0.0]))
    index, seen, first = tokens_of(pa.array(texts, pa.large_string()))
    field = _fit_field(index.astype(np.int64), first, seen.to_pylist(), toxic)
    counts, found = field.tagged(pa.array(texts, pa.large_string()))
    x, y = _inputs(counts, np.array([sum(p for _, p in f) for f in found])), np.array(toxic, float)
    weight = np.where(y == 1, rates[1], rates[0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(hess, x.T @ (weight * (y - p)) - 0.05 * w)
    field.doc = w
    return field


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS) -> Field:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic): about ``rows`` rows of each class at most.

    Rows with a null id, label or text teach nothing; an id with several labels is toxic if one is.
    Equal rows count once.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = None
    for y in (0, 1):
        part = bounded_sample(known.filter(F.col("toxic") == y), "doc_id", rows, counts.get(y, 0))
        sample = part if sample is None else sample.union(part)
    # About 2 * ``rows`` ids, whatever the size of the tables.
    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    rows_ = cut(rows_, "labelled")

    def fit_rows(got: list[tuple]) -> Field:
        drawn = [max(1, sum(r[2] == y for r in got)) for y in (0, 1)]
        return fit([r[1] for r in got], [r[2] for r in got], tuple(counts.get(y, 0) / drawn[y] for y in (0, 1)))

    field = fitted_in_task(within_bytes(rows_, "doc_id", TRAIN_BYTES).select("doc_id", "text", "toxic"), fit_rows)  # ``TRAIN_BYTES`` at most
    released(rows_)
    return field


def score(df: DataFrame, field: Field) -> DataFrame:
    """``df`` (with ``text``) and ``score``, ``predicted``, ``spans`` (character offsets and marginals of toxic tokens).

    Columns of these names are replaced. Null and empty texts have no tokens and get the score of length 0.
    """
    rows, added = without(df, "score", "predicted", "spans"), ["score", "predicted", "spans"]
    held = df.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def make():
        model = held.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            counts, found = model.tagged(part.column("text"))
            scores = model.score(counts, np.array([sum(p for _, p in f) for f in found]))
            spans = []
            for i, f in enumerate(found):
                marked, own = {k: p for k, p in f if p >= 0.5}, []
                if marked:
                    for k, m in enumerate(_TOKEN.finditer(part.column("text")[i].as_py())):
                        if k in marked:
                            if own and k - 1 in marked:
                                own[-1] |= {"end": m.end(), "p": max(own[-1]["p"], marked[k])}
                            else:
                                own.append({"begin": m.start(), "end": m.end(), "p": marked[k]})
                spans.append(own)
            return pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, span)], [*part.schema.names, *added])

        return work

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return map_text(rows, f"{schema}, score double, predicted int, spans array<struct<begin: long, end: long, p: double>>", make)


def keep_clean(df: DataFrame, field: Field) -> DataFrame:
    """Rows of ``df`` that are not predicted toxic, as they are: null ids and repeated rows too, null and empty texts by the score of length 0."""
    return score(df, field).filter("predicted = 0").select(*[F.col(f"`{c}`") for c in df.columns])
