"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie. Where a word leaves the trie, a failure link leads to the node
of what is left after the longest matches so far are taken off, and the number of these
is known beforehand for each link; so a word is read once, character by character, and
its token count comes out without a piece being built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, map_text, values_of, words_of
from .wordbpe import PRINTABLE

#: Ends a word; vocabulary entries for the end of a word carry it last.
END = "\0"
#: Chunks whose counts a worker keeps, and the longest of them in characters; both bound its memory.
KEPT, KEPT_CHARS = 400_000, 256


class LongestMatch:
    """Token counts of words; a word that the vocabulary cannot cut counts as one unknown token."""

    def __init__(self, vocabulary: Iterable[str]) -> None:
        go: list[dict[str, int]] = [{}]
        depth_word: list[bool] = [False]
        for entry in vocabulary:
            node = 0
            for c in entry:
                if c not in go[node]:
                    go[node][c] = len(go)
                    go.append({})
                    depth_word.append(False)
                node = go[node][c]
            depth_word[node] = node != 0
        fail, pops = [-1] * len(go), [0] * len(go)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in go[u].items():
                queue.append(v)
                if depth_word[v]:
                    fail[v], pops[v] = 0, 1  # the node's own string is the longest match
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and c not in go[z]:
                    n += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = go[z][c], n
        self.go, self.fail, self.pops = go, fail, pops

    def count(self, word: str) -> int:
        """Tokens of ``word``, which ends with ``END`` if the vocabulary says so; 1 if it cannot be cut, 0 if empty."""
        if not word:
            return 0
        go, fail, pops, u, n = self.go, self.fail, self.pops, 0, 0
        for c in word:
            while c not in go[u]:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
            u = go[u][c]
        while u:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


def greedy_count(word: str, vocabulary: set[str]) -> int:
    """The plain definition: take the longest entry at the front until nothing is left."""
    n, at = 0, 0
    while at < len(word):
        stop = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), 0)
        if not stop:
            return 1
        n, at = n + 1, stop
    return n


def end_marked_vocabulary(path: str) -> list[str]:
    """Entries of a ``tokenizers`` BPE file with word ends (``</w>``) written as ``END``; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return [v.removesuffix("</w>") + END if v.endswith("</w>") else v for v in spec["model"]["vocab"] if v not in special]


def byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte."""
    others = iter(range(256, 512))
    return {b: chr(b) if b in set(PRINTABLE) else chr(next(others)) for b in range(256)}


@lru_cache(1)
def _counter(path: str) -> Callable[[str], tuple[int, int, int]]:
    """The worker process's (words, tokens, longest word) of a chunk; what it has kept serves its later tasks."""
    automaton, chars = LongestMatch(end_marked_vocabulary(path)), byte_chars()
    cuts = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    kept: dict[str, tuple[int, int, int]] = {}

    def of(chunk: str) -> tuple[int, int, int]:
        if (found := kept.get(chunk)) is None:
            words = cuts.findall(chunk)
            pieces = sum(automaton.count(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(chars) + END) for w in words)
            found = len(words), pieces, max(map(len, words), default=0)
            if len(chunk) <= KEPT_CHARS:
                if len(kept) > KEPT:
                    kept.clear()
                kept[chunk] = found
        return found

    return of


def count_tokens(df: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_words, n_tokens, longest_word) of every row of ``df`` (doc_id, text).

    Words are runs of letters, single digits, or runs of other marks, in lower case; null
    and blank texts have none. Each row counts for itself, repeated rows and null ids too;
    the longest match is unique, so there are no ties.
    """

    def make():
        of = _counter(path)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            flat = pc.replace_substring_regex(pc.utf8_lower(flat_text(part.column("text"))), "[\t-\r]", " ")
            index, seen, first = words_of(flat)
            each = np.array([of(c) for c in values_of(seen)] or [(0, 0, 0)], np.int64)
            own = each[index] if len(index) else np.zeros((0, 3), np.int64)
            sums = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(own[:, :2], axis=0)))
            longest = [int(own[a:b, 2].max()) if b > a else 0 for a, b in zip(first, first[1:])]
            n = sums[first[1:]] - sums[first[:-1]]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(longest, pa.int64())], ["doc_id", "n_words", "n_tokens", "longest_word"])

        return work

    return map_text(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_words long, n_tokens long, longest_word long", make)
