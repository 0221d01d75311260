"""Token ids of a whole Arrow column by a ``tokenizers`` file, with each distinct word encoded once.

The supported fast layout is: NFC, white space to blanks, lower case; a split that
drops white space; byte-level BPE with word ends. There, chunks between blanks are
independent, and so are the words in a chunk, so a word's ids can be kept. Texts
with characters beyond U+024F (where normal forms and case rules begin to interact)
or with special-token markers, and other layouts, are encoded by the library whole.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat_text, values_of, words_of

#: The split pattern of the layout, and the bytes that byte-level BPE writes as themselves.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Texts for the library; a mark that ends a word before a blank, which is a token of its own.
ODD = "[^\\x00-\u012f\u0131-\u024f]|<\\|"
MARK = "([a-z0-9\u00e0-\u00f6\u00f8-\u00ff])([.,]) "

#: Chunks kept by a worker before its store starts anew, and the longest of them in characters; both bound its memory.
KEPT, KEPT_CHARS = 400_000, 256


class WordBpe:
    """``encode(texts)`` gives all ids and each text's first position."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": SPLIT} and spec["model"].get("end_of_word_suffix") == "</w>"
        self.words = regex.compile(SPLIT)
        others = iter(range(256, 512))
        self.byte_chars = {b: chr(b) if b in set(PRINTABLE) else chr(next(others)) for b in range(256)}
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.full.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        """By the library alone."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of lower-case chunks without white space; they are kept for later slices."""
        if len(self.kept) + len(chunks) > KEPT:
            self.kept = {"": b""}
        # Letters alone are one word, and ASCII letters stand for themselves.
        found = [[c] if c.isalpha() else self.words.findall(c) for c in chunks]
        new = list({w for ws in found for w in ws})
        mapped = " ".join([w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(self.byte_chars) for w in new])
        ids = np.array(self.bare.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
        raw, a, by_word = ids.tobytes(), 0, {}
        for w, b in zip(new, ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist(), strict=True):
            by_word[w] = raw[a:b]
            a = b
        out = [by_word[ws[0]] if len(ws) == 1 else b"".join([by_word[w] for w in ws]) for ws in found]
        if max(map(len, chunks), default=0) <= KEPT_CHARS:
            self.kept.update(zip(chunks, out))
        else:
            self.kept.update((c, ids) for c, ids in zip(chunks, out) if len(c) <= KEPT_CHARS)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (null: none); first positions, one more than texts."""
        texts = flat_text(texts)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.fast else np.ones(len(texts), bool)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        plain = pc.utf8_lower(pc.replace_substring(plain, "\n", " "))
        index, seen, first = words_of(pc.replace_substring_regex(plain, MARK, r"\1 \2 "))
        chunks = values_of(seen)
        parts = list(map(self.kept.get, chunks))
        if None in parts:
            missing = [i for i, p in enumerate(parts) if p is None]
            for i, p in zip(missing, self._learn([chunks[i] for i in missing])):
                parts[i] = p
        store = np.frombuffer(b"".join(parts), "<u4")
        lens = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        offs = np.cumsum(lens) - lens
        n = lens[index]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids, first = store[np.repeat(offs[index] - ends[:-1], n) + np.arange(ends[-1])], ends[first]
        if not odd.any():
            return ids, first
        rest = iter(self._whole([t for t, o in zip(texts.to_pylist(), odd) if o]))
        pieces = [np.frombuffer(next(rest), "<u4") if o else ids[a:b] for o, a, b in zip(odd, first, first[1:])]
        return np.concatenate([np.zeros(0, "<u4"), *pieces]), np.concatenate(([0], np.cumsum([len(x) for x in pieces], dtype=np.int64)))


@lru_cache(1)
def word_bpe(path: str) -> WordBpe:
    """The worker process's encoder; what it has kept serves its later tasks."""
    return WordBpe(path)
