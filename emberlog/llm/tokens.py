"""Token ids of many texts through the tokenizers library, with words that were seen before taken from a cache.

A text is cut at spaces where that can't change its ids. Words are told apart
by 64-bit rolling hashes in numpy, many documents at a time; distinct words
that the cache lacks go through the library, and the rest is a gather.
"""

from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer

from emberlog.llm.textops import Rolling, Texts

#: Words in a worker's cache (some 40 bytes each); beyond that it starts anew.
CACHE_WORDS = 800_000
#: Words of letters that go through the library as one text.
_TOGETHER = 256
_ENCODERS: dict[tuple[str, bool], Encoder] = {}
#: A space beside other white space (or white space outside ASCII anywhere): such texts are encoded whole.
_ODD_SPACE = re.compile(
    rb"[\t-\r\x1c-\x20] |[ ][\t-\r\x1c-\x20]|\xc2[\x85\xa0]|\xe1[\x9a\xa0]|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf"
)
_GAP = np.ones(256, bool)
_GAP[[0x20, 0x0A]] = False


class Encoder:
    """spaces: whether a space is part of the word after it (byte-level vocabularies) or has no id at all, like the case of A-Z (those in lower case)."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.spaces = spaces
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that begin a word (with its space) or end one: where ids of joined words are cut.
        self.marks = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marks[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if spaces else t.endswith("</w>"))]] = True
        self.points = {46: self._whole([b"."])[0], 44: self._whole([b","])[0]}
        self._empty()

    def _empty(self) -> None:
        self.hashes, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0

    @staticmethod
    def of(path: str, spaces: bool) -> Encoder:
        if (path, spaces) not in _ENCODERS:
            _ENCODERS[path, spaces] = Encoder(path, spaces)
        return _ENCODERS[path, spaces]

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _each(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; words of ASCII letters, one piece for any of the patterns, go together in texts of many."""
        out: dict[bytes, bytes] = {}
        first = 1 if self.spaces else 0
        plain = [w for w in words if w[first:].isalpha() and (not first or w[0] == 32)]
        lots = [plain[k : k + _TOGETHER] for k in range(0, len(plain), _TOGETHER)]
        for lot, raw in zip(lots, self._whole([(b"" if first else b" ").join(lot) for lot in lots]), strict=True):
            at = np.flatnonzero(self.marks[np.frombuffer(raw, "<u4")])
            if len(at) == len(lot):
                cut = (4 * (np.append(at, len(raw) // 4) if first else np.concatenate([[0], at + 1]))).tolist()
                out.update((w, raw[cut[i] : cut[i + 1]]) for i, w in enumerate(lot))
        rest = [w for w in words if w not in out]
        for k in range(0, len(rest), 1 << 13):
            part = rest[k : k + (1 << 13)]
            out.update(zip(part, self._whole(part), strict=True))
        return [out[w] for w in words]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes in the cache, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def _learn(self, raw: bytes, rolling: Rolling, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Adds words (ascending hashes) to the cache. One that ends in a full stop or comma after a letter is the word before it and that mark."""
        data = np.frombuffer(raw, np.uint8)
        last, before = data[end - 1], data[np.maximum(end - 2, start)] | 32
        pointed = ((last == 46) | (last == 44)) & (before >= 97) & (before <= 122) & (end - start > 2)
        stem_end = end - pointed
        known = np.full(len(start), -1)
        known[pointed] = self._find(rolling.of(start[pointed], stem_end[pointed]))
        lower = (lambda w: w) if self.spaces else bytes.lower
        stems = [lower(raw[s:e]) if k < 0 else None for s, e, k in zip(start.tolist(), stem_end.tolist(), known.tolist(), strict=True)]
        todo = list({w for w in stems if w is not None})
        found = dict(zip(todo, self._each(todo), strict=True))
        parts = []
        for w, k, p, mark in zip(stems, known.tolist(), pointed.tolist(), last.tolist(), strict=True):
            ids = found[w] if w is not None else self.ids[self.start[k] : self.start[k] + self.size[k]].tobytes()
            parts.append(ids + self.points[mark] if p else ids)
        size = np.array([len(p) // 4 for p in parts], np.int64)
        new = np.frombuffer(b"".join(parts), "<u4")
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(new)), "<u4")])
        self.ids[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.hashes, hashes)
        self.start = np.insert(self.start, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.used += len(new)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts, as arrays of unsigned 32-bit integers."""
        odd = [k for k, t in enumerate(texts) if _ODD_SPACE.search(t)] if self.spaces else []
        whole = dict(zip(odd, self._whole([texts[k] for k in odd]), strict=True))
        docs = Texts([b"" if k in whole else t for k, t in enumerate(texts)])
        if len(self.hashes) > CACHE_WORDS:
            self._empty()
        if self.spaces:  # a word begins at each space and at the start of each text
            begins = docs.data == 32
            begins[docs.bounds[:-1]] = True
            start = np.flatnonzero(begins)
            end = np.append(start[1:], len(docs.data))
            end = end - np.isin(end, docs.bounds, assume_unique=True)
            start, end = start[end > start], end[end > start]
        else:
            start, end = docs.spans(_GAP)
        rolling = Rolling(docs.data, lower=not self.spaces)
        hashes, at, which = np.unique(rolling.of(start, end), return_index=True, return_inverse=True)
        new = self._find(hashes) < 0
        if new.any():
            self._learn(docs.data.tobytes(), rolling, start[at[new]], end[at[new]], hashes[new])
        place = self._find(hashes)[which]
        size = self.size[place]
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.start[place] - before, size) + np.arange(size.sum())]
        bounds = np.append(before, size.sum())[np.searchsorted(start, docs.bounds)].tolist()
        return [np.frombuffer(whole[k], "<u4") if k in whole else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
