"""Byte-level BPE with a public rank file.

A short word is held as a contiguous array of part ids with an array of the ranks
between neighbours: the least rank (the leftmost of equals) is searched, its
boundary deleted, and the two ranks beside it looked up again, until no pair
merges. Words of more than ``SHORT`` bytes go through a heap over linked parts,
whose time is n log n. A worker encodes a word once and then knows it by number,
so that a text is a gather over those numbers; the memory of known words is
bounded (``CACHE_WORDS``) and has no bearing on the result.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import regex

SHORT = 64
CACHE_WORDS = 250_000
NONE = 2**31 - 1
#: White space of the tokenizer's pattern (Unicode White_Space), spelled out as libraries differ on \x1c to \x1f.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
ASCII_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9\t\n\x0b\x0c\r ]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Numbers(dict):
    """Words to numbers; a word not met before gets the next one and is noted in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class RankBPE:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", f"[{SPACE}]+(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+"))
        self.byte_id = [self.ranks[bytes([i])] for i in range(256)]
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.reset()

    def reset(self) -> None:
        self.index = Numbers()
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _short(self, word: bytes) -> list[int]:
        """A contiguous array of part ids and one of the ranks between them."""
        get = self.pairs.get
        parts = [self.byte_id[x] for x in word]
        ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            parts[at] = least
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(least << 20 | parts[at + 1], NONE)
            if at:
                ranks[at - 1] = get(parts[at - 1] << 20 | least, NONE)
        return parts

    def _long(self, word: bytes) -> list[int]:
        """The same merges through a heap, for words whose array would be scanned too often."""
        ids = [self.byte_id[x] for x in word]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        pairs = self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = rank, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(rank << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] << 20 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x, y in zip(ids, alive) if y]

    def learn(self, words: list[str], start: int) -> None:
        """Encode words not met before, numbered from ``start``."""
        if start + len(words) > len(self.starts):
            more = np.zeros(max(len(self.starts), len(words)), np.int64)
            self.starts, self.sizes = np.concatenate([self.starts, more]), np.concatenate([self.sizes, more])
        ids: list[int] = []
        sizes = np.zeros(len(words), np.int64)
        for k, word in enumerate(words):
            b = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(b)
            parts = [whole] if whole is not None else self._short(b) if len(b) <= SHORT else self._long(b)
            ids += parts
            sizes[k] = len(parts)
        end = self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), end), np.int32)])
        self.flat[self.used : end] = ids
        self.starts[start : start + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[start : start + len(words)] = sizes
        self.used = end

    def words(self, text: str) -> list[str]:
        return ASCII_SPLIT.findall(text) if text.isascii() else self.split.findall(text)

    def _indexed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts, and how many words each text has."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        words, per = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = self.words(text)
            per[k] = len(found)
            words += found
        known = len(self.index)
        word = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self.learn(self.index.new, known)
            self.index.new.clear()
        return word, per

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offsets of each text (one more than texts)."""
        word, per = self._indexed(texts)
        n = self.sizes[word]
        end = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(self.starts[word] - end[:-1], n) + np.arange(int(end[-1]))]
        return ids, end[np.concatenate([[0], np.cumsum(per)])]

    def count_batch(self, texts: list[str]) -> np.ndarray:
        word, per = self._indexed(texts)
        bound = np.concatenate([[0], np.cumsum(self.sizes[word])])
        at = np.concatenate([[0], np.cumsum(per)])
        return bound[at[1:]] - bound[at[:-1]]


@lru_cache(maxsize=2)
def load(path: str) -> RankBPE:
    """One encoder per worker and rank file."""
    import public_tokenizers

    return RankBPE(path, public_tokenizers.PATTERN)
