"""Byte-pair encodings read from public tokenizer files; nothing is trained here.

``ByteBpe`` gives ids of a byte-level file, ``MergeCounter`` only counts tokens of a file whose
words end in a suffix. Both are built once per Python worker and file.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np


def tokenizer_path(path: str | None, default: str) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(default)


@cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class ByteBpe:
    """Ids of a byte-level ``tokenizers`` file, without added special tokens.

    If the ids of the file are its merge ranks (checked on loading) the ranks are handed to
    ``tiktoken``, which computes the same merges faster; texts that hold a special string, and
    files of another kind, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_chars())}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        plain = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and spec["normalizer"] is None and spec["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
        }
        self.fast = None
        if plain:
            ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.fast = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


class MergeCounter:
    """Token counts by heap-and-linked-list merging: symbols at first, minus merges made.

    Each word's symbols are a doubly linked list; a heap holds the adjacent pairs that have a
    rank. The lowest rank (leftmost among equals) is popped; a stale entry is skipped, a live one
    joins its two symbols and pushes the two new neighbours. No ids are put out. Words repeat, so
    their counts are kept in a table of bounded size that is emptied when full.
    """

    CACHE = 600_000
    #: Longest word whose count is kept; longer ones are counted anew each time.
    CACHE_CHARS = 64

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.symbol = {t: i for i, t in enumerate(vocab)}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge[self.symbol[a], self.symbol[b]] = (rank, self.symbol[a + b])
        chars = byte_chars()
        # a byte without a symbol of its own is left out by the library, as the file has no unknown token
        self.inner = [self.symbol.get(c) for c in chars]
        self.last = [self.symbol.get(c + self.suffix) for c in chars]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: _Known = _Known(self)

    def count_word(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return n
        merge = self.merge
        heap = []
        for k in range(n - 1):
            m = merge.get((ids[k], ids[k + 1]))
            if m:
                heap.append((m[0], k, ids[k], ids[k + 1], m[1]))
        if not heap:
            return n
        heapify(heap)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = 0
        while heap:
            _, k, a, b, new = heappop(heap)
            if ids[k] != a:  # k was merged away or has changed
                continue
            j = right[k]
            if j >= n or ids[j] != b:
                continue
            merges += 1
            ids[k], ids[j] = new, -1
            r = right[k] = right[j]
            if r < n:
                left[r] = k
                if m := merge.get((new, ids[r])):
                    heappush(heap, (m[0], k, new, ids[r], m[1]))
            p = left[k]
            if p >= 0 and (m := merge.get((ids[p], new))):
                heappush(heap, (m[0], p, ids[p], new, m[1]))
        return n - merges

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-casing here knows no final sigma
        found = self.words.findall(text.lower())
        if len(self.known) > self.CACHE:
            self.known.clear()
        return sum(map(self.known.__getitem__, found))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(self._plain(p) for p in pieces if p)


class _Known(dict):
    def __init__(self, counter: MergeCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count_word(word)
        if len(word) <= MergeCounter.CACHE_CHARS:
            self[word] = n
        return n


@cache
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)
