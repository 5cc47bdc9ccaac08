"""BPE encoding and decoding, and the token ids of whole tables.

``Encoder`` merges by a contiguous rank array: a word's part boundaries and the rank of
each adjacent pair lie in two short lists; the least rank is found by scanning, its
boundary is deleted, and only the ranks of the two neighbours are looked up again.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata

import numpy as np
import regex

from kvlog.llm.text import _SEP, hashes, strings

# The library's own threads would only compete with Spark's tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Ranks above all merges.
_NONE = 1 << 60
#: Words that a worker remembers before it forgets all of them: for the library's ids,
#: and with the texts that the own encoder returns.
CACHE, TEXTS = 1_200_000, 400_000
#: Bytes of a word past which scanning for the least rank costs more than a heap.
LONG = 256

# The contractions and classes of the public word-splitting patterns.
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼½¾"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable ASCII and Latin-1 for themselves, the rest from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Words of a byte-level BPE vocabulary with word ends (file of the tokenizers
    library: lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.bytes = byte_alphabet()
        self.split = regex.compile(rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[str, str, int]] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word of the byte alphabet."""
        if len(word) > LONG:
            return self._merge_long(word)
        parts = [*word[:-1], word[-1] + self.end]
        # bound: where each part begins; near: the rank of each part with the next.
        symbols, ranks = parts, self.ranks
        near = [ranks.get(pair, _NONE) for pair in zip(symbols, symbols[1:])]
        while near:
            low = min(near)
            if low == _NONE:
                break
            i = near.index(low)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del near[i]
            if i:
                near[i - 1] = ranks.get((symbols[i - 1], symbols[i]), _NONE)
            if i < len(near):
                near[i] = ranks.get((symbols[i], symbols[i + 1]), _NONE)
        return [self.vocab[s] for s in symbols]

    def _merge_long(self, word: str) -> list[int]:
        """The same merges in the same order, the least rank taken from a heap."""
        symbols, ranks = [*word[:-1], word[-1] + self.end], self.ranks
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        near = [ranks.get(pair, _NONE) for pair in zip(symbols, symbols[1:])] + [_NONE]
        heap = [(r, i) for i, r in enumerate(near) if r != _NONE]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            rank, i = heapq.heappop(heap)
            if gone[i] or near[i] != rank:
                continue
            j = right[i]
            symbols[i] += symbols[j]
            gone[j], right[i] = True, right[j]
            if right[i] < n:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0:
                    near[a] = ranks.get((symbols[a], symbols[right[a]]), _NONE) if right[a] < n else _NONE
                    if near[a] != _NONE:
                        heapq.heappush(heap, (near[a], a))
        return [self.vocab[s] for s, out in zip(symbols, gone) if not out]

    def piece(self, text: str) -> tuple[str, str, int]:
        """Of a text without white space: its ids and its decoded tokens, each joined by
        one space, and how many there are."""
        ids: list[int] = []
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        for word in self.split.findall(text):
            ids += self.merge("".join([self.bytes[b] for b in word.encode()]))
        return " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]), len(ids)

    def run(self, text: str) -> list[tuple[str, str, int]]:
        known = self.known
        out = []
        for word in split_space(text):
            hit = known.get(word)
            if hit is None:
                hit = self.piece(word)
                if len(word) <= LONG:
                    if len(known) >= TEXTS:
                        known.clear()
                    known[word] = hit
            out.append(hit)
        return out

    def encode(self, text: str) -> list[tuple[str, str, int]]:
        """One entry for each stretch between white space: ids, decoded, count."""
        if self.marks is None or "<" not in text or not self.marks.search(text):
            return self.run(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self.run(text[at : m.start()])
            out.append((str(self.special[m[0]]), m[0], 1))
            at = m.end()
        return out + self.run(text[at:])

    def ids(self, text: str) -> list[int]:
        return [int(i) for part in self.encode(text) for i in part[0].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.names[i] for i in ids if i in self.names])


_CONTROL = re.compile("[\x1c-\x1f]")
_BLANK = re.compile(f"[{_SPACE}]+")


def split_space(text: str) -> list[str]:
    """Stretches between white space as the vocabularies know it; Python's own split
    also breaks at four control characters."""
    return text.split() if not _CONTROL.search(text) else [x for x in _BLANK.split(text) if x]


class Library:
    """Ids by the tokenizers library for many texts at once, each word encoded once.

    Words are stretches that the library's own splitting never joins: between white
    space for the vocabulary with word ends, from one space or line end to the next for
    the byte-level one. A text in which that does not hold, or that spells out a special
    token, is one word. Words are known by 64-bit hashes of their bytes; a worker
    remembers a bounded number of them. New plain words go to the library many in one
    text; the ids show where each ends (a word end) or begins (a leading space or line end).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        suffix = model.get("end_of_word_suffix")
        self.spaced = not suffix
        self.edge = np.zeros(max(model["vocab"].values()) + 1 + len(self.special), bool)
        lead = byte_alphabet()[0x20] + byte_alphabet()[0x0A]
        self.edge[[i for t, i in model["vocab"].items() if (t[0] in lead if self.spaced else t.endswith(suffix))]] = True
        self.forget()

    def forget(self) -> None:
        # Hashes in order, and each one's slot: a dict would take ten times the memory.
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, at: np.ndarray, hashes: np.ndarray, blobs: list[bytes]) -> np.ndarray:
        """Remember new words, which belong before ``at`` among those known; their slots."""
        ids = np.frombuffer(b"".join(blobs), "<u4")
        n, many = len(self.keys), len(blobs)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + many > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        length = np.fromiter(map(len, blobs), np.int64, many) >> 2
        self.pool[self.used : self.used + len(ids)] = ids
        self.length[n : n + many] = length
        self.begin[n : n + many] = self.used + np.cumsum(length) - length
        self.used += len(ids)
        slots = np.arange(n, n + many, dtype=np.int32)
        self.keys, self.slot = np.insert(self.keys, at, hashes), np.insert(self.slot, at, slots)
        return slots

    def _many(self, words: list[str]) -> list[bytes]:
        """Ids of words that stay apart for the library when put side by side."""
        out: list[bytes] = []
        sep = "" if self.spaced else " "
        texts = [sep.join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        for e in self.tok.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.edge[ids])
            cuts = [*(4 * at).tolist(), 4 * len(ids)] if self.spaced else [0, *(4 * (at + 1)).tolist()]
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(out) != len(words):
            raise AssertionError("words were not split as expected")
        return out

    def _learn(self, words: list[str]) -> list[bytes]:
        # A word and the marks after it are encoded apart, in either vocabulary.
        match = (_SPACED if self.spaced else _BARE).fullmatch
        found = list(map(match, words))
        stems = list({m[1] for m in found if m})
        ids = dict(zip(stems, self._many(stems)))
        rest = list({m[2] for m in found if m}.union([w for w, m in zip(words, found) if not m]))
        for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False)):
            ids[w] = np.array(e.ids, "<u4").tobytes()
        return [ids[m[1]] + ids[m[2]] if m else ids[w] for w, m in zip(words, found)]

    def _cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each word; no word spans texts."""
        n = len(data)
        own = np.zeros(n + 1, bool)
        own[off] = True
        raw, odd = data.tobytes(), []
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                odd.append(at)
                at = raw.find(s, at + 1)
        if self.spaced:
            space = data == 32
            white = _white(data)
            begin = own[:-1] | space
            if n > 2:
                line = np.flatnonzero((data[1:-1] == 10) & ~white[:-2] & ~white[2:]) + 1
                begin[line[~own[line] & ~own[line + 1]]] = True
            # A run of white space is cut as the library does only if a space ends or begins it.
            bad = np.flatnonzero(space[1:-1] & white[:-2] & white[2:]) + 1 if n > 2 else np.zeros(0, np.int64)
            odd += bad[~own[bad] & ~own[bad + 1]].tolist()
        else:
            white = _SEP[data]
            before = own[:-1].copy()
            before[1:] |= white[:-1]
            begin = ~white & before
            after = own[1:].copy()
            after[:-1] |= white[1:]
            last = ~white & after
        whole = np.unique(np.searchsorted(off, odd, "right") - 1) if odd else []
        for i in whole:
            begin[off[i] : off[i + 1]] = False
            begin[off[i]] = True
            if not self.spaced:
                last[off[i] : off[i + 1]] = False
                last[off[i + 1] - 1] = True
        start = np.flatnonzero(begin)
        return start, (np.append(start[1:], n) if self.spaced else np.flatnonzero(last) + 1)

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin."""
        data, off = strings(col)
        start, end = self._cut(data, off)
        known, first, at = np.unique(hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.forget()
        place = np.searchsorted(self.keys, known)
        slot, there = np.zeros(len(known), np.int64), place < len(self.keys)
        there[there] = self.keys[place[there]] == known[there]
        slot[there] = self.slot[place[there]]
        new = np.flatnonzero(~there)
        if len(new):
            raw = data.tobytes()
            lo, hi = start[first[new]].tolist(), end[first[new]].tolist()
            slot[new] = self._add(place[new], known[new], self._learn([raw[a:b].decode() for a, b in zip(lo, hi)]))
        slots = slot[at]
        length = self.length[slots]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.begin[slots] - (ends - length), length) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(start, off)]


#: Words of letters that lower case and normalisation keep whole, and marks after them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACED = re.compile(f"([ \n][{_LETTERS}]+)([.,!?;:()*#$%&]*)")
_BARE = re.compile(f"([{_LETTERS}]+)([.,!?;:()*#$%&]*)")
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80", *(bytes([0xE2, 0x80, i]) for i in range(0x80, 0x8B)))


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white-space characters."""
    out = _SEP[data]
    lead = {b: np.flatnonzero(data == b) for b in {seq[0] for seq in _WIDE}}
    for seq in _WIDE:
        if len(data) >= len(seq):
            at = lead[seq[0]]
            at = at[at <= len(data) - len(seq)]
            for j in range(1, len(seq)):
                at = at[data[at + j] == seq[j]]
            for j in range(len(seq)):
                out[at + j] = True
    return out


_made: dict[tuple[type, str], object] = {}


def made(kind: type, path: str):
    """One encoder for each worker process, with the words it remembers."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]
