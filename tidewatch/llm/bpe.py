"""Exact byte-pair encoding as a prefix recurrence over vectorised edges.

For every prefix of a word, the last token of its encoding is the one token ending there that
is compatible with the last token of the prefix before it (two tokens are compatible if encoding
their concatenation gives just these two). So the encoding of all prefixes of all words at hand
follows from the edges (vocabulary strings inside the words) in one sweep over end positions.
"""

from __future__ import annotations

import numpy as np

INF = np.int64(2**62)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words longer than this are relaxed edge by edge, others in step with each other.
STEP_LEN = 96


class Lookup:
    """A static hash table from 64-bit keys to int32 values (-1 where missing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, int(len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        h = self._hash(keys.astype(np.uint64))
        order = np.argsort(h, kind="stable")
        self.keys, self.values = keys.astype(np.uint64)[order], values.astype(np.int32)[order]
        self.start = np.searchsorted(h[order], np.arange((1 << bits) + 1)).astype(np.int32)
        self.most = int(np.diff(self.start).max(initial=0))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        out = np.full(len(keys), -1, np.int32)
        h = self._hash(keys)
        at, end = self.start[h], self.start[h + 1]
        left = np.flatnonzero(at < end)
        at, end, want = at[left], end[left], keys[left]
        while left.size:
            hit = self.keys[at] == want
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (at + 1 < end)
            left, at, end, want = left[on], at[on] + 1, end[on], want[on]
        return out


def slice_keys(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of a symbol string (one more than symbols) and the powers of the base."""
    n = len(symbols)
    powers = np.ones(n + 1, np.uint64)
    powers[1:] = BASE
    powers = np.multiply.accumulate(powers)
    # h[j] = sum of s_i * BASE**(j-1-i): summed with inverse powers, as the base is odd
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    inv = np.ones(n + 1, np.uint64)
    inv[1:] = inverse
    inv = np.multiply.accumulate(inv)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * inv[1:], out=sums[1:])
    return sums * powers, powers


def key_of(symbols: list[int]) -> int:
    h = 0
    for s in symbols:
        h = (h * int(BASE) + (s + 1) * 1) % 2**64
    return h


class Model:
    """Merge ranks, splits and pairs of a vocabulary, and strings to look edges up by.

    ``rank``: when a token is made (-1: a first symbol); ``left``/``right``: what it is made of.
    ``pairs``: (a, b) -> token. ``strings``: token -> symbols; ``ends``: tokens that only end words.
    """

    def __init__(self, rank, left, right, pairs: dict[tuple[int, int], int], strings: dict[int, list[int]], ends: set[int] = frozenset()) -> None:
        self.rank, self.left, self.right = (np.asarray(x, np.int64) for x in (rank, left, right))
        keys = np.fromiter(((a << 32) | b for a, b in pairs), np.uint64, len(pairs))
        self.pairs = Lookup(keys, np.fromiter(pairs.values(), np.int32, len(pairs)))
        inner = [t for t in strings if t not in ends]
        self.longest = max(map(len, strings.values()))
        self.inner = Lookup(np.array([key_of(strings[t]) for t in inner], np.uint64), np.array(inner, np.int32))
        self.ending = Lookup(np.array([key_of(strings[t]) for t in ends], np.uint64), np.array(list(ends), np.int32)) if ends else None
        self.lengths = np.zeros(len(self.rank), np.int32)
        for t, s in strings.items():
            self.lengths[t] = len(s)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay as they are side by side; a < 0: nothing before."""
        ok = np.ones(len(a), bool)
        live = np.flatnonzero(a >= 0)
        a, b = a[live].astype(np.int64), b[live].astype(np.int64)
        limit = np.full(len(live), INF)
        while live.size:
            made = self.pairs.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            when = np.where(made >= 0, 2 * self.rank[made], INF)
            bad = when < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[on], a[on], b[on], ra[on], rb[on]
            undo_a = ra > rb
            limit = np.where(undo_a, 2 * ra, 2 * rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def edges(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of all vocabulary strings inside the words that begin at ``starts``."""
        n = len(symbols)
        word_end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
        sums, powers = slice_keys(symbols)
        at = np.arange(n)
        out = []
        for length in range(1, self.longest + 1):
            at = at[at + length <= word_end[at]]
            if not at.size:
                break
            key = sums[at + length] - sums[at] * powers[length]
            if self.ending is None:
                token = self.inner.get(key)
            else:
                token = np.where(at + length == word_end[at], self.ending.get(key), self.inner.get(key))
            hit = token >= 0
            out.append((at[hit], at[hit] + length, token[hit]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def relax(self, n: int, starts: np.ndarray, start: np.ndarray, end: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last, count) at each of the n + 1 boundaries; a word's first boundary stands for none.

        ``last[i]`` and ``count[i]`` belong to the prefix that ends before symbol i; for the
        boundary between two words they are the whole left word's. Where nothing fits, count is -1.
        """
        sizes = np.diff(np.append(starts, n))
        first = np.repeat(starts, sizes)
        offset = end - first[start]
        last, count = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        long = sizes[np.searchsorted(starts, start, side="right") - 1] > STEP_LEN
        order = np.lexsort((offset,)) if not long.any() else np.flatnonzero(~long)[np.argsort(offset[~long], kind="stable")]
        s, e, t, o = start[order], end[order], token[order], offset[order]
        fresh = s == first[s]
        for lo, hi in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.searchsorted(o, np.arange(1, int(o.max(initial=0)) + 2))), strict=True):
            if lo == hi:
                continue
            before = np.where(fresh[lo:hi], -1, last[s[lo:hi]])
            open_ = fresh[lo:hi] | (before >= 0)
            ok = open_ & self.compatible(before, t[lo:hi])
            won = e[lo:hi][ok]
            last[won] = t[lo:hi][ok]
            count[won] = np.where(fresh[lo:hi][ok], 0, count[s[lo:hi][ok]]) + 1
        if long.any():
            memo: dict[tuple[int, int], bool] = {}
            own = np.flatnonzero(long)
            own = own[np.lexsort((start[own], end[own]))]
            for a, z, k, f in zip(start[own].tolist(), end[own].tolist(), token[own].tolist(), first[start[own]].tolist(), strict=True):
                before = -1 if a == f else int(last[a])
                if a != f and before < 0:
                    continue
                pair = (before, k)
                if pair not in memo:
                    memo[pair] = bool(self.compatible(np.array([before]), np.array([k]))[0])
                if memo[pair]:
                    last[z], count[z] = k, (0 if a == f else count[a]) + 1
        return last, count

    def tokens(self, last: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many each word has), walked back from the ends."""
        at, word = ends.copy(), np.arange(len(ends))
        found, whose = [], []
        while at.size:
            t = last[at]
            found.append(t)
            whose.append(word)
            at = at - self.lengths[t]
            on = at > starts[word]
            at, word = at[on], word[on]
        ids, whose = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(whose or [np.zeros(0, np.int64)])
        turn = np.arange(len(ids))
        order = np.lexsort((-turn, whose))
        return ids[order], np.bincount(whose, minlength=len(ends))


def byte_level() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def from_json(path: str) -> Model:
    """The model of a tokenizers file of kind BPE over byte-level characters."""
    import json

    with open(path, encoding="utf-8") as f:
        body = json.load(f)
    model, byte = body["model"], byte_level()
    vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
    special = {t["id"] for t in body["added_tokens"]}
    size = max(vocab.values()) + 1
    rank, left, right = np.full(size, -1), np.arange(size), np.arange(size)
    pairs = {}
    for i, m in enumerate(model["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        made = vocab[a + b]
        rank[made], left[made], right[made] = i, vocab[a], vocab[b]
        pairs[vocab[a], vocab[b]] = made
    strings, ends = {}, set()
    for s, t in vocab.items():
        if t in special:
            continue
        if suffix and s.endswith(suffix) and s != suffix:
            ends.add(t)
            s = s[: -len(suffix)]
        strings[t] = [byte[c] for c in s]
    return Model(rank, left, right, pairs, strings, ends)
