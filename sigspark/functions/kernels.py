"""Windows of whole batches of sequences in NumPy: hashing and exact counting without a row for each window.

A batch is one array of bytes and the places where its sequences begin. Windows are named by the byte they begin at.
The hash families are those of functions/hashing.py, bit for bit.
"""

from __future__ import annotations

import math

import numpy as np

#: Windows that are hashed at once: some arrays of that many numbers stay in a core's cache.
STEP = 1 << 15
#: Bytes that may be read past the last window.
PAD = 16
_S = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_T = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def padded(data) -> np.ndarray:
    """Bytes with PAD zeros after them."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(len(raw) + PAD, np.uint8)
    out[: len(raw)] = raw
    return out


def _load(buf: np.ndarray, at: np.ndarray | slice, offset: int, kind: str) -> np.ndarray:
    """The little-endian numbers `offset` bytes after each place."""
    width = np.dtype(kind).itemsize
    if isinstance(at, slice):
        return np.ndarray((at.stop - at.start,), kind, buf.data, at.start + offset, (1,)).astype(kind[1:], copy=True)
    return np.ndarray((len(buf) - width + 1,), kind, buf.data, 0, (1,))[at + offset].astype(kind[1:], copy=False)


def _md5_words(buf: np.ndarray, at: np.ndarray | slice, k: int, prefix: bytes) -> list[list]:
    """Blocks of 16 words of the padded messages prefix + window: arrays, or ints where all are equal."""
    n = len(prefix) + k
    total = -(-(n + 9) // 64) * 64
    tail = {n: 0x80} | {total - 8 + i: b for i, b in enumerate((8 * n).to_bytes(8, "little"))}
    words: list = []
    for w in range(0, total, 4):
        if len(prefix) <= w and w + 4 <= n:
            words.append(_load(buf, at, w - len(prefix), "<u4"))
            continue
        fixed, moving = 0, None
        for i in range(4):
            if w + i < len(prefix):
                fixed |= prefix[w + i] << 8 * i
            elif w + i < n:
                byte = _load(buf, at, w + i - len(prefix), "|u1").astype(np.uint32) << np.uint32(8 * i)
                moving = byte if moving is None else moving | byte
            else:
                fixed |= tail.get(w + i, 0) << 8 * i
        words.append(fixed if moving is None else moving | np.uint32(fixed))
    return [words[i : i + 16] for i in range(0, len(words), 16)]


def _md5_60(buf: np.ndarray, at: np.ndarray | slice, n: int, k: int, j: int) -> np.ndarray:
    first = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    state = [np.full(n, x, np.uint32) for x in first]
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for words in _md5_words(buf, at, k, b"%d:" % j):
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
                w = i
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
                w = (5 * i + 1) % 16
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
                w = (3 * i + 5) % 16
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
                w = 7 * i % 16
            a += f
            word = words[w]
            if isinstance(word, int):
                a += np.uint32((_T[i] + word) & 0xFFFFFFFF)
            else:
                a += np.uint32(_T[i])
                a += word
            s = _S[i // 16][i % 4]
            np.left_shift(a, np.uint32(s), out=f)
            np.right_shift(a, np.uint32(32 - s), out=g)
            np.bitwise_or(f, g, out=a)
            a += b
            a, b, c, d = d, a, b, c
        for old, new in zip(state, (a, b, c, d)):
            old += new
    high, low = state[0].byteswap().astype(np.uint64), state[1].byteswap().astype(np.uint64)
    return (high << np.uint64(28)) | (low >> np.uint64(4))


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xxh64(buf: np.ndarray, at: np.ndarray | slice, n: int, k: int, j: int) -> np.ndarray:
    mask = (1 << 64) - 1
    load = lambda o, kind: _load(buf, at, o, kind).astype(np.uint64, copy=False)
    mixed = lambda h, x: _rotate(h + x * _P2, 31) * _P1
    i = 0
    if k >= 32:
        v = [np.full(n, (j + x) & mask, np.uint64) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        while i + 32 <= k:
            v = [mixed(x, load(i + 8 * s, "<u8")) for s, x in enumerate(v)]
            i += 32
        h = _rotate(v[0], 1) + _rotate(v[1], 7) + _rotate(v[2], 12) + _rotate(v[3], 18)
        for x in v:
            h = (h ^ mixed(np.uint64(0), x)) * _P1 + _P4
    else:
        h = np.full(n, (j + int(_P5)) & mask, np.uint64)
    h = h + np.uint64(k)
    while i + 8 <= k:
        h = _rotate(h ^ mixed(np.uint64(0), load(i, "<u8")), 27) * _P1 + _P4
        i += 8
    if i + 4 <= k:
        h = _rotate(h ^ (load(i, "<u4") * _P1), 23) * _P2 + _P3
        i += 4
    while i < k:
        h = _rotate(h ^ (load(i, "|u1") * _P5), 11) * _P1
        i += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


FAMILIES = {"md5_60": _md5_60, "xxh64": _xxh64}


def hashes(buf: np.ndarray, k: int, j: int, family: str, places: np.ndarray | None = None) -> np.ndarray:
    """Hash j of the windows at these places of padded bytes, by default of all, as unsigned 64-bit numbers."""
    run = FAMILIES[family]
    total = max(0, len(buf) - PAD - k + 1) if places is None else len(places)
    out = np.empty(total, np.uint64)
    for a in range(0, total, STEP):
        b = min(total, a + STEP)
        out[a:b] = run(buf, slice(a, b) if places is None else places[a:b], b - a, k, j)
    return out


def modulo(h: np.ndarray, m: int) -> np.ndarray:
    """h % m; the division by one number is vectorized, the remainder isn't."""
    m = np.uint64(m)
    return (h - h // m * m).astype(np.int64)


def words_of(buf: np.ndarray, k: int, places: np.ndarray | slice) -> list[np.ndarray]:
    """The windows as 64-bit numbers that together hold every byte; equal ones have equal numbers. Short windows are shifted."""
    if k < 8:
        return [_load(buf, places, 0, "<u8") & np.uint64((1 << 8 * k) - 1)]
    return [_load(buf, places, o, "<u8") for o in sorted({*range(0, k - 7, 8), k - 8})]


def mixed(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of windows given as numbers; for one word it is a bijection."""
    h = words[0] * _P1
    h ^= h >> np.uint64(32)
    for w in words[1:]:
        h += w
        h *= _P2
        h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


#: Windows that are sorted at once; more of them are taken in shares by their hash.
SHARE = 1 << 21


def grouped(buf: np.ndarray, k: int, places: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): windows in an order that has equal ones side by side, and where in it a new one begins. Exact: windows of one hash are compared byte by byte."""
    words = words_of(buf, k, places)
    h = mixed(words)
    order = np.argsort(h)
    h = h[order]
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    if len(words) > 1:
        at = np.flatnonzero(~first)
        left, right = order[at - 1], order[at]
        if any((w[left] != w[right]).any() for w in words):  # two windows of one hash
            order = np.lexsort(words)
            first[1:] = np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in words])
    return order, first


def _chosen(buf: np.ndarray, k: int, places: np.ndarray, share: int, shares: int) -> np.ndarray:
    """Where in places the windows of a share are, by hash."""
    found = []
    for a in range(0, len(places), SHARE):
        h = mixed(words_of(buf, k, places[a : a + SHARE]))
        found.append(np.flatnonzero((h >> np.uint64(8)) % np.uint64(shares) == np.uint64(share)) + a)
    return np.concatenate(found)


def shares(buf: np.ndarray, k: int, places: np.ndarray) -> list[np.ndarray] | map:
    """Indices into places, in parts of about SHARE so that equal windows are in one part."""
    n = -(-len(places) // SHARE)
    return [np.arange(len(places))] if n <= 1 else map(lambda i: _chosen(buf, k, places, i, n), range(n))


def first_places(buf: np.ndarray, k: int, places: np.ndarray) -> np.ndarray:
    """One place for each different window, exactly."""
    kept = []
    for some in shares(buf, k, places):
        held = places[:0]
        for a in range(0, len(some), SHARE):  # a window may be most of a sequence
            held = np.concatenate([held, places[some[a : a + SHARE]]])
            order, first = grouped(buf, k, held)
            held = held[order[first]]
        kept.append(held)
    return np.concatenate(kept)


def strands(parts: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes of both strands, places of the canonical windows, flipped, valid) of sequences; as canonical_windows()."""
    keep = np.zeros(256, np.uint8)
    other = np.zeros(256, np.uint8)
    for a, b in zip(b"ACGT", b"TGCA"):
        keep[a], other[a] = a, b
    forward = [keep[p] for p in parts]
    buf = np.concatenate([*forward, *(other[p][::-1] for p in parts), np.zeros(PAD, np.uint8)])
    total, at, ahead, back = sum(map(len, parts)), 0, [], []
    for p in parts:
        n = max(0, len(p) - k + 1)
        ahead.append(np.arange(at, at + n))
        back.append(np.arange(total + at + n - 1, total + at - 1, -1))
        at += len(p)
    f, r = np.concatenate(ahead), np.concatenate(back)
    flipped, level = np.zeros(len(f), bool), np.ones(len(f), bool)
    half = k // 2
    for o in range(0, half, 8):
        drop_ = np.uint64(8 * max(0, o + 8 - half))  # bytes after the half don't count
        a, b = (_load(buf, x, o, "<u8").byteswap() >> drop_ for x in (f, r))
        flipped |= level & (a > b)
        level &= a == b
    zeros = np.concatenate([[0], np.cumsum(buf[:total] == 0)])
    valid = zeros[f + k] == zeros[f]
    return buf, np.where(flipped, r, f), flipped, valid


class Lookup:
    """Different windows, numbered, to be found among others."""

    def __init__(self, buf: np.ndarray, k: int, places: np.ndarray):
        self.k = k
        kept = first_places(buf, k, places)
        words = words_of(buf, k, kept)
        h = mixed(words)
        order = np.argsort(h, kind="stable")
        self.h, self.words, self.places = h[order], [w[order] for w in words], kept[order]
        _, runs = np.unique(self.h, return_counts=True)
        self.most = int(runs.max(initial=0))
        self.bits = max(16, min(30, len(kept).bit_length() + 4))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self._slot(self.h)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, buf: np.ndarray, places: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """(which of these places have one of the windows, its number)."""
        words = words_of(buf, self.k, places)
        h = mixed(words)
        at = np.flatnonzero(self.filter[self._slot(h)])
        mine = np.searchsorted(self.h, h[at])
        which, found = [at[:0]], [mine[:0]]
        for step in range(self.most):  # more than one only if two windows have one hash
            number = np.minimum(mine + step, len(self.h) - 1)
            same = (mine + step < len(self.h)) & (self.h[number] == h[at])
            for own, other in zip(self.words, words):
                same &= own[number] == other[at]
            which.append(at[same])
            found.append(number[same])
        return np.concatenate(which), np.concatenate(found)
