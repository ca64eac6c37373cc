"""Word-shingle sets of whole texts as 64-bit hashes, vectorised over the bytes of many texts.

Two different shingles of one text collide with a chance of about 2^-64 for each pair.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: An odd base with its inverse modulo 2^64, and the multipliers of a public 64-bit mixer.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CODE[_SPACE] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, CHUNK), _powers(_INVERSE, CHUNK)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ``data``, which must hold whole words; A-Z count as a-z."""
    global _UP, _DOWN
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(raw) > len(_UP):
        _UP, _DOWN = _powers(_BASE, len(raw)), _powers(_INVERSE, len(raw))
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edges[0::2], edges[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[raw] * _UP[: len(raw)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64)), start


def _cut(data: bytes) -> list[bytes]:
    """Chunks of whole words; a chunk grows beyond ``CHUNK`` only for a longer word."""
    out, at = [], 0
    while at < len(data):
        to = at + CHUNK
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        out.append(data[at:to])
        at = to
    return out


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    h = words[: len(words) - n + 1]
    for k in range(1, n):
        h = mix(h * np.uint64(_BASE) + words[k : len(words) - n + 1 + k])
    return h


def _short(words: np.ndarray) -> np.ndarray:
    digest = hashlib.blake2b(words.tobytes(), digest_size=8, person=b"whole text").digest()
    return np.frombuffer(digest, np.uint64)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: ``n`` words each; of fewer words, the whole text as one."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    k = 0
    while k < len(texts):
        if len(texts[k]) > CHUNK:
            parts = [word_hashes(p)[0] for p in _cut(texts[k])]
            words, bounds, group = np.concatenate(parts), None, [k]
        else:
            group, size = [], 0
            while k + len(group) < len(texts) and size + len(texts[k + len(group)]) < CHUNK:
                size += len(texts[k + len(group)]) + 1
                group.append(k + len(group))
            group = group or [k]
            words, start = word_hashes(b"\n".join(texts[g] for g in group))
            ends = np.cumsum([len(texts[g]) + 1 for g in group])
            bounds = np.searchsorted(start, ends)
        all_windows = _windows(words, n) if len(words) >= n else None
        at = 0
        for g, to in zip(group, [len(words)] if bounds is None else bounds.tolist(), strict=True):
            if to - at >= n:
                out[g] = np.unique(all_windows[at : to - n + 1])
            elif to > at:
                out[g] = _short(words[at:to])
            at = to
        k += len(group)
    return out


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """16 bytes that stand for the whole set; null for an empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None
