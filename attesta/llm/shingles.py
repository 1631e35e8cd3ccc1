"""Word shingles of whole texts, hashed with arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORDS = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[0x41:0x5B] += 32
_BLANK = re.compile(rb"[ \t-\r]")
_CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(_CHUNK + 1, n)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, x, np.uint64)))) for x in (_BASE, _INVERSE)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL
    h = (h ^ (h >> np.uint64(32))) * _MUL
    return h ^ (h >> np.uint64(32))


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word, with A-Z lowered."""
    raw = np.frombuffer(buffer, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """Pieces of about a chunk, cut at white space; one that begins with a word over a chunk reaches to that word's end."""
    at = 0
    while len(text) - at > _CHUNK:
        # From at + 1: the white space at which the last piece ended is not a cut.
        cut = max(text.rfind(c, at + 1, at + _CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            found = _BLANK.search(text, at + _CHUNK)
            if not found:
                break
            cut = found.start()
        yield text[at:cut]
        at = cut
    yield text[at:]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A shingle is five words; a text with one to four words has one shingle, all of it; one without words has none.
    """
    group: list[bytes] = []
    size = 0
    for text in texts:
        if len(text) > _CHUNK:
            yield from _small(group)
            group, size = [], 0
            yield _set(np.concatenate([word_hashes(p)[0] for p in _pieces(text)]))
            continue
        group.append(text)
        size += len(text) + 1
        if size > _CHUNK // 2:
            yield from _small(group)
            group, size = [], 0
    yield from _small(group)


def _small(texts: list[bytes]) -> Iterator[np.ndarray]:
    if not texts:
        return
    hashes, starts = word_hashes(b"\n".join(texts))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    at = np.searchsorted(starts, bounds)
    joined = _windows(hashes)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(joined[lo : hi - WORDS + 1]) if hi - lo >= WORDS else _set(hashes[lo:hi])


def _windows(words: np.ndarray) -> np.ndarray:
    n = len(words) - WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, WORDS):
        h = h * np.uint64(_BASE) + words[k : n + k]
    return mix(h)


def _set(words: np.ndarray) -> np.ndarray:
    if len(words) >= WORDS:
        return np.unique(_windows(words))
    if not len(words):
        return np.zeros(0, np.uint64)
    h = len(words)
    for w in words.tolist():
        h = (h * _BASE + w) % 2**64
    return mix(np.array([h], np.uint64))


def exact_set(text: bytes) -> set:
    """The shingles themselves, for exact comparison."""
    words = text.lower().split()
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False))
