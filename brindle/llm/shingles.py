"""Word shingles of whole texts as hash sets, by array operations over a batch of texts."""

from __future__ import annotations

import numpy as np

from brindle.llm.common import mix64

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix64((np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_STEP = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_powers = np.cumprod(np.full(256, _BASE, np.uint64), dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, _BASE, np.uint64), dtype=np.uint64)
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word with A-Z lower-cased, number of words of each text)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start, stop = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    if not len(start):
        return np.zeros(0, np.uint64), counts
    length = stop - start
    inside = np.flatnonzero(~blank)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    offset = np.arange(len(inside)) - np.repeat(first, length)
    total = np.add.reduceat(_VALUE[raw[inside]] * _power(int(length.max()))[offset], first)
    return mix64(total + length.astype(np.uint64) * _STEP[0]), counts


def shingle_sets(texts: list[bytes], width: int, seed: int = 0) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words; of a shorter text, one of all its words; without words, none."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    salt = mix64(np.array([seed + 1], np.uint64))[0]
    n = len(words) - width + 1
    full = np.full(max(n, 0), salt, np.uint64)
    for k in range(width):
        if n > 0:
            full += words[k : k + n] * _STEP[k % len(_STEP)] * np.uint64(2 * (k // len(_STEP)) + 1)
    full = mix64(full)
    out = []
    for c, e in zip(counts.tolist(), ends.tolist(), strict=True):
        if c >= width:
            out.append(np.unique(full[e - c : e - width + 1]))
        elif c:
            short = (words[e - c : e] * _STEP[np.arange(c) % len(_STEP)]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short + salt + np.full(1, c, np.uint64) * _BASE))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
