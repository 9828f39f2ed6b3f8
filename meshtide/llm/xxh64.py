"""XXH64 of many byte spans at once, as published by Yann Collet, vectorised over spans of one length."""

from __future__ import annotations

import numpy as np
import xxhash

# fixed values: the five primes of the XXH64 specification
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer spans are hashed one by one by the library.
LONG = 256


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(lane: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _rotate(lane + value * P2, 31) * P1


def _same_length(data: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    halves = np.ndarray((max(0, len(data) - 3),), "<u4", data, 0, (1,))
    one = np.uint64(seed)
    pos = 0
    with np.errstate(over="ignore"):
        if n >= 32:
            lanes = [np.full(len(at), x, np.uint64) for x in (one + P1 + P2, one + P2, one, one - P1)]
            while pos + 32 <= n:
                lanes = [_round(lane, words[at + pos + 8 * k]) for k, lane in enumerate(lanes)]
                pos += 32
            h = _rotate(lanes[0], 1) + _rotate(lanes[1], 7) + _rotate(lanes[2], 12) + _rotate(lanes[3], 18)
            for lane in lanes:
                h = (h ^ _round(np.zeros_like(lane), lane)) * P1 + P4
        else:
            h = np.full(len(at), one + P5, np.uint64)
        h = h + np.uint64(n)
        while pos + 8 <= n:
            h = _rotate(h ^ _round(np.zeros_like(h), words[at + pos]), 27) * P1 + P4
            pos += 8
        if pos + 4 <= n:
            h = _rotate(h ^ (halves[at + pos].astype(np.uint64) * P1), 23) * P2 + P3
            pos += 4
        while pos < n:
            h = _rotate(h ^ (data[at + pos].astype(np.uint64) * P5), 11) * P1
            pos += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """The unsigned XXH64 of data[start:end] for each span."""
    data = np.ascontiguousarray(data)
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, cuts):
        if not len(own):
            continue
        n = int(lengths[own[0]])
        if n > LONG:
            out[own] = [xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=seed) for i in own.tolist()]
        else:
            out[own] = _same_length(data, starts[own], n, seed)
    return out
