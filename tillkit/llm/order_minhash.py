"""Order MinHash of word shingles, and alignment of two texts' shingles."""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

import numpy as np

from tillkit.llm.common import BASE, U64, Powers, mix, prefix_hash, span_hash

#: Bytes from which a word has a cryptographic hash: polynomial ones collide on long words of a pattern.
LONG = 128
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, pw: Powers) -> np.ndarray:
    """Hash of each word (run without white space) of some UTF-8 bytes."""
    if not len(data):
        return np.empty(0, dtype=U64)
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = pw.upto(len(data) + 1)
    sums = prefix_hash(data.astype(U64) + U64(1), up)
    out = mix(span_hash(sums, down, start, end))
    for i in np.flatnonzero(end - start >= LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, labelled with its occurrence.

    The n-th time that the same words follow each other counts as a shingle of
    its own, so all shingles of a text differ. A text of fewer than k words is
    one shingle.
    """
    if not len(words):
        return np.empty(0, dtype=U64)
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out = (out ^ words[j:j + n]) * U64(BASE) + U64(j)
    out = mix(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        nth = np.empty(n, dtype=U64)
        nth[order] = (np.arange(n) - first).astype(U64)
        out = np.where(nth > 0, mix(out + nth * U64(BASE)), out)
    return out


def sketch(labelled: np.ndarray, hashes: int, take: int) -> np.ndarray:
    """For each of ``hashes`` orders, the ``take`` least shingles in text order."""
    seeds = mix(np.arange(1, hashes + 1, dtype=U64) * U64(BASE))
    ranks = (labelled[None, :] ^ seeds[:, None]) * U64(0xD6E8FEB86659FD93)
    ranks ^= ranks >> U64(32)
    ranks *= U64(0xD6E8FEB86659FD93)
    take = min(take, len(labelled))
    if take < len(labelled):
        at = np.argpartition(ranks, take - 1, axis=1)[:, :take]
    else:
        at = np.tile(np.arange(take), (hashes, 1))
    at.sort(axis=1)  # the order of the text
    out = seeds.copy()
    for j in range(take):
        out = (out ^ labelled[at[:, j]]) * U64(BASE) + U64(1)
        out ^= out >> U64(29)
    return mix(out).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Share of shingles that an order-keeping alignment of two texts matches.

    matched / (all of a + all of b - matched): with shingles in the same order
    this is their Jaccard similarity. Texts of at least ``least`` leave at
    most (1 - least) / (1 + least) of all shingles unmatched, so only matches
    in a diagonal band of that width count; 0.0 if the texts cannot reach
    ``least``. Shingles of a text all differ, so the longest alignment is a
    longest rising run of positions.
    """
    total = len(a) + len(b)
    if not total or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    need = least / (1 + least) * total - 1e-9
    band = total - 2 * need
    order = np.argsort(b, kind="stable")
    place = np.searchsorted(b, a, sorter=order)
    place[place == len(b)] = 0
    at = order[place]
    hit = b[at] == a
    hit &= np.abs(at - np.arange(len(a))) <= band
    positions = at[hit]
    if len(positions) < need:
        return 0.0
    if (positions[1:] > positions[:-1]).all():
        matched = len(positions)
    else:
        tails: list[int] = []
        for p in positions.tolist():
            k = bisect_left(tails, p)
            if k == len(tails):
                tails.append(p)
            else:
                tails[k] = p
        matched = len(tails)
    return matched / (total - matched) if matched >= need else 0.0
