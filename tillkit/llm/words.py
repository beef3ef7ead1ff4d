"""Distinct words of a block of texts, split by the transducer of ``pretoken``.

Words meet by a hash; each occurrence is then compared with the word that it
stands for, so words of equal hash stay apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tillkit.llm.common import U64, Powers, mix, prefix_hash, span_hash
from tillkit.llm.pretoken import END, classes, word_starts


@dataclass
class Words:
    """``words``: the distinct words; ``index``: for each word of the texts, in
    order, its place in ``words``; ``text``: the text it stands in."""

    words: list[str]
    index: np.ndarray
    text: np.ndarray


def split_words(texts: list[str], pw: Powers) -> Words:
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64) + 1
    ends = np.cumsum(sizes) - 1
    kinds = classes()[points]
    kinds[ends] = END
    start = word_starts(kinds)
    stop = np.concatenate([start[1:], [len(points)]])
    real = kinds[start] != END
    start, stop = start[real], stop[real]
    up, down = pw.upto(len(points) + 1)
    sums = prefix_hash(points.astype(U64) + U64(1), up)
    hashes = mix(span_hash(sums, down, start, stop) + (stop - start).astype(U64))
    _, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    words = [joined[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
    other = _unequal(points, start, stop, first[index])
    if len(other):
        index = index.copy()
        place: dict[str, int] = {}
        for i in other.tolist():
            word = joined[start[i]:stop[i]]
            if word not in place:
                place[word] = len(words)
                words.append(word)
            index[i] = place[word]
    return Words(words, index, np.searchsorted(ends, start))


def _unequal(points: np.ndarray, start: np.ndarray, stop: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Places of words that differ from the word at place ``like`` of the same list."""
    size = stop - start
    same = np.flatnonzero((size == size[like]) & (like != np.arange(len(like))))
    n = size[same]
    at = np.repeat(start[same] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    wrong = points[at] != points[at + np.repeat(start[like[same]] - start[same], n)]
    return np.union1d(np.flatnonzero(size != size[like]), np.repeat(same, n)[wrong] if wrong.any() else [])
