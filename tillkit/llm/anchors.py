"""Content anchors: a few positions of each text that equal strings share.

A string of ``length`` bytes is owned by the leftmost least ``gram``-byte hash
inside it. Equal strings own the same anchor at the same distance, so strings
that start at two places meet under one anchor hash and need not be compared
with anything else.
"""

from __future__ import annotations

import numpy as np

from tillkit.llm.common import U64, Powers, mix, prefix_hash, span_hash

GRAM = 32


def _least(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each ``window`` consecutive keys, by doubling."""
    width, out = 1, keys
    while width * 2 <= window:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < window:
        rest = window - width
        out = np.minimum(out[:-rest], out[rest:])
    return out


def owned_runs(data: np.ndarray, at: np.ndarray, length: int, pw: Powers) -> dict[str, np.ndarray]:
    """Anchors of the texts data[at[i]:at[i+1]] and the strings each one owns.

    Returns arrays ``doc`` (index of the text), ``first`` and ``last`` (the
    first and last start, within the text, of the strings of ``length`` bytes
    owned), ``h`` (hash of the anchor and its distance from ``first``) and
    ``seg`` (hash of the bytes from ``first`` to the end of the last string).
    """
    empty = {k: np.empty(0, dtype=np.int64) for k in ("doc", "first", "last", "h", "seg")}
    n = len(data)
    if n < length:
        return empty
    gram = min(GRAM, length)
    up, down = pw.upto(n + 1)
    prefix = prefix_hash(data.astype(U64) + U64(1), up)
    grams = (prefix[gram:] - prefix[:-gram]) * down[:n - gram + 1]
    order = mix(grams)
    bits = max(1, int(n).bit_length())
    packed = (order >> U64(bits) << U64(bits)) | np.arange(len(order), dtype=U64)
    least = _least(packed, length - gram + 1)
    where = (least & U64((1 << bits) - 1)).astype(np.int64)
    sizes = np.diff(at)
    starts = np.maximum(sizes - length + 1, 0)  # strings of each text
    doc = np.repeat(np.arange(len(sizes)), starts)
    if not len(doc):
        return empty
    begin = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(starts, out=begin[1:])
    pos = np.arange(len(doc)) - begin[doc] + at[doc]
    anchor = where[pos]
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])) + 1
    lo = np.concatenate([[0], edge])
    hi = np.concatenate([edge, [len(doc)]]) - 1
    first, last, own = pos[lo], pos[hi], anchor[lo]
    text = doc[lo]
    return {"doc": text, "first": first - at[text], "last": last - at[text],
            "lead": own - first, "h": mix(grams[own] + U64(1)).view(np.int64),
            "seg": mix(span_hash(prefix, down, first, last + length)
                       + (own - first).astype(U64)).view(np.int64)}
