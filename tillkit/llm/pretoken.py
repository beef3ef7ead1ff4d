"""The split of text into words before BPE, as a transducer run in chunks.

The public pattern (contractions; an optional space before letters, numbers or
other signs; white space that leaves its last character to the next word) is
compiled to a deterministic transducer over character classes. Each transition
says whether a word starts at the character read (``HERE``) or, where the
pattern looks ahead, at the one before (``BEFORE``).

A chunk of text is run from every state at once, which gives its state map.
Maps compose, so a prefix scan over the chunks' maps gives the state in which
each chunk begins, and one more run of all chunks side by side gives the words.
"""

from __future__ import annotations

import unicodedata

import numpy as np

# character classes
SPACE, BLANK, QUOTE, NUMBER, SIGN, LETTER, ONE, R, V, L, E, END = range(12)
# states: what the word under way is
FRESH, IN_LETTERS, IN_NUMBERS, IN_SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, AFTER_SPACE, \
    AFTER_BLANK, RUN_SPACE, RUN_BLANK = range(12)
STATES = CLASSES = 12
HERE, BEFORE = 1, 2
CHUNK = 512

#: Unicode's White_Space property.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
         0x205F, 0x3000]
_LETTERS = (LETTER, ONE, R, V, L, E)
_TABLES: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Class of each code point."""
    if "classes" not in _TABLES:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.array([kind.get(unicodedata.category(chr(c))[0], SIGN) for c in range(0x110000)], dtype=np.uint8)
        out[WHITE] = BLANK
        out[0x20], out[ord("'")] = SPACE, QUOTE
        out[[ord(c) for c in "stmd"]] = ONE
        for c, k in (("r", R), ("v", V), ("l", L), ("e", E)):
            out[ord(c)] = k
        _TABLES["classes"] = out
    return _TABLES["classes"]


def _begin(c: int) -> int:
    """State after ``c`` has begun a word."""
    if c in _LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, SIGN: IN_SIGNS, QUOTE: QUOTED, SPACE: AFTER_SPACE,
            BLANK: AFTER_BLANK, END: FRESH}[c]


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and the marks of one transition."""
    letter, white = c in _LETTERS, c in (SPACE, BLANK)
    begun = (_begin(c), HERE)
    if c == END:
        return FRESH, HERE | (BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    if state == IN_LETTERS and letter or state == IN_NUMBERS and c == NUMBER:
        return state, 0
    if state in (IN_SIGNS, QUOTED) and c in (SIGN, QUOTE):
        return IN_SIGNS, 0
    if state == QUOTED and c in (ONE, R, V, L):
        return {ONE: FRESH, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c], 0
    if (state, c) in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        return FRESH, 0
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):  # the quote was a word; letters began after it
        return (IN_LETTERS, BEFORE) if letter else (begun[0], BEFORE | HERE)
    if state in (AFTER_SPACE, AFTER_BLANK, RUN_SPACE, RUN_BLANK):
        if white:
            return (RUN_SPACE if c == SPACE else RUN_BLANK), 0
        run = BEFORE if state in (RUN_SPACE, RUN_BLANK) else 0
        if state in (AFTER_SPACE, RUN_SPACE):  # the last space belongs to the next word
            return {NUMBER: IN_NUMBERS, SIGN: IN_SIGNS, QUOTE: IN_SIGNS}.get(c, IN_LETTERS), run
        return begun[0], run | HERE
    return begun


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, at state * CLASSES + class."""
    if "next" not in _TABLES:
        all_steps = [_step(s, c) for s in range(STATES) for c in range(CLASSES)]
        _TABLES["next"] = np.array([s for s, _ in all_steps], dtype=np.uint8)
        _TABLES["marks"] = np.array([m for _, m in all_steps], dtype=np.uint8)
    return _TABLES["next"], _TABLES["marks"]


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Positions at which words start in a sequence of classes; END always starts one."""
    follow, marks = tables()
    n = len(kinds)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, END, dtype=np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    # state map of each chunk: where it ends, for every state it may begin in
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, axis=1)
    width = np.uint8(CLASSES)
    for row in grid:
        maps = follow[maps * width + row]
    # prefix scan: maps[c] becomes the map of chunks 0 .. c
    step = 1
    while step < chunks:
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)
        step *= 2
    state = np.concatenate([[FRESH], maps[FRESH, :-1]]).astype(np.uint8)
    out = np.empty_like(grid)
    for j, row in enumerate(grid):
        at = state * width + row
        out[j] = marks[at]
        state = follow[at]
    said = out.T.reshape(-1)[:n]
    start = (said & HERE).astype(bool)
    start[:-1] |= (said[1:] & BEFORE).astype(bool)
    return np.flatnonzero(start)
