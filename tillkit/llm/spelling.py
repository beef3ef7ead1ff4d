"""Spelling variants: words one edit apart, grouped under their frequent form.

Two words are near if one code point inserted, deleted or replaced turns one
into the other. A word's form is its near word of largest count, if that is at
least ``RATIO`` times the word's own; its root is what the forms lead to.

1. Near words share their first or their last half: cut at half the shorter
   length, the one edit lies on one side and leaves the other as it is. So
   words meet in groups of one prefix or one suffix, which hold both lengths
   that an edit can give.
2. A group is a sorted list of the other parts (read backwards when the suffix
   is shared). Every word of the group asks the list at once. The list is gone
   through by depth: at depth d, neighbours whose LCP is d or more form one
   range, and the band of the edit matrix (3 cells, as more than one edit does
   not count) after d characters is computed once for the range and reused for
   each longer prefix in it. A range whose band has no cell of one edit or less
   is skipped with all words in it.
3. A pair of unequal length can share both halves (``aab``, ``ab``): it counts
   in the group of the prefix only. So each word adds up its near words over its
   groups, and no pair is a row.
4. Groups are dealt into tasks of about ``TASK`` rows. A group of more than
   ``CHUNK`` words is cut into chunks; each chunk asks each other's list in a
   task of its own. No group is capped, and no task holds more than that.
5. Forms are followed by pointer doubling: counts at least double along the
   way, so a few rounds of joins suffice.

Defined cases: a null or empty text has no words; a null doc_id is written as
``null`` where ids count; repeated rows count again; an empty table has no
words; texts are read whole. Columns other than the id and the text are not
looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.llm.common import release, ship, staged

RUN = "[A-Za-zÀ-ÿ]+"
SHORTEST, LEAST, RATIO = 5, 3, 2
#: A run loses a code point if the CRC of id and run is divisible by this.
SLIP = 97
#: Distinct words that a task counts before it sends their counts on.
HELD = 200_000
CHUNK = 16_384
TASK = 32_768
#: Code points of a word that weigh as a row of their own.
LONG = 64
#: Words that ask a list at the same time.
ASKING = 4_096


def slipped(doc_id, run: str) -> str:
    """``run`` without one code point, if the CRC of ``<doc_id>:<run>`` says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST,
               least: int = LEAST) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points with ``least`` occurrences or more."""
    ship(docs.sparkSession)
    runs = re.compile(RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if len(w) >= shortest]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()),
                                               pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                lowered = (t.as_py() or "").encode("utf-8", "surrogatepass").lower()  # of bytes: only A-Z
                # a shorter run is a shorter word, slipped or not
                mine = Counter(w for w in runs.findall(lowered.decode("utf-8", "surrogatepass")) if len(w) >= shortest)
                start = zlib.crc32(f"{'null' if i is None else i}:".encode())
                for w, n in mine.items():
                    h = zlib.crc32(w.encode(), start)
                    if not h % SLIP:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                    held[w] += n
                if len(held) >= HELD:
                    yield out()
        yield out()
        release()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return (rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least))


def _points(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The parts as rows of code points (0 beyond their end), and their lengths."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
    table = np.zeros((len(parts), int(size.max(initial=0)) + 2), dtype=np.int32)
    table[np.arange(table.shape[1]) < size[:, None]] = flat
    return table, size


def near_in_lists(group: np.ndarray, parts: list[str], asks: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of one group whose parts are exactly one edit apart, i of ``asks`` and j of ``lists``.

    The listed parts of a group must differ from each other.
    """
    text = np.array(parts, dtype=object)
    place = np.flatnonzero(lists)
    place = place[np.lexsort((text[place].astype(str) if len(place) else text[place], group[place]))]
    mine, size = _points([parts[i] for i in place])
    of = group[place]
    n = len(place)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # length of the prefix that a listed part shares with the one before it; -1 where a group begins
    lcp = np.full(n, -1, dtype=np.int64)
    same = np.flatnonzero(of[1:] == of[:-1]) + 1
    unlike = mine[same] != mine[same - 1]
    lcp[same] = np.minimum(np.where(unlike.any(axis=1), unlike.argmax(axis=1), mine.shape[1]), size[same])
    first = np.flatnonzero(lcp < 0)
    last = np.append(first[1:], n)
    begins: list[np.ndarray] = []  # by depth: where a range of equal prefixes of that many characters begins
    for d in range(int(size.max()) + 1):
        begins.append(np.flatnonzero((lcp < d) & (size >= d)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    askers = np.flatnonzero(asks)
    for lo in range(0, len(askers), ASKING):
        who = askers[lo:lo + ASKING]
        theirs, length = _points([parts[i] for i in who])
        at = np.searchsorted(of[first], group[who])
        has = (at < len(first))
        has[has] = of[first[at[has]]] == group[who[has]]
        q = np.flatnonzero(has)
        start, stop = first[at[q]], last[at[q]]
        low, mid = np.full(len(q), 2), np.zeros(len(q), np.int64)
        high = np.where(length[q] >= 1, 1, 2)
        for d in range(len(begins)):
            # the part that ends here is the first of its range
            ends = size[start] == d
            gap = length[q] - d
            cost = np.where(gap == -1, low, np.where(gap == 0, mid, np.where(gap == 1, high, 2)))
            hit = ends & (cost == 1)
            found.append((who[q[hit]], place[start[hit]]))
            if d + 1 == len(begins):
                break
            # the ranges of one more character within each range
            a = np.searchsorted(begins[d + 1], start)
            many = np.searchsorted(begins[d + 1], stop) - a
            up = np.repeat(np.arange(len(q)), many)
            nth = np.arange(len(up)) - np.repeat(np.cumsum(many) - many, many)
            k = a[up] + nth
            new = begins[d + 1][k]
            after = np.append(begins[d + 1][1:], n)[k]
            stop, q, start = np.minimum(after, stop[up]), q[up], new
            c = mine[start, d]
            low, mid, high = low[up], mid[up], high[up]

            def unlike_at(j: int) -> np.ndarray:
                """Whether the asker's j-th character differs; 2 if it has none."""
                if j < 0:
                    return np.full(len(q), 2)
                if j >= theirs.shape[1]:
                    return np.full(len(q), 2)
                return np.where(j < length[q], theirs[q, j] != c, 2)

            was = low
            low = np.minimum(was + unlike_at(d - 1), mid + 1)
            new_mid = np.minimum(np.minimum(mid + unlike_at(d), high + 1), low + 1)
            high = np.minimum(high + unlike_at(d + 1), new_mid + 1)
            gap = length[q] - d - 1  # cells beyond the asker's end do not exist
            low, mid, high = (np.where(gap >= x, cell, 2) for x, cell in ((-1, low), (0, new_mid), (1, high)))
            live = np.minimum(np.minimum(low, mid), high) <= 1
            q, start, stop, low, mid, high = (x[live] for x in (q, start, stop, low, mid, high))
            if not len(q):
                break
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _groups(words: DataFrame) -> DataFrame:
    """(side, half, key, word, n): the groups of each word; ``half`` is the length of the shared part."""
    size = F.length("word")
    floor = lambda x: F.floor(x / 2).cast("int")
    # a word is the shorter or the longer of a pair: both halves of its length and of one less
    halves = F.array_distinct(F.array(F.struct(F.lit("p").alias("side"), floor(size).alias("half")),
                                      F.struct(F.lit("p").alias("side"), floor(size - 1).alias("half")),
                                      F.struct(F.lit("s").alias("side"), floor(size + 1).alias("half")),
                                      F.struct(F.lit("s").alias("side"), floor(size).alias("half"))))
    rows = words.select("word", "n", F.explode(halves).alias("x")).select("x.side", "x.half", "word", "n")
    shared = F.when(F.col("side") == "p", F.substring("word", F.lit(1), F.col("half"))).otherwise(
        F.substring("word", F.length("word") - F.col("half") + 1, F.col("half")))
    return rows.withColumn("key", F.concat("side", shared))


def _dealt(rows: DataFrame, chunk: int, task: int) -> DataFrame:
    """``rows`` with task (where they go), grp (the group there), asks and lists."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = staged(rows.join(sizes, "key"), "groups")
    weight = F.ceil(F.col("size") / chunk) * F.ceil(F.length("word") / LONG)
    total = sized.agg(F.sum(weight)).first()[0] or 0
    tasks = max(1, -(-int(total) // task))
    cut = (sized.withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
           .withColumn("c", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
           .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
    # chunk i asks chunk j: a row asks in (c, o) and is listed in (o, c)
    both = F.when(F.col("c") == F.col("o"), F.array(F.struct(F.col("c").alias("i"), F.col("o").alias("j"),
                                                           F.lit(True).alias("asks"), F.lit(True).alias("lists")))
                  ).otherwise(F.array(
                      F.struct(F.col("c").alias("i"), F.col("o").alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("lists")),
                      F.struct(F.col("o").alias("i"), F.col("c").alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("lists"))))
    placed = cut.select("key", "side", "half", "word", "n", F.explode(both).alias("x"))
    return placed.select(F.pmod(F.xxhash64("key", "x.i", "x.j"), F.lit(tasks)).cast("int").alias("task"),
                         F.concat_ws(":", "x.i", "x.j", "key").alias("grp"), "side", "half", "word", "n",
                         "x.asks", "x.lists")


def _ask(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each word of a task with near words: how many, and the best of them."""
    words, half = pdf["word"].tolist(), pdf["half"].to_numpy()
    front = (pdf["side"] == "p").to_numpy()
    parts = [w[h:] if f else w[:len(w) - h][::-1] for w, h, f in zip(words, half, front)]
    group, asks, lists = pdf["grp"].factorize()[0], pdf["asks"].to_numpy(), pdf["lists"].to_numpy()
    # words of one group are about as long as each other: a table of code points holds those of like length
    like = np.frexp(half)[1]
    found = []
    for x in np.unique(like):
        rows = np.flatnonzero(like == x)
        i, j = near_in_lists(group[rows], [parts[k] for k in rows], asks[rows], lists[rows])
        found.append((rows[i], rows[j]))
    i, j = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    size = np.array([len(w) for w in words], dtype=np.int64)
    short = np.minimum(size[i], size[j])
    # the group is that of the shorter length's half
    mine = np.where(front[i], short // 2 == half[i], (short + 1) // 2 == half[i])
    # what shares the first half too counts there
    behind = np.flatnonzero(mine & ~front[i] & (size[i] != size[j]))
    mine[behind] = [words[a][:s] != words[b][:s] for a, b, s in
                    zip(i[behind].tolist(), j[behind].tolist(), (short[behind] // 2).tolist())]
    i, j = i[mine], j[mine]
    n = pdf["n"].to_numpy()
    near = pd.DataFrame({"word": pdf["word"].to_numpy()[i], "near": pdf["word"].to_numpy()[j], "m": n[j]})
    near = near.sort_values(["word", "m", "near"], ascending=[True, False, True], kind="stable")
    best = near.groupby("word", sort=False).agg(n_near=("near", "size"), m=("m", "first"), near=("near", "first"))
    return best.reset_index()[["word", "n_near", "m", "near"]].astype({"n_near": "int64", "m": "int64"})


def near_words(words: DataFrame, chunk: int = CHUNK, task: int = TASK) -> DataFrame:
    """(word, n_near, m, near) of each ``word`` (distinct, with its ``n``) that has near words.

    ``near`` is the near word of largest n, ``m`` (ties: least in code-point order).
    """
    ship(words.sparkSession)
    found = (_dealt(_groups(words), chunk, task).groupBy("task")
             .applyInPandas(_ask, "word string, n_near long, m long, near string"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("x")).select(
        "word", "n_near", (-F.col("x.less")).alias("m"), F.col("x.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by pointer doubling."""
    at = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(at.join(onward, "root", "left"), "forms")
        at = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where("next is not null").isEmpty():
            return at


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO,
             chunk: int = CHUNK, task: int = TASK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts' vocabulary."""
    words = staged(vocabulary(docs, doc_id, text), "words")
    near = near_words(words, chunk, task)
    has = F.col("m") >= ratio * F.col("n")
    formed = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("near")).alias("form"), F.when(has, F.col("m")).alias("form_n")), "formed")
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
