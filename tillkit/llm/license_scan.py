"""License scan of a file tree: TF-IDF match of notices, and inheritance.

1. Lines that speak of a license (``CUE``) are the headers of a file, wherever
   they stand. Equal lines are one line with a count from here on.
2. Lines and templates are sparse TF-IDF vectors over their words, with
   document frequencies over all such lines of all files. Products meet by a
   join on the word, and a line takes the template of the highest cosine, if
   it is ``LEAST`` or more.
3. Comment blocks, paragraphs and whole licence files, cue or not, meet the
   headers, SPDX ids and full texts of ``license_notices`` in the same way,
   with the document frequencies of those. Blocks with too many other words
   for ``LEAST`` (by a bound that holds for all weights) leave before the join.
4. A file has the license of its best line or block. A licence file (``NAMES``) also
   speaks for its directory: files without a notice inherit from the nearest
   ancestor directory that has one, by a join on path prefixes.

Only DataFrame functions are used. A null text has no notice; a null path
inherits nothing; rows that agree in path and text share their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillkit.llm.common import free_names, staged
from tillkit.llm.license_notices import vectors

#: Notices of common licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0, no license needed."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
CUE = "(?i)licen[cs]e|copyright|spdx|public domain"
WORD = "[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]"
NAMES = "(?i)^(licen[cs]e|copying|notice|copyright)([.].*)?$"
LEAST = 0.6
#: Runs of lines with a comment mark, and comments between two marks.
COMMENTS = r"(?m)(?:^[ \t]*(?:#|//|/?\*|--|;|%|dnl\b|(?i:rem)\b)[^\n]*(?:\n|\z))++"
ENCLOSED = r'(?s)/\*.*?\*/|<!--.*?-->|""".*?"""'
#: Marks that open and close a comment.
PAIRS = (("/*", "*/"), ("<!--", "-->"))


def templates(spark: SparkSession) -> DataFrame:
    """The notices as a table (license, line)."""
    return spark.createDataFrame(TEMPLATES, "license string, line string")


def _terms(lines: DataFrame, *keys: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("line"), F.lit(WORD), F.lit(0))
    return (lines.select(*keys, F.explode(words).alias("word"))
            .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n")))


def match_lines(lines: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """(line, license, score) of different lines (line, files) that match a template."""
    total = lines.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("total"))
    terms = _terms(lines, "line", "files")
    frequency = terms.groupBy("word").agg(F.sum("files").alias("df"))
    of_template = _terms(known, "license")
    # one row of totals meets the words of the templates and lines: a scalar, not a product of tables
    idf = frequency.join(F.broadcast(total)).select(
        "word", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    # a word that no line has does not change which template is nearest by more than its norm
    unseen = F.log(F.lit(1.0) + F.lit(1.0)) + 1
    weight = (1 + F.log("n")) * F.col("idf")
    mine = terms.join(idf, "word").select("line", "word", weight.alias("w"))
    theirs = of_template.join(idf, "word", "left").select(
        "license", "word", ((1 + F.log("n")) * F.coalesce("idf", unseen)).alias("t"))
    norm = lambda df, key, w, name: df.groupBy(key).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias(name))
    product = mine.join(theirs, "word").groupBy("line", "license").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = (product.join(norm(mine, "line", "w", "wn"), "line").join(norm(theirs, "license", "t", "tn"), "license")
              .select("line", "license", F.round(F.col("dot") / (F.col("wn") * F.col("tn")), 6).alias("score"))
              .where(F.col("score") >= least))
    best = scored.groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("m"), "license")).alias("b"))
    return best.select("line", F.col("b.license").alias("license"), (-F.col("b.m")).alias("score"))


def _closed(text: Column) -> Column:
    """``text`` without the opening marks that nothing closes: those after the last closing mark.

    So a match of ``ENCLOSED`` always ends, and the whole text is gone through once.
    """
    for opens, closes in PAIRS:
        tail = F.substring_index(text, closes, -1)
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        text = F.concat(head, F.replace(tail, F.lit(opens), F.lit(" " * len(opens))))
    return text


def _enclosed(text: Column) -> Column:
    """Comments between two marks."""
    marked = text.contains('"""')
    for _, closes in PAIRS:
        marked = marked | text.contains(closes)
    return F.when(marked, F.regexp_extract_all(_closed(text), F.lit(ENCLOSED), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def blocks(path: Column, text: Column) -> Column:
    """Header blocks, paragraphs and lines with a cue of a file, and a licence file as a whole."""
    whole = F.when(F.element_at(F.split(path, "/"), -1).rlike(NAMES), F.array(text))
    return F.array_distinct(F.concat(
        F.split(text, r"\n\s*\n"), F.regexp_extract_all(text, F.lit(COMMENTS), F.lit(0)),
        _enclosed(text),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE)), F.coalesce(whole, F.array().cast("array<string>"))))


def match_blocks(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(p, a, b, license, score) of the blocks of files (p, a, b, body) that match a notice."""
    spark = files.sparkSession
    idf, unit, other = vectors(WORD)
    listed = ", ".join(f"'{w}'" for w, _ in idf)
    # K of D words are in notices: |known|**2 <= K * (1 + ln(n / K))**2 * other**2 (the square is concave in n)
    n, d, k = F.size("words"), F.size("set"), F.col("k")
    room = F.lit((1 - least ** 2) / least ** 2 * (1 + 1e-9)) * k * F.pow(1 + F.log((n - d + k) / k), 2)
    near = staged(
        files.select("p", "a", "b", F.explode(blocks(F.col("p"), F.col("body"))).alias("block"))
        .select("p", "a", "b", F.regexp_extract_all(F.lower("block"), F.lit(WORD), F.lit(0)).alias("words"))
        .withColumn("set", F.array_distinct("words"))
        .withColumn("k", F.expr(f"size(filter(set, x -> x in ({listed})))"))
        .where((k > 0) & (d - k <= room))
        .select("p", "a", "b", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words", F.lit(11)).alias("h2"),
                "words"), "blocks")
    terms = (near.groupBy("h1", "h2").agg(F.first("words").alias("words"))
             .select("h1", "h2", F.explode("words").alias("word")).groupBy("h1", "h2", "word")
             .agg(F.count(F.lit(1)).alias("n")))
    known = F.broadcast(spark.createDataFrame(idf, "word string, idf double"))
    theirs = F.broadcast(spark.createDataFrame(unit, "notice string, word string, t double"))
    mine = terms.join(known, "word", "left").select(
        "h1", "h2", "word", ((1 + F.log("n")) * F.coalesce("idf", F.lit(other))).alias("w"))
    norm = mine.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("wn"))
    product = mine.join(theirs, "word").groupBy("h1", "h2", "notice").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    best = (product.join(norm, ["h1", "h2"])
            .select("h1", "h2", F.split("notice", " ")[0].alias("license"),
                    F.round(F.col("dot") / F.col("wn"), 6).alias("score"))
            .where(F.col("score") >= least).groupBy("h1", "h2")
            .agg(F.min(F.struct((-F.col("score")).alias("m"), "license")).alias("top")))
    return near.select("p", "a", "b", "h1", "h2").join(best, ["h1", "h2"]).select(
        "p", "a", "b", F.col("top.license").alias("license"), (-F.col("top.m")).alias("score"))


def parent(path: Column) -> Column:
    """The directory of a path ('' at the root)."""
    return F.regexp_replace(path, "/[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """``files`` with license, score, via ('header', 'inherited' or null) and license_path.

    Clashing columns of ``files`` keep their names and the new ones are
    prefixed with ``_``.
    """
    names = free_names(files, "license", "score", "via", "license_path")
    inner = {c: f"c{i}__{c}" for i, c in enumerate(files.columns)}  # clear of the names used below
    path, text = inner[path], inner[text]
    keyed = files.withColumnsRenamed(inner).withColumns({
        "path_key": F.col(path), "t1": F.xxhash64(F.col(text)), "t2": F.xxhash64(F.lit(7), F.col(text), F.lit(11))})
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(CUE))
    headers = keyed.where(F.col(text).rlike(CUE)).select(
        F.col("path_key").alias("p"), F.col("t1").alias("a"), F.col("t2").alias("b"), F.explode(lines).alias("line"))
    different = headers.groupBy("line").agg(F.count(F.lit(1)).alias("files"))
    matched = match_lines(different, templates(files.sparkSession), least)
    whole = match_blocks(keyed.where(F.col(text).isNotNull()).select(
        F.col("path_key").alias("p"), F.col("t1").alias("a"), F.col("t2").alias("b"), F.col(text).alias("body")), least)
    of_lines = headers.join(matched, "line").select("p", "a", "b", "license", "score")
    own = of_lines.unionByName(whole).groupBy("p", "a", "b").agg(
        F.min(F.struct((-F.col("score")).alias("m"), "license")).alias("best")).select(
        "p", "a", "b", F.col("best.license").alias("own_license"), (-F.col("best.m")).alias("own_score"))
    name = F.element_at(F.split("p", "/"), -1)
    spoken = (own.where(F.col("p").isNotNull() & name.rlike(NAMES)).groupBy(parent(F.col("p")).alias("dir")).agg(
        F.min(F.struct((-F.col("own_score")).alias("m"), "own_license", "p")).alias("best")).select(
        "dir", F.col("best.own_license").alias("dir_license"), (-F.col("best.m")).alias("dir_score"),
        F.col("best.p").alias("dir_path")))

    # nearest ancestor: every prefix of the path of a file without a notice
    paths = keyed.select(F.col("path_key").alias("p")).where(F.col("p").isNotNull()).distinct()
    parts = F.split(parent(F.col("p")), "/")
    prefixes = paths.select("p", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth")).select(
        "p", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = prefixes.join(spoken, "dir").groupBy("p").agg(
        F.max(F.struct("depth", "dir_license", "dir_score", "dir_path")).alias("near")).select(F.col("p").alias("q"), "near")

    joined = (keyed.join(own, F.col("path_key").eqNullSafe(F.col("p")) & (F.col("t1") == F.col("a"))
                         & (F.col("t2") == F.col("b")), "left")
              .join(nearest, F.col("path_key") == F.col("q"), "left"))
    found, near = F.col("own_license").isNotNull(), F.col("near")
    return joined.select(
        *[F.col(v).alias(k) for k, v in inner.items()],
        F.coalesce("own_license", near["dir_license"]).alias(names[0]),
        F.coalesce("own_score", near["dir_score"]).alias(names[1]),
        F.when(found, "header").when(near.isNotNull(), "inherited").alias(names[2]),
        F.when(found, F.col("path_key")).otherwise(near["dir_path"]).alias(names[3]))


def document_path(doc_id: str = "doc_id") -> Column:
    """Documents as a tree of files: hundreds in directories, ten thousands above.

    The first document of a directory is its licence file.
    """
    d = F.col(doc_id)
    top = F.concat(F.lit("/t"), F.floor(d / 10000).cast("long"))
    low = F.concat(top, F.lit("/d"), F.floor(d / 100).cast("long"))
    return (F.when(d % 10000 == 0, F.concat(top, F.lit("/LICENSE")))
            .when(d % 100 == 0, F.concat(low, F.lit("/LICENSE")))
            .otherwise(F.concat(low, F.lit("/"), d, F.lit(".txt"))))
