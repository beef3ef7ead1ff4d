"""Constraint checks as data-quality operators.

Spark enforces none of PostgreSQL's CHECK / UNIQUE / FOREIGN KEY / NOT NULL
constraints, so each becomes a transform that returns the offending rows in
one common shape: ``(table, rule, key, value)``. All checks are scans,
algebraic aggregates or anti joins; they can be unioned and run as one job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


VIOLATION_COLS = ["table_name", "rule", "row_key", "value"]


def _key(cols: Sequence[str]) -> F.Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def _shape(df: DataFrame, table: str, rule: str, key_cols: Sequence[str], value) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                     _key(key_cols).alias("row_key"), value.cast("string").alias("value"))


def check_allowed(df: DataFrame, table: str, col: str, allowed: Iterable[str],
                  key_cols: Sequence[str]) -> DataFrame:
    """``CHECK (col IN (...))``. NULL passes a CHECK, so it is not reported."""
    bad = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(list(allowed)))
    return _shape(bad, table, f"check:{col}", key_cols, F.col(col))


def check_unique(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """E5: keys that occur more than once; rows with a NULL key are exempt.

    ``value`` is the number of rows sharing the key (partial aggregation
    before the shuffle, so a hot key costs one row per map task).
    """
    nn = df.filter(F.lit(True) if not keys else
                   F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    dup = nn.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _shape(dup, table, "unique:" + ",".join(keys), keys, F.col("_n"))


def check_foreign_key(df: DataFrame, table: str, cols: Sequence[str], parent: DataFrame,
                      parent_cols: Sequence[str], key_cols: Sequence[str]) -> DataFrame:
    """Non-NULL references with no parent row (``left_anti``)."""
    p = parent.select(*[F.col(pc).alias(f"_p{i}") for i, pc in enumerate(parent_cols)]
                      ).dropDuplicates()
    cond = None
    for i, c in enumerate(cols):
        e = df[c] == p[f"_p{i}"]
        cond = e if cond is None else cond & e
    refs = df.filter(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)))
    orphans = refs.join(p, cond, "left_anti")
    return _shape(orphans, table, "fk:" + ",".join(cols), key_cols,
                  _key(cols))


def check_not_null(df: DataFrame, table: str, col: str, key_cols: Sequence[str]) -> DataFrame:
    """``NOT NULL``."""
    return _shape(df.filter(F.col(col).isNull()), table, f"not_null:{col}", key_cols,
                  F.lit(None))


def check_scale(df: DataFrame, table: str, col: str, scale: int,
                key_cols: Sequence[str]) -> DataFrame:
    """Values with more decimal places than a NUMERIC(p, scale) column keeps
    (they would be rounded on store)."""
    c = F.col(col).cast("decimal(38,18)")
    bad = df.filter(F.col(col).isNotNull() & (F.round(c, scale) != c))
    return _shape(bad, table, f"scale:{col}", key_cols, F.col(col))


def violation_summary(violations: DataFrame) -> DataFrame:
    """Count of violations per (table, rule)."""
    return violations.groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("violations"))


def violation_counts(df: DataFrame, table: str, rules: Sequence[tuple[str, F.Column]]) -> DataFrame:
    """Several rules counted in one pass: ``rules`` are (name, aggregate
    Column counting that rule's violations). Returns (table_name, rule,
    violations) for the rules with at least one violation, in the shape of
    ``violation_summary``."""
    agg = df.agg(*[c.cast("long").alias(f"_r{i}") for i, (_, c) in enumerate(rules)])
    arr = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(name).alias("rule"),
                             F.coalesce(F.col(f"_r{i}"), F.lit(0).cast("long")).alias("violations"))
                    for i, (name, _) in enumerate(rules)])
    return agg.select(F.explode(arr).alias("_v")).select("_v.*").filter(F.col("violations") > 0)


def orphan_flag(df: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Adds ``_orphan``: a non-NULL reference with no parent row (E6), by one
    left join against the distinct parent keys."""
    p = parent.select(F.col(parent_col).alias("_pk")).dropDuplicates().withColumn("_hit", F.lit(True))
    j = df.join(p, df[col] == p["_pk"], "left")
    return j.withColumn("_orphan", F.col(col).isNotNull() & F.col("_hit").isNull()).drop("_pk", "_hit")


def item_scale_violations(requests: DataFrame, items_col: str = "items_text",
                          key: str = "request_id") -> DataFrame:
    """Lines of a JSON ``items`` text whose numbers carry more decimal places
    than the stored columns keep (quantity 3, price and discount 2, tax rate
    2). Decoding into the item schema fails on more than 4: this finds them
    beforehand.

    The text is decoded with a wide decimal type first, so nothing is lost
    before the comparison; one row per offending (invoice, line, field).
    """
    from pyspark.sql import types as T

    wide = T.DecimalType(38, 18)
    fields = {"quantity": 3, "unit_price": 2, "discount": 2, "tax_percent": 2}
    schema = T.ArrayType(T.StructType([T.StructField(f, wide) for f in fields]))
    lines = requests.select(key, F.posexplode(F.from_json(F.col(items_col), schema))
                            .alias("line_no", "_it"))
    checks = [lines.filter(F.col(f"_it.{f}").isNotNull()
                           & (F.round(F.col(f"_it.{f}"), places) != F.col(f"_it.{f}")))
              .select(F.lit("invoices").alias("table_name"), F.lit(f"scale:{f}").alias("rule"),
                      F.concat_ws("|", F.col(key).cast("string"),
                                  F.col("line_no").cast("string")).alias("row_key"),
                      F.col(f"_it.{f}").cast("string").alias("value"))
              for f, places in fields.items()]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
