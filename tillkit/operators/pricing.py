"""Invoice posting: pricing (B1 v1/v2/v3), numbering (B2), stock (B3), settle.

Two physical forms of the same pricing:

* ``price_invoices(requests)`` -- nested ``items`` arrays (the reference's
  JSONB column). The per-line fold is the higher-order ``aggregate`` over the
  array: a pure projection, no shuffle, NULL-poisoning exactly like the
  procedural ``v := v + x`` (N3), zeros for an empty array (N2).
* ``price_invoice_lines(headers, lines)`` -- normalised lines. One
  ``groupBy(invoice)`` with partial aggregation before the shuffle (a hot
  invoice is pre-summed on every map task), then a join back to the headers.

Both call ``_finalize`` so the invoice-level formula and the rounding on
store (N1) are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.functions import money as M
from tillkit.functions.text import invoice_number
from tillkit.operators.numbering import sequence_within
from tillkit.sources.schemas import ITEM, exact_items, parse_items

BALANCE = M.WORK

# Columns of a priced invoice (the ``invoices`` table), in table order.
INVOICE_COLUMNS = [
    "id", "tenant_id", "customer_id", "user_id", "subtotal", "discount_total",
    "tax_total", "grand_total", "payment_method", "payment_status", "notes",
    "table_id", "kot_id", "paid_amount", "balance", "invoice_status", "metadata",
    "bill_discount", "created_at",
]


def _version(version) -> M.PricingVersion:
    return M.VERSIONS[version] if isinstance(version, str) else version


def _created_at(df: DataFrame, as_of) -> F.Column:
    """X11: the request's own time when it carries one; otherwise ``as_of``,
    else the session's local time (NOW()).

    A stored time passes through untouched (no ``coalesce``), so report
    filters on it still reach the parquet scan.
    """
    now = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else F.localtimestamp()
    if "created_at" not in df.columns:
        return now
    if as_of is not None:
        return F.coalesce(F.col("created_at"), now)
    return F.col("created_at")


def _finalize(df: DataFrame, version: M.PricingVersion, key: str, as_of=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Invoice-level totals from the three folded sums ``_sub, _disc, _tax``."""
    sub, disc, tax = F.col("_sub"), F.col("_disc"), F.col("_tax")
    zero = F.lit(0).cast(M.WORK)
    if version.bill_discount:
        bill = M.bill_discount_from_metadata(F.col("metadata"))
    else:
        bill = zero
    grand = sub - disc - bill + tax
    if version.floor_at_zero:
        grand = F.greatest(zero, grand)   # GREATEST skips NULL in both engines (N3)
    cols = {
        "id": F.col(key),
        "tenant_id": F.col("tenant_id"),
        "customer_id": F.col("customer_id"),
        "user_id": F.col("user_id"),
        "subtotal": M.to_money(sub),
        "discount_total": M.to_money(disc + bill),
        "tax_total": M.to_money(tax),
        "grand_total": M.to_money(grand),
        "payment_method": F.col("payment_method"),
        # never set by the procedure: the column default (N6), unless bound
        "payment_status": (F.col("payment_status") if "payment_status" in df.columns
                           else F.lit("paid")),
        "notes": F.col("notes"),
        "table_id": F.col("table_id"),
        "kot_id": F.col("kot_id"),
        "created_at": _created_at(df, as_of),
    }
    if version.has_balance:
        cols["paid_amount"] = F.col("paid_amount")
        cols["balance"] = (grand - F.col("paid_amount")).cast(BALANCE)
        cols["invoice_status"] = F.col("invoice_status")
        cols["metadata"] = F.coalesce(F.col("metadata"), F.lit("{}"))
    if version.bill_discount:
        cols["bill_discount"] = bill
    extra = [c for c in df.columns if c == "items" or c in keep]
    return df.select(*[v.alias(k) for k, v in cols.items()], *extra)


def _items(requests: DataFrame) -> F.Column:
    """The ``items`` column as ``array<struct>``; JSON text (the reference's
    JSONB) is decoded into the item schema (S2), other decimal types must fit it."""
    kind = requests.schema["items"].dataType
    if isinstance(kind, T.StringType):
        return parse_items(F.col("items"))
    same = {f.name: f.dataType for f in kind.elementType.fields} == {f.name: f.dataType for f in ITEM.fields}
    return F.col("items") if same else exact_items(F.col("items"))


def price_invoices(requests: DataFrame, version="v3", key: str = "request_id",
                   as_of=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """B1 on nested requests; one output row per request, no shuffle.

    Requests without ``created_at`` are stamped ``as_of`` (default: now).
    ``keep``: columns beside the invoice's that go through as they are.
    """
    v = _version(version)
    zero = F.lit(0).cast(M.WORK)
    init = F.struct(zero.alias("sub"), zero.alias("disc"), zero.alias("tax"))

    def step(acc, item):
        lt, disc, tax = M.line_amounts(item["unit_price"], item["quantity"], item["discount"],
                                       item["discount_type"], item["tax_percent"], v)
        return F.struct((acc["sub"] + lt).cast(M.WORK).alias("sub"),
                        (acc["disc"] + disc).cast(M.WORK).alias("disc"),
                        (acc["tax"] + tax).cast(M.WORK).alias("tax"))

    items = F.coalesce(_items(requests), F.array().cast(T.ArrayType(ITEM)))
    folded = requests.withColumn("_acc", F.aggregate(items, init, step)).withColumns(
        {"_sub": F.col("_acc.sub"), "_disc": F.col("_acc.disc"), "_tax": F.col("_acc.tax")})
    return _finalize(folded, v, key, as_of, keep)


def line_totals(lines: DataFrame, version="v3", key: str = "invoice_id") -> DataFrame:
    """Per-invoice folded sums of normalised lines (partial aggregation)."""
    v = _version(version)
    kinds = {f.name: f.dataType for f in ITEM.fields if isinstance(f.dataType, T.DecimalType)}
    price, qty, discount, rate = (
        F.col(c) if lines.schema[c].dataType == kinds[c] else M.exact(F.col(c), kinds[c])
        for c in ("unit_price", "quantity", "discount", "tax_percent"))
    lt, disc, tax = M.line_amounts(price, qty, discount, F.col("discount_type"), rate, v)
    return (lines.select(F.col(key).alias("_key"), lt.alias("_lt"), disc.alias("_d"),
                         tax.alias("_t"))
                 .groupBy("_key")
                 .agg(M.strict_sum(F.col("_lt")).cast(M.WORK).alias("_sub"),
                      M.strict_sum(F.col("_d")).cast(M.WORK).alias("_disc"),
                      M.strict_sum(F.col("_t")).cast(M.WORK).alias("_tax"),
                      F.count(F.lit(1)).alias("_n")))


def price_invoice_lines(headers: DataFrame, lines: DataFrame, version="v3",
                        key: str = "request_id", line_key: str = "invoice_id",
                        restrict_to: DataFrame | None = None, as_of=None) -> DataFrame:
    """B1 on headers + normalised lines; invoices without lines price to zero.

    ``restrict_to`` (one column: invoice keys) semi-joins the lines before they
    are aggregated. Pass the keys of a filtered header scan (a date range):
    the semi join sits right above the line scan, so Spark's runtime bloom
    filter, built from the filtered keys, drops other lines in the scan
    before the shuffle instead of pricing every line.
    """
    v = _version(version)
    if restrict_to is not None:
        wanted = restrict_to.select(F.col(restrict_to.columns[0]).alias(line_key))
        lines = lines.join(wanted, line_key, "left_semi")
    totals = line_totals(lines, v, line_key)
    j = headers.join(totals, headers[key] == totals["_key"], "left")
    zero = F.lit(0).cast(M.WORK)
    has = F.col("_n").isNotNull()
    j = j.withColumns({c: F.when(has, F.col(c)).otherwise(zero) for c in ("_sub", "_disc", "_tax")})
    return _finalize(j, v, key, as_of)


def number_invoices(invoices: DataFrame, existing: DataFrame | None = None,
                    skew_safe: bool = True, seq: str | None = None) -> DataFrame:
    """``INV-<tenant>-<YYYYMMDD>-<seq4>`` per tenant and day.

    ``seq`` = the greatest number that tenant already has that day (``existing``
    must hold it under the same name; without one, the count of its rows) +
    position in the batch by (created_at, id). The reference counts at insert
    time; doing the whole batch in one job has no count-then-insert race, and a
    stored batch that shrank leaves no number to be given twice.
    """
    df = invoices.withColumn("_day", F.to_date("created_at"))
    out = sequence_within(df, ["tenant_id", "_day"], ["created_at", "id"], "_seq", skew_safe=skew_safe)
    if existing is not None:
        last = F.max(seq) if seq in existing.columns else F.count(F.lit(1))
        prior = (existing.groupBy(F.col("tenant_id").alias("_pt"),
                                  F.to_date("created_at").alias("_pd"))
                         .agg(last.alias("_prior")))
        cond = out["tenant_id"].eqNullSafe(prior["_pt"]) & (out["_day"] == prior["_pd"])
        out = (out.join(prior, cond, "left")
                  .withColumn("_seq", F.col("_seq") + F.coalesce(F.col("_prior"), F.lit(0)))
                  .drop("_pt", "_pd", "_prior"))
    if seq is not None:
        out = out.withColumn(seq, F.col("_seq"))
    return (out.withColumn("invoice_number",
                           invoice_number(F.col("tenant_id"), F.col("created_at"), F.col("_seq")))
               .drop("_day", "_seq"))


def sold_quantities(lines: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    """Units sold per (tenant, product); NULL when one quantity is NULL."""
    return (lines.groupBy(F.col(tenant_col).alias("_st"), F.col("product_id").alias("_sp"))
                 .agg(M.strict_sum(F.col("quantity")).alias("_sold")))


def deduct_stock(products: DataFrame, lines: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    """``stock_qty - units sold``, matched on product id *and* tenant.

    Every status counts, no floor at zero, unknown products are ignored (N4).
    Sold units are pre-aggregated (one row per key) before the join, so a hot
    product cannot skew it.
    """
    sold = sold_quantities(lines, tenant_col)
    cond = (products["tenant_id"] == sold["_st"]) & (products["id"] == sold["_sp"])
    j = products.join(sold, cond, "left")
    new_stock = F.when(F.col("_sp").isNull(), F.col("stock_qty")).otherwise(
        (F.col("stock_qty") - F.col("_sold")).cast(M.QTY))
    return j.withColumn("stock_qty", new_stock).drop("_st", "_sp", "_sold")


def explode_items(requests: DataFrame, keep: tuple[str, ...] = ("request_id", "tenant_id")) -> DataFrame:
    """One row per item of the nested form."""
    return requests.select(*keep, F.explode(_items(requests)).alias("_it")).select(
        *keep, *[F.col("_it")[f.name].alias(f.name) for f in ITEM.fields])


def settle_invoices(invoices: DataFrame, to_settle: DataFrame) -> DataFrame:
    """Mark invoices Paid: ``paid_amount = grand_total``, ``balance = 0``.

    ``to_settle`` holds (id, tenant_id); an id of another tenant is ignored
    (the route's ownership check).
    """
    keys = to_settle.select(F.col("id").alias("_sid"), F.col("tenant_id").alias("_stid")
                            ).dropDuplicates()
    cond = (invoices["id"] == keys["_sid"]) & (invoices["tenant_id"] == keys["_stid"])
    j = invoices.join(keys, cond, "left")
    hit = F.col("_sid").isNotNull()
    return (j.withColumn("invoice_status", F.when(hit, F.lit("Paid")).otherwise(F.col("invoice_status")))
             .withColumn("paid_amount", F.when(hit, F.col("grand_total")).otherwise(F.col("paid_amount")))
             .withColumn("balance", F.when(hit, F.lit(0).cast(BALANCE)).otherwise(F.col("balance")))
             .drop("_sid", "_stid"))
