"""Table maintenance as set-at-a-time transforms.

The reference changes one row per call (UPDATE ... WHERE id = p). Here each
operator takes the current table and a *table of changes* and returns the
new table, so one job applies any number of changes. Keys are joined with
equi-joins; duplicate changes are resolved with ``min_by`` -- an aggregate
with partial aggregation -- rather than a per-key window, so a hot key never
lands whole in one task.

Change tables must hold at most one row per key for patch / upsert / save: a
second change of a key fails the query (``one_per_key``), as PostgreSQL rejects
a second change of the same row in one statement.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillkit.functions import predicates as P
from tillkit.operators.numbering import assign_ids
from tillkit.sources import seeds
from tillkit.sources.tables import materialize

_MARK = "_chg"


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _key_cond(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str,
              null_safe: bool = False) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[prefix + k]) if null_safe else (left[k] == right[prefix + k])
        cond = c if cond is None else cond & c
    return cond


def _align(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like`` in its order and types; missing ones as NULL."""
    types = dict(like.dtypes)
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
                       for c in like.columns])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the least by ``order`` (rows with a NULL key all kept).

    ``min_by`` is partially aggregated on the map side, so a key holding a
    third of the rows is reduced before the shuffle.
    """
    cols = df.columns
    null_key = P.all_of(*[F.col(k).isNotNull() for k in keys])
    keyed, unkeyed = df.filter(null_key), df.filter(~null_key)
    # ties on ``order`` are broken by the remaining (orderable) columns, so a
    # recomputed partition picks the same row
    ties = [f.name for f in df.schema.fields
            if f.name not in order and not isinstance(f.dataType, T.MapType)]
    best = keyed.groupBy(*keys).agg(
        F.min_by(F.struct(*cols), F.struct(*order, *ties)).alias("_row")).select("_row.*")
    return best.select(*cols).unionByName(unkeyed.select(*cols))


def one_per_key(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``changes``, failing when two rows share a key (NULL keys may repeat).

    One aggregation on the keys, by which the join that follows is partitioned
    too.
    """
    rest = [c for c in changes.columns if c not in keys]
    null_key = P.all_of(*[F.col(k).isNotNull() for k in keys])
    keyed, unkeyed = changes.filter(null_key), changes.filter(~null_key)
    one = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"),
                                   F.first(F.struct(F.lit(1).alias("_"), *rest)).alias("_row"))
    checked = F.when(F.col("_rows") > 1, F.raise_error(F.lit(
        f"several changes of one key ({', '.join(keys)})")).cast(one.schema["_row"].dataType)
                     ).otherwise(F.col("_row"))
    return (one.withColumn("_row", checked).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
            .select(*changes.columns).unionByName(unkeyed))


# -------------------------------------------------------------------- M1

def patch(table: DataFrame, changes: DataFrame, keys: Sequence[str],
          fields: Iterable[str] | None = None) -> DataFrame:
    """M1: ``SET c = COALESCE(p_c, c)``: only non-NULL fields change.

    ``keys`` include the tenant where the reference tests it (id AND tenant).
    A field cannot be set to NULL. Rows without a change are unchanged.
    """
    fields = [c for c in (fields or changes.columns) if c not in keys and c in table.columns]
    ch = _prefixed(one_per_key(changes.select(*keys, *fields), keys), "_n_")
    j = table.join(ch, _key_cond(table, ch, keys, "_n_"), "left")
    out = [F.coalesce(F.col("_n_" + c), F.col(c)).alias(c) if c in fields else F.col(c)
           for c in table.columns]
    return j.select(*out)


# -------------------------------------------------------------------- M2

def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str],
           update: Iterable[str] | None = None) -> DataFrame:
    """M2: ``INSERT ... ON CONFLICT (keys) DO UPDATE SET update = EXCLUDED.update``.

    Matched rows take the ``update`` columns from the change (NULLs included)
    and keep the rest; unmatched changes are inserted (columns they lack are
    NULL). A full outer join on the unique key: no key is duplicated, so no
    key can skew it.
    """
    update = [c for c in (update or changes.columns) if c not in keys]
    ch = _prefixed(one_per_key(_align(changes, table), keys), "_n_").withColumn(_MARK, F.lit(True))
    old = table.withColumn("_old", F.lit(True))
    j = old.join(ch, _key_cond(old, ch, keys, "_n_"), "full_outer")
    hit_new, hit_old = F.col(_MARK).isNotNull(), F.col("_old").isNotNull()
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.when(hit_old, F.col(c)).otherwise(F.col("_n_" + c)).alias(c))
        elif c in update:
            out.append(F.when(hit_new, F.col("_n_" + c)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(hit_old, F.col(c)).otherwise(F.col("_n_" + c)).alias(c))
    return j.select(*out)


# -------------------------------------------------------------------- M3 / J10

def missing_only(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not exist yet (``left_anti``)."""
    ex = _prefixed(existing.select(*keys), "_e_")
    return rows.join(ex, _key_cond(rows, ex, keys, "_e_"), "left_anti")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str],
                  order: Sequence[str] | None = None) -> DataFrame:
    """M3: ``INSERT ... ON CONFLICT DO NOTHING`` on the unique ``keys``.

    Within ``rows`` the first by ``order`` wins; rows whose key exists are
    dropped; a NULL key never conflicts (as in a UNIQUE constraint).
    """
    new = dedupe_first(rows, keys, order or keys)
    new = missing_only(_align(new, table), table, keys)
    return table.unionByName(new)


# -------------------------------------------------------------------- M4

def save_by_id(table: DataFrame, changes: DataFrame, fields: Sequence[str],
               tenant_id_col: str | None = None, id_col: str = "id",
               order: Sequence[str] | None = None,
               defaults: Mapping[str, object] | None = None) -> DataFrame:
    """M4: id NULL or 0 inserts (new ids after the max); else overwrite ``fields``.

    Updates overwrite with the given values, NULLs included. With
    ``tenant_id_col`` the update only applies when the change's tenant matches
    the row, or the change's tenant is NULL (admin override, F10). Inserted
    rows get ``defaults`` for the columns they do not carry.
    """
    is_new = F.col(id_col).isNull() | (F.col(id_col) == 0)
    inserts, updates = changes.filter(is_new), changes.filter(~is_new)

    up = _prefixed(one_per_key(
        updates.select(id_col, *fields, *([tenant_id_col] if tenant_id_col else [])), [id_col]), "_n_")
    cond = table[id_col] == up["_n_" + id_col]
    if tenant_id_col:
        cond = cond & (up["_n_" + tenant_id_col].isNull()
                       | (table[tenant_id_col] == up["_n_" + tenant_id_col]))
    j = table.join(up, cond, "left")
    hit = F.col("_n_" + id_col).isNotNull()
    updated = j.select(*[F.when(hit, F.col("_n_" + c)).otherwise(F.col(c)).cast(t).alias(c)
                         if c in fields else F.col(c) for c, t in table.dtypes])

    ins = _with_defaults(inserts.drop(id_col), table, defaults or {})
    new = _append_with_ids(table.limit(0), ins,
                           list(order or [c for c in fields if c in inserts.columns]),
                           id_col, start_after=table.select(id_col))
    return updated.unionByName(new)


def _with_defaults(rows: DataFrame, table: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    types = dict(table.dtypes)
    for c, v in defaults.items():
        base = F.col(c) if c in rows.columns else F.lit(None)
        val = v if isinstance(v, Column) else F.lit(v)
        rows = rows.withColumn(c, F.coalesce(base.cast(types[c]), val.cast(types[c])))
    return rows


# -------------------------------------------------------------------- M5

def insert_with_defaults(table: DataFrame, rows: DataFrame, defaults: Mapping[str, object],
                         order: Sequence[str], id_col: str = "id") -> DataFrame:
    """M5: append rows with new ids (W2) and column defaults for missing/NULL values.

    ``order`` fixes which new row gets which id; it may name columns of
    ``rows`` that the table does not have.
    """
    return _append_with_ids(table, _with_defaults(rows, table, defaults), order, id_col)


# -------------------------------------------------------------------- M6 / M9 / M10 / M11

def _matched(table: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    k = _prefixed(keys_df.select(*keys).dropDuplicates(), "_k_").withColumn(_MARK, F.lit(True))
    return table.join(k, _key_cond(table, k, keys, "_k_"), "left")


def soft_delete(table: DataFrame, keys_df: DataFrame, keys: Sequence[str],
                flag: str = "is_active") -> DataFrame:
    """M6: ``SET is_active = FALSE`` for the matched keys."""
    j = _matched(table, keys_df, keys)
    hit = F.col(_MARK).isNotNull()
    return j.select(*[F.when(hit, F.lit(False)).otherwise(F.col(c)).alias(c) if c == flag
                      else F.col(c) for c in table.columns])


def cascade_deactivate(tenants: DataFrame, users: DataFrame,
                       tenant_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9: deactivate tenants and every user of those tenants."""
    ids = tenant_ids.select(F.col(tenant_ids.columns[0]).alias("id"))
    new_tenants = soft_delete(tenants, ids, ["id"])
    new_users = soft_delete(users, ids.withColumnRenamed("id", "tenant_id"), ["tenant_id"])
    return new_tenants, new_users


def toggle_active(users: DataFrame, requests: DataFrame, flag: str = "is_active") -> DataFrame:
    """``SET is_active = NOT is_active WHERE id = p AND (tenant_id = t OR t IS NULL)``.

    ``requests`` holds (id, tenant_id); a NULL tenant is the admin override.
    NULL stays NULL. A user that several requests match is toggled once.
    """
    # one row per user: whether any request is the admin's, and the tenants asked for
    r = requests.groupBy(F.col("id").alias("_r_id")).agg(
        F.max(F.col("tenant_id").isNull()).alias("_r_any"), F.collect_set("tenant_id").alias("_r_ts"))
    cond = (users["id"] == r["_r_id"]) & (
        F.col("_r_any") | F.array_contains("_r_ts", users["tenant_id"]))
    j = users.join(r, cond, "left")
    hit = F.col("_r_id").isNotNull()
    return j.select(*[F.when(hit, ~F.col(c)).otherwise(F.col(c)).alias(c) if c == flag
                      else F.col(c) for c in users.columns])


def hard_delete(table: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``DELETE`` of the matched keys (``left_anti``)."""
    return missing_only(table, keys_df, keys)


# -------------------------------------------------------------------- M12 / M13 / M14 / M15

def replace_set(table: DataFrame, owner_col: str, new_rows: DataFrame) -> DataFrame:
    """Delete every row of the owners present in ``new_rows``' owner set,
    then insert ``new_rows``."""
    owners = new_rows.select(owner_col).dropDuplicates()
    return hard_delete(table, owners, [owner_col]).unionByName(_align(new_rows, table))


def replace_sets(table: DataFrame, owner_col: str, owners: DataFrame,
                 new_rows: DataFrame) -> DataFrame:
    """M12 with an explicit owner list (owners may get an empty set)."""
    return hard_delete(table, owners.select(owner_col), [owner_col]).unionByName(
        _align(new_rows, table))


def grant_by_predicate(permissions: DataFrame, menus: DataFrame, role_id, routes: Iterable[str],
                       flags: Sequence[bool], role_col: str = "role_id") -> DataFrame:
    """``INSERT INTO perms SELECT role, id, flags FROM menus WHERE route IN (...)
    ON CONFLICT DO NOTHING``."""
    rows = menus.filter(P.route_in(routes)).select(
        F.lit(role_id).cast("int").alias(role_col), F.col("id").alias("menu_id"),
        *[F.lit(v).alias(c) for c, v in zip(seeds.PERMISSION_FIELDS, flags)])
    return insert_ignore(permissions, rows, [role_col, "menu_id"])


def grant_to_roles(permissions: DataFrame, menus: DataFrame, roles: DataFrame, routes: Iterable[str],
                   flags: Sequence[bool], role_col: str) -> DataFrame:
    """M13 for many roles (one column): the menus of the routes, where a role has no row for them yet.

    Menus are a fixed list: their ids are one array, exploded for each role.
    """
    ids = menus.filter(P.route_in(routes)).agg(F.collect_set("id").alias("ids")).scalar()
    kinds = dict(permissions.dtypes)
    rows = roles.select(F.col(roles.columns[0]).cast(kinds[role_col]).alias(role_col), F.explode(ids).alias("menu_id"))
    return insert_ignore(permissions, rows.select(
        "*", *[F.lit(v).alias(c) for c, v in zip(seeds.PERMISSION_FIELDS, flags)]), [role_col, "menu_id"])


def update_where(table: DataFrame, predicate: Column,
                 assignments: Mapping[str, Column | object]) -> DataFrame:
    """``UPDATE t SET c = v WHERE predicate`` (NULL predicate = no change)."""
    out = table
    hit = F.coalesce(predicate, F.lit(False))
    types = dict(table.dtypes)
    for c, v in assignments.items():
        val = v if isinstance(v, Column) else F.lit(v)
        out = out.withColumn(c, F.when(hit, val.cast(types[c])).otherwise(F.col(c)))
    return out


def add_column(table: DataFrame, name: str, default, data_type: str) -> DataFrame:
    """``ADD COLUMN IF NOT EXISTS name type DEFAULT default``."""
    if name in table.columns:
        return table
    return table.withColumn(name, F.lit(default).cast(data_type))


# -------------------------------------------------------------------- M7 / J5

#: Levels after which a tree is taken to be broken.
DEEPEST = 64


def category_paths(categories: DataFrame) -> DataFrame:
    """``categories`` with ``path`` (names from the top down) and ``depth``.

    Goes down a level at a time: the children of the last level are found by one
    equi-join on ``parent_id``, within the same tenant and business type. What
    hangs on no top (a circle, or a missing parent) is never reached and is not
    in the result.
    """
    rows = materialize(categories)
    tops = rows.filter(F.col("parent_id").isNull())
    frontier = tops.withColumns({"path": F.array("name"), "depth": F.lit(0)})
    found, kids = frontier, rows.filter(F.col("parent_id").isNotNull())
    for depth in range(1, DEEPEST + 1):
        above = frontier.select(F.col("id").alias("_pid"), F.col("path").alias("_pp"),
                                F.col("tenant_id").alias("_pt"), F.col("business_type_id").alias("_pb"))
        same = ((kids["parent_id"] == above["_pid"]) & kids["tenant_id"].eqNullSafe(above["_pt"])
                & kids["business_type_id"].eqNullSafe(above["_pb"]))
        frontier = materialize(kids.join(above, same).select(
            *categories.columns, F.concat("_pp", F.array("name")).alias("path"), F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise ValueError(f"categories of more than {DEEPEST} levels, or an id that occurs twice")


def provision_categories(worklist: DataFrame, categories: DataFrame) -> DataFrame:
    """M7 (categories) with J5: copy business-type templates to each tenant.

    ``worklist`` holds (tenant_id, business_type_id). A template of any depth is
    copied below the tenant's category of its parent's path, an own one or one
    copied now. Built as intended (N13): idempotent on (tenant_id, path), so a
    second run adds nothing. Templates whose parents form a circle, are dead, or
    are of another business type are not copied.

    Levels are walked over the templates and over what tenants have; the copies
    of all levels are made in one step, numbered level by level.
    """
    live = categories.filter(F.col("tenant_id").isNull() & P.is_live())
    shelf = category_paths(live).groupBy("business_type_id", "path").agg(
        F.first("depth").alias("depth"), F.first("name").alias("name"))
    wl = worklist.select(F.col("tenant_id").alias("_wt"), F.col("business_type_id").alias("_wb")).distinct()
    rows = shelf.join(wl, shelf["business_type_id"] == wl["_wb"]).select(
        "name", F.col("_wt").alias("tenant_id"), "business_type_id", F.lit(True).alias("is_active"), "path", "depth")
    own = category_paths(categories.filter(F.col("tenant_id").isNotNull())).groupBy("tenant_id", "path").agg(
        F.min("id").alias("id"))
    rows = missing_only(rows, own, ["tenant_id", "path"])
    new = materialize(assign_ids(rows, ["depth", "tenant_id", "path", "business_type_id"],
                                 start_after=categories.select("id")))
    above = new.groupBy("tenant_id", "path").agg(F.min("id").alias("id")).unionByName(own).select(
        F.col("tenant_id").alias("_at"), F.col("path").alias("_ap"), F.col("id").alias("_aid"))
    up = F.slice("path", F.lit(1), F.col("depth"))
    linked = new.join(above, (new["tenant_id"] == above["_at"]) & (up == above["_ap"]), "left")
    return categories.unionByName(_align(linked.withColumn("parent_id", F.col("_aid")), categories))


def _append_with_ids(table: DataFrame, rows: DataFrame, order: Sequence[str],
                     id_col: str = "id", start_after: DataFrame | None = None) -> DataFrame:
    """Append ``rows`` with ids after the table's max id, numbered by ``order``
    (order columns that are not table columns are used, then dropped)."""
    types = dict(table.dtypes)
    cols = [(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c)
            for c in table.columns if c != id_col]
    extra = [F.col(o) for o in order if o not in types]
    base = start_after if start_after is not None else table.select(id_col)
    new = assign_ids(rows.select(*cols, *extra), list(order), start_after=base, out=id_col)
    return table.unionByName(_align(new, table))


def _provision_copies(worklist: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """A copy of every live template (``tenant_id`` NULL) for each tenant of
    ``worklist``, unless the tenant has that key already.

    Templates are masters: a few rows, exploded per tenant from one collected
    array instead of a product of two tables.
    """
    fields = [c for c in table.columns if c not in ("id", "tenant_id")]
    shelf = table.filter(F.col("tenant_id").isNull() & P.is_live()).agg(
        F.collect_list(F.struct(*fields)).alias("_all"))
    rows = (worklist.select(F.col("tenant_id").cast("int").alias("tenant_id"))
            .withColumn("_all", shelf.scalar()).select("tenant_id", F.explode("_all").alias("_t"))
            .select("tenant_id", *[F.col("_t")[c].alias(c) for c in fields]))
    rows = missing_only(dedupe_first(rows, ["tenant_id", key], [key]), table, ["tenant_id", key])
    return _append_with_ids(table, rows, ["tenant_id", key])


def provision_uoms(worklist: DataFrame, uoms: DataFrame) -> DataFrame:
    """M7 (UOM): copies of the template units, idempotent on (tenant_id, abbreviation)."""
    return _provision_copies(worklist, uoms, "abbreviation")


def provision_hsns(worklist: DataFrame, hsns: DataFrame) -> DataFrame:
    """M7 (HSN): copies of the template codes with all their rates, idempotent
    on (tenant_id, hsn_code)."""
    return _provision_copies(worklist, hsns, "hsn_code")


# -------------------------------------------------------------------- M8 / M16

def create_tenants(tenants: DataFrame, new_tenants: DataFrame, business_types: DataFrame,
                   features_by_type: DataFrame, tenant_features: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """M8: insert tenants (new ids), link their business type (J7, N15) and
    seed their feature flags by business type (insert-ignore).

    Unknown business types get no features (inner join, N16).
    """
    from tillkit.operators.access import link_business_types

    order = [c for c in ("name", "business_type") if c in new_tenants.columns]
    t2 = insert_with_defaults(tenants, new_tenants,
                              {"is_active": True, "theme_color": seeds.DEFAULT_THEME_COLOR},
                              order)
    t2 = link_business_types(t2, business_types)
    added = missing_only(t2, tenants, ["id"])
    f = features_by_type
    rows = added.join(f, added["business_type"] == f["business_type"]).select(
        F.col("id").alias("tenant_id"), "feature_key", "enabled")
    return t2, insert_ignore(tenant_features, rows, ["tenant_id", "feature_key"])


def add_menu_with_grants(menus: DataFrame, permissions: DataFrame, name: str, route: str,
                         icon: str, parent_name: str | None, sort_order: int,
                         grants: Sequence[tuple[int, bool, bool, bool, bool]]
                         ) -> tuple[DataFrame, DataFrame]:
    """Add a menu under a parent found by name, only if its route is new,
    then upsert the given role grants for it."""
    spark = menus.sparkSession
    row = spark.createDataFrame([(name, route, icon, sort_order)],
                                "name string, route string, icon string, sort_order int")
    row = missing_only(row, menus, ["route"])
    if parent_name is not None:
        parent = menus.filter((F.col("name") == parent_name) & F.col("parent_id").isNull()
                              ).groupBy().agg(F.min("id").alias("_pid"))
        row = row.withColumn("parent_id", parent.select("_pid").scalar())
    row = row.withColumn("is_active", F.lit(True))
    new_menus = _append_with_ids(menus, row, ["route"])
    mid = new_menus.filter(F.col("route") == route).select(F.min("id")).scalar()
    g = spark.createDataFrame(list(grants),
                              "role_id int, can_view boolean, can_add boolean, "
                              "can_edit boolean, can_delete boolean").withColumn(
        "menu_id", mid.cast("int"))
    return new_menus, upsert(permissions, g, ["role_id", "menu_id"])


def create_business_types(business_types: DataFrame, rows: DataFrame) -> DataFrame:
    """M5 for business types: the name defaults to the slug of the label
    (X14: lower case, spaces to '_'), features default to an empty array."""
    from tillkit.functions.text import slug

    named = rows.withColumn("name", F.coalesce(F.col("name"), slug(F.col("label")))
                            if "name" in rows.columns else slug(F.col("label")))
    new = missing_only(named, business_types, ["name"])          # UNIQUE(name)
    return insert_with_defaults(business_types, new,
                                {"default_features": F.array().cast("array<string>"),
                                 "is_active": True}, ["name"])


def save_uoms(uoms: DataFrame, changes: DataFrame, tenant_id_col: str | None = "tenant_id"
              ) -> DataFrame:
    """M4 for units: abbreviations are stored upper-case."""
    ch = changes.withColumn("abbreviation", F.upper(F.col("abbreviation")))
    return save_by_id(uoms, ch, ["name", "abbreviation"], tenant_id_col=tenant_id_col,
                      order=["name", "abbreviation"], defaults={"is_active": True})
