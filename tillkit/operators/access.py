"""Users, roles and permission resolution by joins.

The reference resolves one user per request; these transforms resolve every
user at once. Role and menu tables are small dimensions: they are broadcast
behind a size check (``broadcast_if_small``), so the large users side is
never shuffled for them, and a few hot role ids cannot skew a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillkit.functions import predicates as P
from tillkit.functions.ordering import nulls_first, pg_asc, pg_desc
from tillkit.functions.text import default_if_blank, label, permission_summary
from tillkit.sources import seeds

PERMS = seeds.PERMISSION_FIELDS
MENU_OUT = ["menu_id", "menu_name", "route", "icon", "parent_id", "sort_order", *PERMS]


def login_rows(users: DataFrame, roles: DataFrame, username=None,
               active_only: bool = True) -> DataFrame:
    """User joined to its role (v2 keeps only active users).

    The password check is not part of the row set (not built).
    """
    r = roles.select(F.col("id").alias("_rid"), F.col("name").alias("role_name"))
    u = users
    if username is not None:
        u = u.filter(F.col("username") == F.lit(username))
    if active_only:
        u = u.filter(P.is_live())
    j = u.join(r, u["role_id"] == r["_rid"], "inner")
    cols = ["id", "username", "full_name", "email", "role_id", "role_name", "tenant_id",
            "tenant_role_id", "is_active"]
    return j.select(*[c for c in cols if c in j.columns])


def list_users(users: DataFrame, roles: DataFrame, tenant_roles: DataFrame, tenants: DataFrame,
               viewer_role_id=None, tenant_id=None, all_tenants: bool = False) -> DataFrame:
    """Users with role, tenant role and tenant.

    Super admin (role 1) sees every user but super admins, ordered by tenant
    then newest; anyone else sees the staff (role 3) of their own tenant. A
    NULL role goes to the second branch, as PostgreSQL's IF does.
    ``all_tenants`` runs the second branch for every tenant at once.
    """
    r = roles.select(F.col("id").alias("_rid"), F.col("name").alias("role_name"))
    tr = tenant_roles.select(F.col("id").alias("_trid"), F.col("name").alias("tenant_role_name"))
    t = tenants.select(F.col("id").alias("_tid"), F.col("name").alias("tenant_name"),
                       "business_type")
    if viewer_role_id == 1:
        u = users.filter(F.col("role_id") != 1)
        order = [pg_asc("tenant_id"), pg_desc("created_at")]
    else:
        scope = F.col("tenant_id").isNotNull() if all_tenants else P.tenant_is(tenant_id)
        u = users.filter(scope & (F.col("role_id") == 3))
        order = ([pg_asc("tenant_id")] if all_tenants else []) + [pg_desc("created_at")]
    j = (u.join(r, u["role_id"] == r["_rid"], "inner")
          .join(tr, F.col("tenant_role_id") == tr["_trid"], "left")
          .join(t, F.col("tenant_id") == t["_tid"], "left"))
    return j.select("id", "username", "full_name", "role_id", "role_name", "tenant_id",
                    "tenant_role_id", "tenant_role_name", "tenant_name", "business_type",
                    "is_active", "created_at").orderBy(*order, pg_asc("id"))


def _menu_cols(m: DataFrame) -> DataFrame:
    return m.filter(P.is_live()).select(
        F.col("id").alias("menu_id"), F.col("name").alias("menu_name"), "route",
        F.coalesce(F.col("icon"), F.lit(seeds.DEFAULT_MENU_ICON)).alias("icon"),
        "parent_id", F.coalesce(F.col("sort_order"), F.lit(0)).alias("sort_order"))


def user_menus(users: DataFrame, menus: DataFrame, role_permissions: DataFrame,
               tenant_role_permissions: DataFrame) -> DataFrame:
    """J3 (latest): the menus each user may view.

    A user with a tenant role gets the tenant-role permissions; any other user
    gets the permissions of their system role. Both branches are inner joins,
    combined by ``unionByName``. Order per user: parent NULLS FIRST,
    sort order, name.
    """
    m = _menu_cols(menus)
    u = users.select(F.col("id").alias("user_id"), "role_id", "tenant_role_id")

    trp = tenant_role_permissions.filter(F.col("can_view") == True)  # noqa: E712
    by_tenant_role = (u.filter(F.col("tenant_role_id").isNotNull())
                       .join(trp, "tenant_role_id", "inner"))
    rp = role_permissions.filter(F.col("can_view") == True)  # noqa: E712
    by_role = (u.filter(F.col("tenant_role_id").isNull())
                .join(rp, "role_id", "inner"))
    keep = ["user_id", "menu_id", *PERMS]
    both = by_tenant_role.select(*keep).unionByName(by_role.select(*keep))
    out = both.join(m, "menu_id", "inner")
    # a user's menus are together and in order; users are in no order
    return out.select("user_id", *MENU_OUT).repartition("user_id").sortWithinPartitions(
        pg_asc("user_id"), nulls_first("parent_id"), pg_asc("sort_order"), pg_asc("menu_name"))


def role_menus_v1(menus: DataFrame, role_permissions: DataFrame, role_id) -> DataFrame:
    """J3 v1: menus of one system role, ordered by sort order then id."""
    m = menus.filter(P.is_live())
    rp = role_permissions.filter((F.col("role_id") == F.lit(role_id)) & (F.col("can_view") == True))  # noqa: E712
    j = m.join(rp, m["id"] == rp["menu_id"], "inner")
    return j.select(F.col("id").alias("menu_id"), F.col("name").alias("menu_name"), "route",
                    "icon", "parent_id", "sort_order", *PERMS).orderBy(pg_asc("sort_order"),
                                                                        pg_asc("menu_id"))


def menu_access_log(requests: DataFrame, action: str = "GET_MENUS",
                    resource: str = "menus") -> DataFrame:
    """Audit rows for menu requests, only when the tenant is not NULL."""
    return requests.filter(F.col("tenant_id").isNotNull()).select(
        "user_id", "tenant_id", F.lit(action).alias("action"), F.lit(resource).alias("resource"))


def tenant_role_menu_config(menus: DataFrame, tenant_role_permissions: DataFrame,
                            tenant_role_id) -> DataFrame:
    """Every assignable menu with the role's flags, FALSE when none.

    The role test sits in the ON clause of the left join (not in WHERE), so
    menus without a permission row are kept.
    """
    m = _menu_cols(menus).filter(P.route_in(seeds.SUPER_ADMIN_ONLY_ROUTES, negate=True))
    trp = tenant_role_permissions.filter(F.col("tenant_role_id") == F.lit(tenant_role_id))
    j = m.join(trp.drop("tenant_role_id"), "menu_id", "left")
    return j.select("menu_id", "menu_name", "route", "icon", "parent_id", "sort_order",
                    *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in PERMS]).orderBy(
        nulls_first("parent_id"), pg_asc("sort_order"), pg_asc("menu_name"))


def tenant_role_menu_configs(menus: DataFrame, roles: DataFrame,
                             tenant_role_permissions: DataFrame) -> DataFrame:
    """J4 for every role of ``roles`` (id): each assignable menu with its flags.

    Menus are a fixed enumeration: they are exploded per role from one
    collected array instead of a product of two tables.
    """
    m = _menu_cols(menus).filter(P.route_in(seeds.SUPER_ADMIN_ONLY_ROUTES, negate=True)).select(
        "menu_id", "menu_name", "route", "icon", "parent_id", "sort_order")
    shelf = m.agg(F.collect_list(F.struct(*m.columns)).alias("_all"))
    every = (roles.select(F.col("id").alias("tenant_role_id")).withColumn("_all", shelf.scalar())
             .select("tenant_role_id", F.explode("_all").alias("_m")).select("tenant_role_id", "_m.*"))
    j = every.join(tenant_role_permissions, ["tenant_role_id", "menu_id"], "left")
    return j.select("tenant_role_id", *m.columns,
                    *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in PERMS])


def link_business_types(tenants: DataFrame, business_types: DataFrame) -> DataFrame:
    """Fill ``business_type_id`` from the type's name where it is NULL."""
    bt = business_types.select(F.col("id").alias("_btid"), F.col("name").alias("_btname"))
    j = tenants.join(bt, tenants["business_type"] == bt["_btname"], "left")
    return j.withColumn("business_type_id", F.coalesce(F.col("business_type_id"), F.col("_btid"))
                        ).drop("_btid", "_btname")


def tenant_business_type(tenants: DataFrame, business_types: DataFrame) -> DataFrame:
    """Tenant -> its business type row, NULLs when none is linked."""
    bt = business_types.select(F.col("id").alias("_btid"), F.col("name").alias("business_type_name"),
                               F.col("label").alias("business_type_label"))
    j = tenants.join(bt, tenants["business_type_id"] == bt["_btid"], "left")
    return j.select(F.col("id").alias("tenant_id"), "business_type_id", "business_type_name",
                    "business_type_label")


def permission_matrix(menus: DataFrame, role_permissions: DataFrame,
                      roles=tuple(seeds.ROLES)) -> DataFrame:
    """Every live menu with one permission entry per system role.

    System roles are a fixed enumeration, so the role list is a literal array
    and each menu row expands it with ``transform``; flags come from a
    per-menu map of its permission rows (at most one per role), FALSE when
    missing. No cross join, no per-menu collect of unbounded size.
    """
    perm_struct = F.struct(*[F.col(c).alias(c) for c in PERMS])
    per_menu = (role_permissions.groupBy(F.col("menu_id").alias("_mid"))
                .agg(F.map_from_entries(F.collect_list(F.struct("role_id", perm_struct)))
                     .alias("_perm")))
    role_arr = F.array(*[F.struct(F.lit(i).cast("int").alias("role_id"),
                                  F.lit(n).alias("role_name")) for i, n in roles])
    m = menus.filter(P.is_live())
    j = m.join(per_menu, m["id"] == per_menu["_mid"], "left")

    def entry(r):
        p = F.try_element_at(F.col("_perm"), r["role_id"])
        return F.struct(r["role_id"].alias("role_id"), r["role_name"].alias("role_name"),
                        label(r["role_name"]).alias("role_label"),
                        *[F.coalesce(p[c], F.lit(False)).alias(c) for c in PERMS])

    return j.select("id", "name", "route", "icon", "parent_id", "sort_order",
                    F.transform(role_arr, entry).alias("permissions")).orderBy(
        nulls_first("parent_id"), pg_asc("sort_order"), pg_asc("name"))


def owned_by_tenant(requests: DataFrame, owners: DataFrame, key: str = "id",
                    tenant_col: str = "tenant_id") -> DataFrame:
    """Keep requests whose (key, tenant) exists in ``owners`` (semi join)."""
    o = owners.select(F.col(key).alias("_ok"), F.col(tenant_col).alias("_ot"))
    cond = (requests[key] == o["_ok"]) & (requests[tenant_col] == o["_ot"])
    return requests.join(o, cond, "left_semi")


def tenants_with_features(tenants: DataFrame, tenant_features: DataFrame,
                          business_type: str) -> DataFrame:
    """Tenants of one business type with their feature rows (left join)."""
    t = tenants.filter(F.col("business_type") == F.lit(business_type)).select(
        F.col("id").alias("_tid"), F.col("name").alias("tenant_name"), "business_type")
    j = t.join(tenant_features, t["_tid"] == tenant_features["tenant_id"], "left")
    return j.drop("_tid")


def permission_listing(role_permissions: DataFrame, roles: DataFrame,
                       menus: DataFrame) -> DataFrame:
    """Role name, menu, route and a 'View, Add, Edit, Delete' summary."""
    r = roles.select(F.col("id").alias("_rid"), F.col("name").alias("role_name"))
    m = menus.select(F.col("id").alias("_mid"), F.col("name").alias("menu_name"), "route")
    j = (role_permissions.join(r, role_permissions["role_id"] == r["_rid"])
         .join(m, F.col("menu_id") == m["_mid"]))
    summary = permission_summary(*[F.col(c) for c in PERMS])
    return j.select("role_id", "role_name", "menu_id", "menu_name", "route",
                    F.coalesce(F.nullif(summary, F.lit("")), F.lit("None")).alias("flags"))


def provisioning_worklist(tenants: DataFrame, business_types: DataFrame) -> DataFrame:
    """Live tenants that have a business type (inner join)."""
    bt = business_types.select(F.col("id").alias("_btid"), F.col("name").alias("biz_name"))
    t = tenants.filter(P.is_live() & F.col("business_type_id").isNotNull())
    j = t.join(bt, t["business_type_id"] == bt["_btid"], "inner")
    return j.select("id", "name", "business_type_id", "biz_name")


def user_branding(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """F14 per user: tenant name and theme, defaults for users without a tenant."""
    t = tenants.select(F.col("id").alias("_tid"), F.col("name").alias("_tname"),
                       F.col("theme_color").alias("_theme"))
    j = users.join(t, users["tenant_id"] == t["_tid"], "left")
    return j.select(F.col("id").alias("user_id"), "tenant_id",
                    default_if_blank(F.col("_tname"), seeds.DEFAULT_TENANT_NAME).alias("tenant_name"),
                    default_if_blank(F.col("_theme"), seeds.DEFAULT_THEME_COLOR).alias("theme_color"))


def feature_map(tenant_features: DataFrame) -> DataFrame:
    """One ``map<feature_key, enabled>`` per tenant (bounded by feature keys)."""
    return (tenant_features.groupBy("tenant_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("feature_key", "enabled")))
                 .alias("features")))


def active_users_per_tenant_role(users: DataFrame) -> DataFrame:
    """Active users per tenant role (the guard of deleting a role)."""
    return (users.filter(P.is_live() & F.col("tenant_role_id").isNotNull())
            .groupBy("tenant_role_id").agg(F.count(F.lit(1)).alias("active_users")))


def menu_response(users: DataFrame, menus: DataFrame, role_permissions: DataFrame,
                  tenant_role_permissions: DataFrame, tenant_features: DataFrame,
                  tenants: DataFrame) -> DataFrame:
    """Path 3 for every user: menus (J3, without ``can_edit`` as in the
    response), feature map (A8, empty without a tenant) and branding (F14).

    The per-user menu list is bounded by the menu table; it is collected with
    ``collect_list`` of structs whose first field is the tree position, then
    sorted, so the order is the J3 order.
    """
    um = user_menus(users, menus, role_permissions, tenant_role_permissions)
    pos = F.struct(F.col("parent_id").isNotNull().alias("_child"),
                   F.coalesce(F.col("parent_id"), F.lit(0)).alias("_parent"),
                   F.col("sort_order").alias("_sort"), F.col("menu_name").alias("_name"))
    item = F.struct(pos.alias("_pos"), F.col("menu_id").alias("id"),
                    F.col("menu_name").alias("name"), "route", "icon", "parent_id",
                    "sort_order", "can_view", "can_add", "can_delete")
    per_user = um.groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("_m"))
    per_user = per_user.select("user_id", F.transform("_m", lambda x: x.dropFields("_pos"))
                               .alias("menus"))
    feats = feature_map(tenant_features)
    brand = user_branding(users, tenants)
    out = (brand.join(per_user, "user_id", "left")
           .join(feats, "tenant_id", "left"))
    no_tenant = F.col("tenant_id").isNull()
    return out.select(
        "user_id", "tenant_id",
        F.coalesce(F.col("menus"), F.array().cast(per_user.schema["menus"].dataType)).alias("menus"),
        F.when(no_tenant | F.col("features").isNull(),
               F.create_map().cast("map<string,boolean>")).otherwise(F.col("features")).alias("features"),
        "theme_color", "tenant_name")
