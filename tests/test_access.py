import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillkit.operators import access, listing
from tillkit.sources import seeds


@pytest.fixture(scope="module")
def fx(spark):
    users = spark.createDataFrame(
        [(1, "root", None, 1, None, None, True, dt.date(2024, 1, 1)),
         (2, "boss", None, 2, 5, None, True, dt.date(2024, 1, 2)),
         (3, "cashier", None, 3, 5, 70, True, dt.date(2024, 1, 3)),
         (4, "staff", None, 3, 5, None, False, dt.date(2024, 1, 4)),
         (5, "other", None, 3, 6, None, True, dt.date(2024, 1, 5))],
        "id long, username string, full_name string, role_id int, tenant_id int, "
        "tenant_role_id long, is_active boolean, created_at date")
    trp = spark.createDataFrame([(70, 1, True, False, False, False), (70, 3, False, True, True, True)],
                                "tenant_role_id long, menu_id int, can_view boolean, can_add boolean, "
                                "can_edit boolean, can_delete boolean")
    tenants = spark.createDataFrame([(5, "Shop", "bakery", None, True, None), (6, "", "x", None, True, "")],
                                    "id int, name string, business_type string, business_type_id int, "
                                    "is_active boolean, theme_color string")
    troles = spark.createDataFrame([(70, 5, "Cashier", True)], "id long, tenant_id int, name string, is_active boolean")
    return dict(users=users, trp=trp, tenants=tenants, troles=troles, menus=seeds.menus(spark),
                rp=seeds.role_grants(spark), roles=seeds.roles(spark))


def test_user_menus_branches(fx):
    out = access.user_menus(fx["users"], fx["menus"], fx["rp"], fx["trp"])
    per = {}
    for r in out.collect():
        per.setdefault(r.user_id, []).append(r.menu_id)
    assert per[3] == [1]                       # tenant role: only viewable rows
    assert len(per[1]) == 12                   # super admin: every menu
    assert 7 in per[2] and 6 not in per[2]     # tenant admin grants
    # tree order: top level first by sort order, then children
    assert per[1][:7] == [1, 2, 3, 4, 5, 6, 7]


def test_login_rows_active_only(fx):
    rows = access.login_rows(fx["users"], fx["roles"]).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3, 5]
    assert {r.id: r.role_name for r in rows}[3] == "staff"


def test_list_users_branches(fx):
    admin = access.list_users(fx["users"], fx["roles"], fx["troles"], fx["tenants"], viewer_role_id=1)
    assert [r.id for r in admin.collect()] == [4, 3, 2, 5]   # by tenant, newest first
    staff = access.list_users(fx["users"], fx["roles"], fx["troles"], fx["tenants"], viewer_role_id=2, tenant_id=5)
    rows = staff.collect()
    assert [r.id for r in rows] == [4, 3] and rows[1].tenant_role_name == "Cashier"
    none = access.list_users(fx["users"], fx["roles"], fx["troles"], fx["tenants"], viewer_role_id=None, tenant_id=None)
    assert none.count() == 0


def test_tenant_role_menu_config_defaults_false(fx):
    rows = access.tenant_role_menu_config(fx["menus"], fx["trp"], 70).collect()
    routes = {r.route for r in rows}
    assert "settings/menus" not in routes and "settings/tenants" not in routes
    byid = {r.menu_id: r for r in rows}
    assert byid[1].can_view is True and byid[2].can_view is False and byid[3].can_delete is True


def test_permission_matrix_and_listing(fx):
    m = {r.id: r for r in access.permission_matrix(fx["menus"], fx["rp"]).collect()}
    reports = m[5].permissions
    assert [p.role_id for p in reports] == [1, 2, 3]
    assert [p.can_view for p in reports] == [True, True, False]
    assert reports[1].role_label == "Tenant Admin"
    listing_rows = access.permission_listing(fx["rp"], fx["roles"], fx["menus"]).collect()
    flags = {(r.role_id, r.menu_id): r.flags for r in listing_rows}
    assert flags[(1, 1)] == "View, Add, Edit, Delete" and flags[(3, 1)] == "View, Add"
    none = fx["trp"].withColumnRenamed("tenant_role_id", "role_id").filter("menu_id = 1")
    none = none.withColumn("can_view", F.lit(False))
    r = access.permission_listing(none.withColumn("role_id", F.lit(1)), fx["roles"], fx["menus"]).first()
    assert r.flags == "None"


def test_business_types_and_branding(spark, fx):
    bt = seeds.business_types(spark)
    linked = access.link_business_types(fx["tenants"], bt)
    got = {r.tenant_id: r.business_type_name for r in access.tenant_business_type(linked, bt).collect()}
    assert got == {5: "bakery", 6: None}
    brand = {r.user_id: (r.tenant_name, r.theme_color) for r in access.user_branding(fx["users"], fx["tenants"]).collect()}
    assert brand[1] == ("Billing", "#6366F1")
    assert brand[3] == ("Shop", "#6366F1")
    assert brand[5] == ("Billing", "#6366F1")
    wl = access.provisioning_worklist(linked, bt).collect()
    assert [(r.id, r.biz_name) for r in wl] == [(5, "bakery")]


def test_features_map_and_listings(spark, fx):
    feats = spark.createDataFrame([(5, "kot", True), (5, "barcode", False)],
                                  "tenant_id int, feature_key string, enabled boolean")
    m = access.feature_map(feats).first()
    assert m.features == {"kot": True, "barcode": False}
    tree = [r.id for r in listing.menu_tree(fx["menus"]).collect()]
    assert tree == list(range(1, 13))          # parents first, then children by parent
    assert [r.name for r in listing.admin_visible_roles(fx["roles"]).collect()] == ["tenant_admin"]
    semi = access.owned_by_tenant(
        spark.createDataFrame([(70, 5), (70, 6)], "id long, tenant_id int"), fx["troles"]).collect()
    assert [(r.id, r.tenant_id) for r in semi] == [(70, 5)]
    log = access.menu_access_log(fx["users"].select(F.col("id").alias("user_id"), "tenant_id")).count()
    assert log == 4


def test_menu_response_per_user(spark, fx):
    feats = spark.createDataFrame([(5, "kot", True)], "tenant_id int, feature_key string, enabled boolean")
    out = {r.user_id: r for r in access.menu_response(fx["users"], fx["menus"], fx["rp"], fx["trp"],
                                                       feats, fx["tenants"]).collect()}
    assert [m.id for m in out[1].menus] == list(range(1, 13))
    assert out[1].features == {} and out[1].tenant_name == "Billing"
    assert [m.id for m in out[3].menus] == [1] and out[3].features == {"kot": True}
    assert "can_edit" not in out[3].menus[0].asDict()
    assert out[5].menus and out[5].features == {}
