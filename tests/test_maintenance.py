from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillkit.operators import maintenance as M
from tillkit.sources import seeds


@pytest.fixture
def products(spark):
    return spark.createDataFrame(
        [(1, 1, "Tea", D("10.00"), True), (2, 1, "Milk", D("5.00"), True), (3, 2, "Tea", D("7.00"), None)],
        "id long, tenant_id int, name string, price decimal(12,2), is_active boolean")


def rows(df, key="id"):
    return {r[key]: tuple(r) for r in df.collect()}


def test_patch_only_non_null_fields_and_tenant(spark, products):
    ch = spark.createDataFrame([(1, 1, None, D("11.00")), (3, 1, "X", None)],
                               "id long, tenant_id int, name string, price decimal(12,2)")
    got = rows(M.patch(products, ch, ["id", "tenant_id"]))
    assert got[1] == (1, 1, "Tea", D("11.00"), True)
    assert got[3] == (3, 2, "Tea", D("7.00"), None)          # other tenant: untouched
    nulls = ch.select("id", "tenant_id", F.lit(None).cast("string").alias("name"),
                      F.lit(None).cast("decimal(12,2)").alias("price"))
    assert rows(M.patch(products, nulls, ["id", "tenant_id"])) == rows(products)   # identity


def test_upsert_and_idempotence(spark):
    perms = seeds.role_grants(spark)
    ch = spark.createDataFrame([(3, 5, True, False, False, False), (3, 1, False, False, False, False)],
                               "role_id int, menu_id int, can_view boolean, can_add boolean, "
                               "can_edit boolean, can_delete boolean")
    once = M.upsert(perms, ch, ["role_id", "menu_id"])
    twice = M.upsert(once, ch, ["role_id", "menu_id"])
    assert once.count() == perms.count() + 1
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    got = {(r.role_id, r.menu_id): r.can_view for r in once.collect()}
    assert got[(3, 5)] is True and got[(3, 1)] is False
    part = M.upsert(perms, ch.select("role_id", "menu_id", "can_view"), ["role_id", "menu_id"],
                    update=["can_view"])
    kept = {(r.role_id, r.menu_id): r.can_add for r in part.collect()}
    assert kept[(3, 1)] is True                               # partial column form keeps can_add


def test_insert_ignore_first_wins_and_null_keys(spark):
    t = spark.createDataFrame([(1, "PCS")], "id int, abbreviation string")
    new = spark.createDataFrame([(2, "PCS", 1), (3, "KG", 2), (4, "KG", 1), (5, None, 1), (6, None, 2)],
                                "id int, abbreviation string, pos int")
    out = M.insert_ignore(t, new, ["abbreviation"], order=["pos"])
    assert sorted(r.id for r in out.collect()) == [1, 4, 5, 6]
    again = M.insert_ignore(out, new, ["abbreviation"], order=["pos"])
    assert again.count() == out.count() + 2                    # NULL keys never conflict


def test_save_by_id_updates_and_inserts(spark):
    t = spark.createDataFrame([(1, 1, "Cashier", True), (2, 2, "Cook", True)],
                              "id long, tenant_id int, name string, is_active boolean")
    ch = spark.createDataFrame([(1, 1, "Head Cashier"), (2, 9, "Nope"), (0, 1, "Manager"), (None, 2, "Chef")],
                               "id long, tenant_id int, name string")
    got = rows(M.save_by_id(t, ch, ["name"], tenant_id_col="tenant_id",
                            order=["tenant_id", "name"], defaults={"is_active": True}))
    assert got[1][2] == "Head Cashier" and got[2][2] == "Cook"
    assert got[3] == (3, 1, "Manager", True) and got[4] == (4, 2, "Chef", True)


def test_soft_toggle_hard_delete(spark):
    u = spark.createDataFrame([(1, 1, True), (2, 1, None), (3, 2, False)],
                              "id long, tenant_id int, is_active boolean")
    req = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id long, tenant_id int")
    got = {r.id: r.is_active for r in M.toggle_active(u, req).collect()}
    assert got == {1: False, 2: None, 3: False}
    ids = spark.createDataFrame([(1,)], "id int")
    t2, u2 = M.cascade_deactivate(spark.createDataFrame([(1, True), (2, True)], "id int, is_active boolean"), u, ids)
    assert {r.id: r.is_active for r in t2.collect()} == {1: False, 2: True}
    assert {r.id: r.is_active for r in u2.collect()} == {1: False, 2: False, 3: False}
    assert [r.id for r in M.hard_delete(u, ids.withColumn("id", F.col("id").cast("long")), ["id"]).collect()] == [2, 3]


def test_replace_grant_update_add_column(spark):
    perms = seeds.role_grants(spark)
    new = spark.createDataFrame([(3, 5, True, False, False, False)],
                                "role_id int, menu_id int, can_view boolean, can_add boolean, "
                                "can_edit boolean, can_delete boolean")
    out = M.replace_set(perms, "role_id", new)
    assert {r.menu_id for r in out.filter("role_id = 3").collect()} == {5}
    granted = M.grant_by_predicate(perms, seeds.menus(spark), 3, ["reports", "dashboard"],
                                   [True, False, False, False])
    assert granted.count() == perms.count() + 1               # dashboard already granted
    upd = M.update_where(perms, F.col("menu_id") == 1, {"can_delete": False})
    assert all(not r.can_delete for r in upd.filter("menu_id = 1").collect())
    added = M.add_column(perms, "note", "x", "string")
    assert M.add_column(added, "note", "y", "string").first().note == "x"


def test_provision_categories_relinks_children_and_is_idempotent(spark):
    cats = spark.createDataFrame(
        [(1, "Drinks", None, None, 2, True), (2, "Hot", 1, None, 2, True), (3, "Cakes", None, None, 2, True),
         (4, "Other", None, None, 3, True), (5, "Old", None, None, 2, False)],
        seeds.CATEGORY_SCHEMA)
    wl = spark.createDataFrame([(10, 2), (11, 2)], "tenant_id int, business_type_id int")
    once = M.provision_categories(wl, cats)
    new = once.filter(F.col("tenant_id") == 10).collect()
    byname = {r.name: r for r in new}
    assert set(byname) == {"Drinks", "Hot", "Cakes"}
    assert byname["Hot"].parent_id == byname["Drinks"].id
    assert once.count() == cats.count() + 6
    twice = M.provision_categories(wl, once)
    assert twice.count() == once.count()


def test_provision_masters_and_create_tenant(spark):
    wl = spark.createDataFrame([(10,), (11,)], "tenant_id int")
    u = M.provision_uoms(wl, seeds.uom_templates(spark))
    assert u.count() == 12 * 3
    assert M.provision_uoms(wl, u).count() == u.count()
    h = M.provision_hsns(wl, seeds.hsn_templates(spark))
    assert h.filter("tenant_id = 11").count() == 10
    tenants = spark.createDataFrame([(1, "A", "bakery", 2, True, None)],
                                    "id int, name string, business_type string, business_type_id int, "
                                    "is_active boolean, theme_color string")
    feats = spark.createDataFrame([], "tenant_id int, feature_key string, enabled boolean")
    new = spark.createDataFrame([("B", "restaurant"), ("C", "service")], "name string, business_type string")
    t2, f2 = M.create_tenants(tenants, new, seeds.business_types(spark),
                              seeds.features_by_business_type(spark), feats)
    got = {r.name: (r.id, r.business_type_id, r.theme_color) for r in t2.collect()}
    assert got["B"] == (2, 1, "#6366F1") and got["C"] == (3, None, "#6366F1")
    assert sorted((r.tenant_id, r.feature_key) for r in f2.collect()) == [
        (2, "barcode"), (2, "kot"), (2, "table_mgmt")]


def test_add_menu_with_grants(spark):
    menus, perms = M.add_menu_with_grants(seeds.menus(spark), seeds.role_grants(spark), "Masters",
                                          "settings/masters", "database", "Settings", 4,
                                          [(1, True, True, True, True), (2, True, True, True, False)])
    m = menus.filter("route = 'settings/masters'").first()
    assert m.id == 13 and m.parent_id == 6
    assert perms.filter("menu_id = 13").count() == 2
    again, _ = M.add_menu_with_grants(menus, perms, "Masters", "settings/masters", "database",
                                      "Settings", 4, [(1, True, True, True, True)])
    assert again.count() == menus.count()


def test_business_type_slug_and_uom_upper(spark):
    bt = seeds.business_types(spark)
    rows = spark.createDataFrame([("Pet Store", None), ("Bakery", "bakery")], "label string, name string")
    out = {r.name: r for r in M.create_business_types(bt, rows).collect()}
    assert out["pet_store"].id == 6 and out["pet_store"].default_features == []
    assert len(out) == 6                                   # 'bakery' exists: ignored
    uoms = seeds.uom_templates(spark)
    ch = spark.createDataFrame([(0, "Carton", "ctn", 4), (1, "Pieces", "pcs", None)],
                               "id int, name string, abbreviation string, tenant_id int")
    got = {r.id: (r.name, r.abbreviation, r.tenant_id) for r in M.save_uoms(uoms, ch).collect()}
    assert got[13] == ("Carton", "CTN", 4) and got[1] == ("Pieces", "PCS", None)
