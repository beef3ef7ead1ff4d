"""Seed rows (S6): small literal dimension tables.

These frames are fixed enumerations (system roles, the menu tree, grant
templates, business types, master templates). They are bounded by
construction, so joining them by broadcast is always safe. They are never
the sole input of a registered query: plans join them with tables that grow
with the data (users, tenants, invoices).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --------------------------------------------------------------------------
# FIXED VALUES (must equal the reference's seed data for equal results)
# --------------------------------------------------------------------------

# System roles, ids in insertion order.
ROLES = [
    (1, "super_admin"),
    (2, "tenant_admin"),
    (3, "staff"),
]

# Menu tree: (id, name, route, icon, parent_id, sort_order).
MENUS = [
    (1, "Dashboard", "dashboard", "grid", None, 1),
    (2, "Billing", "billing", "file-text", None, 2),
    (3, "Products", "products", "package", None, 3),
    (4, "Customers", "customers", "users", None, 4),
    (5, "Reports", "reports", "bar-chart", None, 5),
    (6, "Settings", "settings", "settings", None, 6),
    (7, "Users", "users-mgmt", "user", None, 7),
    (8, "New Invoice", "billing/new", "plus", 2, 1),
    (9, "Invoice List", "billing/list", "list", 2, 2),
    (10, "Tenants", "settings/tenants", "building", 6, 1),
    (11, "Roles", "settings/roles", "shield", 6, 2),
    (12, "Menu Config", "settings/menus", "menu", 6, 3),
]

# Grant templates for system roles: (role_id, routes or None for all menus,
# can_view, can_add, can_edit, can_delete).
ROLE_GRANTS = [
    (1, None, True, True, True, True),
    (2, ["dashboard", "billing", "billing/new", "billing/list", "products",
         "customers", "reports", "users-mgmt"], True, True, True, False),
    (3, ["dashboard", "billing", "billing/new", "billing/list", "products",
         "customers"], True, True, False, False),
]

# Menus a tenant role can never be granted (super-admin only).
SUPER_ADMIN_ONLY_ROUTES = [
    "settings/tenants", "settings/business-types", "settings/menus", "settings/roles",
]

# Allowed values of CHECK constraints.
BUSINESS_TYPES_V1 = ["restaurant", "bakery", "supermarket", "dress_shop", "mobile_shop"]
BUSINESS_TYPES_V2 = ["restaurant", "bakery", "supermarket", "dress_shop", "mobile_shop",
                     "bakery_shop", "retail_shop", "retail", "service", "wholesale",
                     "manufacturing"]
PAYMENT_METHODS = ["cash", "upi", "card"]
PAYMENT_STATUSES = ["paid", "pending", "cancelled"]
KOT_STATUSES = ["pending", "preparing", "ready", "served"]
INVOICE_STATUSES = ["Draft", "Paid", "Cancelled"]

# Business types: (id, name, label, description, default_features).
BUSINESS_TYPES = [
    (1, "restaurant", "Restaurant",
     "Full-service dining with table and kitchen management", ["kot", "table_mgmt"]),
    (2, "bakery", "Bakery",
     "Bakery and confectionery with expiry date tracking", ["expiry_tracking"]),
    (3, "supermarket", "Supermarket",
     "Retail supermarket with barcode scanning and inventory", ["barcode"]),
    (4, "dress_shop", "Dress Shop",
     "Clothing and apparel with size and color variant tracking", ["size_color_variants"]),
    (5, "mobile_shop", "Mobile Shop",
     "Electronics and mobile store with IMEI tracking", ["imei_tracking", "barcode"]),
]

# Feature flags seeded on tenant creation: (business_type, feature_key, enabled).
FEATURES_BY_BUSINESS_TYPE = [
    ("restaurant", "kot", True),
    ("restaurant", "table_mgmt", True),
    ("restaurant", "barcode", False),
    ("bakery", "expiry_tracking", True),
    ("bakery", "barcode", False),
    ("bakery_shop", "expiry_tracking", True),
    ("bakery_shop", "barcode", False),
    ("supermarket", "barcode", True),
    ("supermarket", "kot", False),
    ("dress_shop", "size_color_variants", True),
    ("dress_shop", "barcode", False),
    ("mobile_shop", "imei_tracking", True),
    ("mobile_shop", "barcode", True),
    ("retail_shop", "size_color_variants", True),
    ("retail_shop", "barcode", True),
    ("retail", "size_color_variants", True),
    ("retail", "barcode", True),
]

# Units of measure: (name, abbreviation).
UOMS = [
    ("Piece", "PCS"),
    ("Kilogram", "KG"),
    ("Gram", "GM"),
    ("Litre", "LTR"),
    ("Millilitre", "ML"),
    ("Metre", "MTR"),
    ("Centimetre", "CM"),
    ("Box", "BOX"),
    ("Dozen", "DOZ"),
    ("Pack", "PCK"),
    ("Bag", "BAG"),
    ("Bottle", "BTL"),
]

# HSN codes: (hsn_code, description, cgst, sgst, igst).
HSNS = [
    ("0101", "Live horses, asses, mules", 0, 0, 0),
    ("1001", "Wheat and meslin", 0, 0, 0),
    ("2106", "Food preparations not elsewhere specified", 9, 9, 18),
    ("3004", "Medicaments for retail sale", 6, 6, 12),
    ("6101", "Mens overcoats and similar articles", 6, 6, 12),
    ("6201", "Mens or boys overcoats", 9, 9, 18),
    ("8471", "Automatic data processing machines", 9, 9, 18),
    ("8517", "Telephone sets including smartphones", 9, 9, 18),
    ("9403", "Other furniture", 9, 9, 18),
    ("9619", "Sanitary towels and napkins", 6, 6, 12),
]

# Category templates per business type (all top level).
CATEGORY_TEMPLATES = {
    "restaurant": ["Starters", "Main Course", "Breads", "Rice & Biryani",
                   "Noodles & Pasta", "Soups", "Salads", "Desserts", "Beverages",
                   "Combos & Meals"],
    "bakery": ["Breads & Loaves", "Cakes", "Pastries & Tarts", "Cookies & Biscuits",
               "Muffins & Cupcakes", "Buns & Rolls", "Puffs & Savouries",
               "Festival Specials", "Sugar-Free", "Beverages"],
    "supermarket": ["Groceries & Staples", "Dairy & Eggs", "Snacks & Namkeen",
                    "Beverages", "Personal Care", "Household & Cleaning",
                    "Fresh Vegetables", "Fresh Fruits", "Frozen Foods", "Baby Care"],
    "dress_shop": ["Mens Wear", "Womens Wear", "Kids Wear", "Ethnic Wear",
                   "Western Wear", "Sportswear", "Innerwear & Nightwear",
                   "Accessories", "Footwear", "Seasonal Collection"],
    "mobile_shop": ["Smartphones", "Feature Phones", "Tablets & iPads",
                    "Mobile Accessories", "Chargers & Cables", "Cases & Covers",
                    "Earphones & Headphones", "Smart Watches", "Power Banks",
                    "Refurbished Devices"],
}

# Synthetic product generator word lists.
PRODUCT_PREFIXES = ["Ultra", "Smart", "Eco", "Pro", "Classic", "Premium", "Daily",
                    "Fast", "Super", "Mega"]
PRODUCT_BASES = ["Phone", "Bottle", "Shirt", "Snack", "Charger", "Napkin", "Pen",
                 "Notebook", "Milk", "Bread", "Oil", "Soap", "Brush", "Towel", "Light",
                 "Fan"]
PRODUCT_CATEGORIES = ["Electronics", "Clothing", "Groceries", "Household", "Stationery",
                      "Beverages", "Snacks", "Personal Care", "Dairy", "Frozen Food"]
PRODUCT_UNITS = ["Piece", "Kilogram", "Liter", "Box"]
PRODUCT_HSNS = ["8412", "8517", "6101", "1001", "2106"]

# Defaults used by the response shaping of the menu endpoint.
DEFAULT_THEME_COLOR = "#6366F1"
DEFAULT_TENANT_NAME = "Billing"   # neutral default; the reference shows its product name here
DEFAULT_MENU_ICON = "circle"

# Tables seeded per restaurant tenant.
SEEDED_TABLES_PER_TENANT = 20
SEEDED_TABLE_CAPACITY = 4

# --------------------------------------------------------------------------
# Frames
# --------------------------------------------------------------------------

_ARROW = "spark.sql.execution.arrow.pyspark.enabled"


def local_frame(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """A literal frame as a ``LocalRelation`` (Arrow path), so the optimizer
    knows its real size and broadcasts it; a plain list would become an RDD
    scan of unknown size."""
    import pandas as pd

    pdf = pd.DataFrame(list(rows), columns=schema.fieldNames(), dtype=object)
    prev = spark.conf.get(_ARROW, "false")
    spark.conf.set(_ARROW, "true")
    try:
        return spark.createDataFrame(pdf, schema)
    finally:
        spark.conf.set(_ARROW, prev)

ROLES_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
])

MENUS_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("route", T.StringType(), False),
    T.StructField("icon", T.StringType(), True),
    T.StructField("parent_id", T.IntegerType(), True),
    T.StructField("sort_order", T.IntegerType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])

PERMISSION_FIELDS = ["can_view", "can_add", "can_edit", "can_delete"]

ROLE_PERMISSIONS_SCHEMA = T.StructType([
    T.StructField("role_id", T.IntegerType(), False),
    T.StructField("menu_id", T.IntegerType(), False),
] + [T.StructField(c, T.BooleanType(), True) for c in PERMISSION_FIELDS])

BUSINESS_TYPES_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("default_features", T.ArrayType(T.StringType()), True),
    T.StructField("is_active", T.BooleanType(), True),
])

FEATURES_SCHEMA = T.StructType([
    T.StructField("business_type", T.StringType(), False),
    T.StructField("feature_key", T.StringType(), False),
    T.StructField("enabled", T.BooleanType(), False),
])

UOM_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("abbreviation", T.StringType(), False),
    T.StructField("tenant_id", T.IntegerType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])

HSN_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("hsn_code", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("cgst_rate", T.DecimalType(5, 2), True),
    T.StructField("sgst_rate", T.DecimalType(5, 2), True),
    T.StructField("igst_rate", T.DecimalType(5, 2), True),
    T.StructField("cess_rate", T.DecimalType(5, 2), True),
    T.StructField("tenant_id", T.IntegerType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])

CATEGORY_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("parent_id", T.IntegerType(), True),
    T.StructField("tenant_id", T.IntegerType(), True),
    T.StructField("business_type_id", T.IntegerType(), True),
    T.StructField("is_active", T.BooleanType(), True),
])


def roles(spark: SparkSession) -> DataFrame:
    return local_frame(spark, ROLES, ROLES_SCHEMA)


def menus(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [m + (True,) for m in MENUS], MENUS_SCHEMA)


def role_grants(spark: SparkSession) -> DataFrame:
    """Grant templates as (role_id, menu_id, flags): the seed of role_permissions."""
    rows = []
    for role_id, routes, v, a, e, d in ROLE_GRANTS:
        for mid, _name, route, _icon, _parent, _sort in MENUS:
            if routes is None or route in routes:
                rows.append((role_id, mid, v, a, e, d))
    return local_frame(spark, rows, ROLE_PERMISSIONS_SCHEMA)


def business_types(spark: SparkSession) -> DataFrame:
    return local_frame(spark, [b + (True,) for b in BUSINESS_TYPES], BUSINESS_TYPES_SCHEMA)


def features_by_business_type(spark: SparkSession) -> DataFrame:
    return local_frame(spark, FEATURES_BY_BUSINESS_TYPE, FEATURES_SCHEMA)


def uom_templates(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, n, a, None, True) for i, (n, a) in enumerate(UOMS)]
    return local_frame(spark, rows, UOM_SCHEMA)


def hsn_templates(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, code, desc, Decimal(c), Decimal(s), Decimal(g), Decimal(0), None, True)
            for i, (code, desc, c, s, g) in enumerate(HSNS)]
    return local_frame(spark, rows, HSN_SCHEMA)


def category_templates(spark: SparkSession) -> DataFrame:
    """Top-level category templates, ids in seeding order, tenant NULL."""
    rows, next_id = [], 1
    for bt_id, bt_name, *_ in BUSINESS_TYPES:
        for name in CATEGORY_TEMPLATES[bt_name]:
            rows.append((next_id, name, None, None, bt_id, True))
            next_id += 1
    return local_frame(spark, rows, CATEGORY_SCHEMA)
