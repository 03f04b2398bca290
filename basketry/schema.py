"""The six-table basket schema and its declared constraints.

Spark enforces none of these on write, so they are kept as data: the audit
(`basketry.operators.audit`) turns each entry into a set-oriented check and
the loader applies the defaults.  Keys are LongType: the reference declares
INTEGER, but the generated inputs carry bigint keys and widening is lossless.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

L, S, D = T.LongType(), T.StringType(), T.DoubleType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(("user_id", L, False)),
    "departments": _struct(("department_id", L, False), ("department", S, False)),
    "aisles": _struct(("aisle_id", L, False), ("aisle", S, False)),
    "products": _struct(("product_id", L, False), ("product_name", S, False),
                        ("aisle_id", L, False), ("department_id", L, False)),
    "orders": _struct(("order_id", L, False), ("user_id", L, False), ("eval_set", S, True),
                      ("order_number", L, True), ("order_dow", L, True),
                      ("order_hour_of_day", L, True), ("days_since_prior_order", D, True)),
    "order_details": _struct(("order_id", L, False), ("product_id", L, False),
                             ("add_to_cart_order", L, False), ("reordered", L, True)),
}

# Foreign-key order: parents before children (load and publication order).
TABLE_ORDER = ["users", "departments", "aisles", "products", "orders", "order_details"]

# The wide, one-row-per-order-line input (the union of the six projections).
WIDE_COLUMNS = [
    ("user_id", L), ("department_id", L), ("department", S), ("aisle_id", L), ("aisle", S),
    ("product_id", L), ("product_name", S), ("order_id", L), ("eval_set", S),
    ("order_number", L), ("order_dow", L), ("order_hour_of_day", L),
    ("days_since_prior_order", D), ("add_to_cart_order", L), ("reordered", L),
]
WIDE_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in WIDE_COLUMNS])


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Check:
    table: str
    name: str
    condition: str  # Spark SQL boolean expression; NULL passes, as in SQL


# ---- fixed values: the reference's declared constraints --------------------
PRIMARY_KEYS = {
    "users": ["user_id"],
    "departments": ["department_id"],
    "aisles": ["aisle_id"],
    "products": ["product_id"],
    "orders": ["order_id"],
    "order_details": ["order_id", "product_id"],
}
UNIQUE = {"departments": ["department"], "aisles": ["aisle"]}
NOT_NULL = {
    "departments": ["department"],
    "aisles": ["aisle"],
    "products": ["product_name", "aisle_id", "department_id"],
    "orders": ["user_id"],
    "order_details": ["order_id", "product_id", "add_to_cart_order"],
}
CHECKS = [
    Check("orders", "order_number > 0", "order_number > 0"),
    Check("orders", "order_dow between 0 and 6", "order_dow >= 0 AND order_dow <= 6"),
    Check("orders", "order_hour_of_day between 0 and 23",
          "order_hour_of_day >= 0 AND order_hour_of_day <= 23"),
    Check("orders", "days_since_prior_order >= 0", "days_since_prior_order >= 0"),
    Check("order_details", "add_to_cart_order > 0", "add_to_cart_order > 0"),
    Check("order_details", "reordered in (0, 1)", "reordered IN (0, 1)"),
]
FOREIGN_KEYS = [
    ForeignKey("products", "aisle_id", "aisles", "aisle_id"),
    ForeignKey("products", "department_id", "departments", "department_id"),
    ForeignKey("orders", "user_id", "users", "user_id"),
    ForeignKey("order_details", "order_id", "orders", "order_id"),
    ForeignKey("order_details", "product_id", "products", "product_id"),
]
MAX_LENGTH = {
    "departments": {"department": 255},
    "aisles": {"aisle": 255},
    "products": {"product_name": 255},
    "orders": {"eval_set": 50},
}
DEFAULTS = {"orders": {"eval_set": "train"}, "order_details": {"reordered": 0}}
# ---- end of fixed values ----------------------------------------------------


def children_of(table: str) -> list[ForeignKey]:
    """Foreign keys that point at ``table`` (ON DELETE CASCADE edges)."""
    return [fk for fk in FOREIGN_KEYS if fk.parent == table]
