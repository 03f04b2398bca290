"""Property tests."""

import re
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions.numeric import pct_half_up
from basketry.functions.text import contains_pattern
from basketry.operators import catalog, load
from basketry.operators.audit import audit
from basketry.sources.fixture import fixture_tables, fixture_wide
from conftest import SF_SMALL, rows

SETTINGS = settings(max_examples=10, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10 ** 12), st.integers(1, 10 ** 12)),
                min_size=1, max_size=40),
       st.integers(0, 3))
def test_pct_half_up_is_exact(spark, pairs, digits):
    pairs = [(min(a, b), b) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [r[0] for r in df.select(pct_half_up("a", "b", digits)).collect()]
    q = Decimal(1).scaleb(-digits)
    want = [float((Decimal(100 * a) / Decimal(b)).quantize(q, rounding=ROUND_HALF_UP))
            for a, b in pairs]
    assert got == want


def _pg_ilike(text: str, name: str) -> bool:
    """PostgreSQL ILIKE of name against '%' + text + '%' (backslash escapes)."""
    pattern = "%" + text + "%"
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
        i += 1
    return re.fullmatch("".join(out), name.lower(), re.DOTALL) is not None


ALPHABET = st.sampled_from(list("aAbB%_\\ 5"))


@SETTINGS
@given(st.text(ALPHABET, max_size=5), st.lists(st.text(ALPHABET, max_size=8), min_size=1,
                                                 max_size=30))
def test_search_pattern_follows_postgres_like(spark, text, names):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r[0] for r in df.select(F.col("name").ilike(contains_pattern(text))).collect()]
    want = [_pg_ilike(text.lower(), n) for n in names]
    assert got == want


def test_normalise_then_rejoin_gives_the_clean_rows(spark):
    wide = fixture_wide(spark, SF_SMALL)
    t = load.normalise(wide)
    rejoined = (t.order_details.join(t.orders, "order_id").join(t.products, "product_id")
                .join(t.aisles, "aisle_id").join(t.departments, "department_id"))
    clean = load.clean_wide(wide)
    cols = clean.columns
    assert rejoined.select(cols).exceptAll(clean).count() == 0
    assert clean.exceptAll(rejoined.select(cols)).count() == 0
    assert rows(audit(t)) == []


@settings(max_examples=3, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sampled_from(["users", "departments", "aisles", "products", "orders"]),
       st.integers(2, 7), st.integers(0, 6))
def test_cascade_leaves_no_orphans(spark, table, modulus, rest):
    t = fixture_tables(spark, SF_SMALL)
    key = {"users": "user_id", "departments": "department_id", "aisles": "aisle_id",
           "products": "product_id", "orders": "order_id"}[table]
    doomed = getattr(t, table).select(key).filter(F.col(key) % modulus == rest % modulus)
    after = catalog.cascade_delete(t, table, doomed)
    assert rows(audit(after)) == []
    assert getattr(after, table).join(doomed, key, "left_semi").count() == 0


def test_bench_load_counts_match_operators(spark):
    import bench
    r = bench._load_clean_counts(spark, SF_SMALL).collect()[0]
    wide = fixture_wide(spark, SF_SMALL)
    t = load.normalise(wide)
    assert r.wide == wide.count() and r.deduped == wide.dropDuplicates().count()
    assert r.clean == load.clean_wide(wide).count()
    assert all(r[name] == df.count() for name, df in t.items())
