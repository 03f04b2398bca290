"""Read operators on the literal `mini` frame (expected rows from FIXTURES.md §3)."""

from pyspark.sql import functions as F

from basketry.plans import catalog_views, dashboard, departments, search
from conftest import make_tables, rows


def test_kpis(mini):
    assert rows(dashboard.kpis(mini)) == [(3, 4, 60.0, 15.0)]


def test_kpis_empty_tables(spark):
    assert rows(dashboard.kpis(make_tables(spark))) == [(0, 0, None, None)]


def test_orders_by_hour_and_dow(mini):
    assert rows(dashboard.orders_by_hour(mini)) == [(9, 2), (14, 1)]
    assert rows(dashboard.orders_by_dow(mini)) == [(0, "Dom", 2), (6, "Sab", 1)]


def test_top_departments(mini):
    assert rows(dashboard.top_departments(mini)) == [("produce", 3), ("dairy eggs", 2)]


def test_reorder_rate(mini):
    assert rows(dashboard.reorder_rate_by_department(mini)) == [("produce", 66.7),
                                                                 ("dairy eggs", 50.0)]


def test_department_peak_hour_ties_take_lowest_hour(mini):
    assert rows(departments.department_peak_hour(mini)) == [("produce", 3, 66.67, 9),
                                                             ("dairy eggs", 2, 50.0, 9)]


def test_department_parts(mini):
    assert sorted(rows(departments.department_stats(mini))) == [
        (1, "produce", 3, 66.67), (2, "dairy eggs", 2, 50.0)]
    ranking = sorted(rows(departments.department_hour_ranking(mini)))
    assert ranking == [(1, 9, 2, 1), (1, 14, 1, 2), (2, 9, 1, 1), (2, 14, 1, 2)]


def _names(df):
    return [(r.product_name, r.total_reorders) for r in df.collect()]


def test_product_search_keeps_unsold(mini):
    assert _names(search.product_search(mini, "")) == [
        ("Banana", 2), ("Milk", 1), ("New_Product", 0), ("Organic Banana 50%", 0)]


def test_product_search_patterns(mini):
    assert [n for n, _ in _names(search.product_search(mini, "banana"))] == [
        "Banana", "Organic Banana 50%"]
    assert [n for n, _ in _names(search.product_search(mini, "w_p"))] == ["New_Product"]
    assert [n for n, _ in _names(search.product_search(mini, "50\\"))] == ["Organic Banana 50%"]
    assert [n for n, _ in _names(search.product_search(mini, "\\q"))] == []  # \q reads as q
    assert _names(search.product_search(mini, "", department="dairy eggs")) == [
        ("Milk", 1), ("New_Product", 0)]


def test_hour_band_has_no_effect_in_literal_search(mini):
    full = _names(search.product_search(mini, ""))
    assert _names(search.product_search(mini, "", hours=(10, 23))) == full


def test_hourly_search_applies_the_band(mini):
    assert _names(search.product_search_hourly(mini, "", hours=(10, 23))) == [
        ("Banana", 0), ("Milk", 1), ("New_Product", 0), ("Organic Banana 50%", 0)]


def test_sql_text_forms_match_dataframe_forms(mini):
    for text in ["", "banana", "w_p", "50\\"]:
        assert rows(search.product_search_sql(mini, text)) == rows(search.product_search(mini, text))
    from basketry.sources.sql import run_sql_file
    assert rows(run_sql_file(mini, "department_peak_hour.sql")) == rows(
        departments.department_peak_hour(mini))


def test_catalogue_reads(mini):
    assert rows(catalog_views.list_aisles(mini)) == [(1, "fresh fruits"), (2, "milk")]
    assert rows(catalog_views.list_departments(mini)) == [
        (2, "dairy eggs"), (3, "empty dept"), (1, "produce")]
    assert sorted(rows(catalog_views.refcount_aisles(mini))) == [(1, 3), (2, 1)]
    assert sorted(rows(catalog_views.refcount_departments(mini))) == [(1, 2), (2, 2), (3, 0)]
    assert rows(search.aisles_of_department(mini, 2)) == [(1, "fresh fruits"), (2, "milk")]
    assert rows(search.aisles_of_department(mini, 3)) == []
    assert [r.product_id for r in search.products_filtered(mini, department_id=2).collect()] == [12, 13]
    assert [r.product_id for r in search.products_filtered(mini, 1, 1).collect()] == [10, 11]
    names = mini.aisles.sparkSession.createDataFrame([("milk",), ("tea",)], "n string")
    assert rows(catalog_views.lookup_aisles(mini, names, "n")) == [("milk", 2)]


def test_search_limit_is_a_cap(mini):
    assert search.product_search(mini, "", limit=2).count() == 2
