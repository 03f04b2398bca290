"""URL filter, source mixing and quality rules: DuckDB oracles, edge rows, no Python in the plans."""
import pytest
from pyspark.sql import functions as F

from basketry.llm import mixing, quality, queries, urls
from helpers import SF, docs, same_as_oracle

NATIVE = ["op3_url_filter", "op5_mix_sources", "op10_quality_rules"]


@pytest.mark.parametrize("name", NATIVE)
def test_matches_duckdb(spark, name):
    same_as_oracle(spark, name)


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_the_plan(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"):
        assert node not in plan


def pages(spark, found):
    return spark.createDataFrame(
        [(i, u, "x", "y") for i, u in enumerate(found)], "page_id long, url string, HOST string, rule string")


def test_hosts_paths_and_rules(spark):
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages(spark, [
        None, "", "no scheme", "HTTP://A.Example.NET/en/1?x#y", "http://example.net", "http://b.net/",
        "http://example.com/de/7#a?b", "http://notexample.com/de/", "x://k.ORG/fr/", "http://a.net?/en/",
        "http://a/b://c/d"])).collect()}
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None)
    assert got[3] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[4][:3] == ("example.net", "", None)
    assert got[5] == ("b.net", "/", "net/", "block")
    assert got[6] == ("example.com", "/de/7", "example.com/de/", "block")
    assert got[7][:3] == ("notexample.com", "/de/", None)
    assert got[8] == ("k.org", "/fr/", "org/fr/", "allow")
    assert got[9][:3] == ("a.net", "", None)
    assert got[10][:3] == ("a", "/b://c/d", None)
    assert all(r[3] in ("allow", "block") for r in got.values())


def test_url_tables_without_rows_or_examples(spark):
    assert urls.judge(pages(spark, [])).count() == 0
    assert [r["verdict"] for r in urls.judge(pages(spark, ["http://x.com/"] * 3)).collect()] == ["allow"] * 3


def test_mixing_edges(spark):
    d = docs(spark, [(1, "aa", None, "a"), (1, "aa", None, "a"), (None, "b", None, None), (3, None, None, "c"),
                     (4, "", None, "c")]).withColumn("COPY", F.lit("mine"))
    got = mixing.mix(d).collect()
    assert all(1 <= r["copy"] <= r["n_copies"] for r in got)
    assert "COPY" not in mixing.mix(d).columns and mixing.mix(d.limit(0)).count() == 0
    again = mixing.mix(d.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    one = [r for r in got if r["doc_id"] == 1]
    assert len({r["n_copies"] for r in one}) <= 1


def test_mixing_reaches_its_target(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"),
                                 F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"))
    got = {r["source"]: r["n"] for r in mixing.mix(d, {"big": 1, "small": 3, "none": 5}, total=80_000)
           .groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    # shares 1/9 and 3/9 of 80,000 characters would need "none"; only present sources count
    assert abs(got["big"] - 2000) < 200 and abs(got["small"] - 6000) < 300
    rate = mixing.rates(spark.createDataFrame([("s", 10)], "source string, chars long"), {"s": 1},
                        total=12_345.0).first()
    assert rate["parts"] == 7 and abs(rate["cdf"][-1] - 1) < 1e-9
    with pytest.raises(ValueError):
        mixing.rates(spark.createDataFrame([("s", 10)], "source string, chars long"), {})


def test_quality_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    d = docs(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c\nx\nx\n \nx"), (5, "a#b *c<>"),
                     (None, "a b c d a b c"), (7, long), (7, long), (8, "ü\u00a0x\u2003y z")]).withColumn(
        "kept", F.lit("mine"))
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(d).collect()}
    assert all(got[k, 0][c] == 0 for k in (1, 2, 3) for c in ("word_chars", "n_symbols", "n_dup_lines"))
    assert got[4, 9]["n_repeat_words"] == 6 and got[4, 9]["n_dup_lines"] == 2
    assert got[5, 2]["n_symbols"] == 4 and got[5, 2]["word_chars"] == 7
    assert got[None, 7]["n_repeat_words"] == 6
    assert got[7, 30_000]["kept"] and not got[7, 30_000]["base_failed"]
    assert got[8, 2]["word_chars"] == 6
    assert quality.judge(d).count() == 9 and quality.judge(d.limit(0)).count() == 0


def test_quality_fences_adapt(spark):
    """A source where symbols are common keeps them; elsewhere they are rejected."""
    word = "FIXED"
    rows = [(i, " ".join(f"{word}{i}x{k}" + ("#" if s == "code" else "") for k in range(60)), "en", s)
            for i, s in enumerate(["code"] * 60 + ["prose"] * 60)]
    rows += [(500, rows[0][1].replace("x", "y"), "en", "code"), (501, rows[0][1].replace("x", "y"), "en", "prose")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs(spark, rows)).collect()}
    assert got[500] and not got[501] and all(got[i] for i in range(120))
