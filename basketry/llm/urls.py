"""URL filter: rules first, then the ratio of two character models (native).

A url's host and path are cut out, the longest fitting rule decides, and urls
without a rule are judged by variable-order Markov models over characters: one
learned from urls that rules allow, one from urls they block.  Orders 1 to
ORDER are interpolated, p_k = (n(ctx c) + ALPHA p_(k-1)) / (n(ctx) + ALPHA),
down to a uniform p_0, so unseen contexts fall back to shorter ones.  A url's
mark is the mean log-likelihood difference per character; the cut between the
classes is calibrated on rule-judged urls that the models did not see.

All of it is joins and aggregates over windows of ORDER characters: counting
and scoring run once per distinct window and once per distinct url, so a host
with a third of all pages adds counts, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm import common

ORDER = 5
ALPHA = 2.0
ALPHABET = 256.0
#: One of FOLDS folds of the rule-judged urls calibrates the cut.
FOLDS = 5
#: (rule, verdict): a host, then the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"),
         ("example.com/de/", "block"), ("org/fr/", "allow"))


def host(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(
        F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule for columns host and path;
    null where none fits.  Of equally long rules the first by name wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        h, slash, p = text.partition("/")
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) \
            & F.startswith(F.col("path"), F.lit(slash + p))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def windows(urls: DataFrame) -> DataFrame:
    """url_key, w: every window of ORDER characters of ^..^host/path$."""
    s = F.concat(F.lit("^" * (ORDER - 1)), F.col("url_key"), F.lit("$"))
    return urls.withColumn("s", s).select(
        *urls.columns, F.explode(F.expr(
            f"transform(sequence(1, length(s) - {ORDER - 1}), i -> substring(s, i, {ORDER}))"))
        .alias("w"))


def model(urls: DataFrame) -> DataFrame:
    """w -> d, the log-likelihood difference (accepted minus rejected) of the
    last character of w, for every distinct window of the urls."""
    learn = F.col("learn")
    g = windows(urls).groupBy("w").agg(
        F.sum(F.when(learn == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(learn == "block", F.col("n")).otherwise(0)).alias("r"))
    g = common.cut(g, "url-windows")
    lower = None
    for k in range(1, ORDER + 1):
        grams = (g.groupBy(F.substring("w", ORDER - k + 1, k).alias("g"))
                 .agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
                 .withColumn("ctx", F.substring("g", 1, k - 1)))
        ctx = grams.groupBy(F.col("ctx").alias("c")).agg(
            F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        p = grams.join(ctx, F.col("ctx") == F.col("c"))
        if lower is None:
            below = p.withColumns({"qa": F.lit(1 / ALPHABET), "qr": F.lit(1 / ALPHABET)})
        else:
            below = p.withColumn("suffix", F.substring("g", 2, k - 1)).join(lower, "suffix")
        lower = below.select(
            F.col("g").alias("suffix"),
            ((F.col("a") + F.col("qa") * ALPHA) / (F.col("ca") + ALPHA)).alias("qa"),
            ((F.col("r") + F.col("qr") * ALPHA) / (F.col("cr") + ALPHA)).alias("qr"))
    return lower.select(F.col("suffix").alias("w"), (F.log("qa") - F.log("qr")).alias("d"))


def cutoff(scored: DataFrame) -> float | None:
    """Where two normal curves fitted to the held-out marks of allowed and
    blocked urls are equally many deviations away; None when a class has no
    held-out url."""
    h = scored.filter("held AND verdict IS NOT NULL")
    at = lambda f, v: f(F.when(F.col("verdict") == v, F.col("mark")))
    s = h.agg(at(F.avg, "allow").alias("ma"), at(F.avg, "block").alias("mr"),
              F.coalesce(at(F.stddev_pop, "allow"), F.lit(0.0)).alias("sa"),
              F.coalesce(at(F.stddev_pop, "block"), F.lit(0.0)).alias("sr"))
    sa, sr = F.col("sa") + 1e-6, F.col("sr") + 1e-6
    return s.select((F.col("ma") * sr + F.col("mr") * sa) / (sa + sr)).first()[0]


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    Null urls and urls without :// have empty host and path and are judged by
    the method like any other.  Where no url of one class is left to calibrate
    on, the method allows everything.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    d = common.only(pages, page_id="long", url="string")
    d = d.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = matched(rules)
    u = (d.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
         .withColumn("verdict", verdict)
         .withColumn("url_key", F.concat("host", "path")))
    u = u.withColumn("held", F.conv(F.substring(F.md5(F.col("url_key").cast("binary")), 1, 8),
                                    16, 10).cast("long") % FOLDS == 0)
    u = common.cut(u.withColumn("learn", F.when(~F.col("held"), F.col("verdict"))), "urls")
    m = model(u)
    marks = (windows(u.select("url_key").distinct()).join(m, "w")
             .groupBy("url_key").agg((F.sum("d") / F.count(F.lit(1))).alias("mark")))
    scored = common.cut(u.join(marks, "url_key").select("host", "path", "verdict", "held", "mark"),
                        "url-marks")
    low = scored.select("host", "path", F.coalesce(
        F.col("mark") < F.lit(cutoff(scored)).cast("double"), F.lit(False)).alias("rejected"))
    return (d.join(low, ["host", "path"], "left")
            .withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("rejected"), "block")
                                              .otherwise("allow")))
            .select("page_id", "host", "path", "rule", "verdict"))
