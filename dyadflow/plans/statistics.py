"""Tests; SQL checks the statistics, unit tests the probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.operators import stats
from dyadflow.plans.registry import query
from dyadflow.plans.relations import FEATURES, features, rounding
from dyadflow.plans.steps import r6
from dyadflow.session import table

_RANKS = "r AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY value) AS t FROM events), n AS (SELECT count(*) AS n, sum(t * t - 1.0) AS ties FROM r)"


@query(f"WITH {_RANKS} SELECT event_id, {r6('rk')} AS rank, t AS ties FROM r")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(stats.average_ranks(table(spark, sf_dir, "events"), "value").select("event_id", "rank", "ties"))


@query(f"""WITH {_RANKS}, g AS (SELECT event_type, sum(rk) AS s, count(*) AS k FROM r GROUP BY event_type)
SELECT {r6("(12.0 / (n * (n + 1)) * sum(s * s / k) - 3 * (n + 1)) / (1 - ties / (cast(n AS DOUBLE) * n * n - n))")} AS h, count(*) AS n_groups FROM g, n GROUP BY n, ties""")
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(stats.kruskal_wallis(table(spark, sf_dir, "events"), "value", "event_type").drop("p"))


@query(f"""WITH {_RANKS}, g AS (SELECT event_type, avg(rk) AS m, count(*) AS k FROM r GROUP BY event_type)
SELECT a.event_type AS a, b.event_type AS b, {r6("(a.m - b.m) / sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / a.k + 1 / b.k))")} AS z FROM g AS a JOIN g AS b ON a.event_type < b.event_type, n""")
def dunn_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(stats.dunn(table(spark, sf_dir, "events"), "value", "event_type").drop("p"))


@query(f"""WITH {_RANKS}, s AS (SELECT sum(rk) FILTER (WHERE event_type = 'error') AS s, count(*) FILTER (WHERE event_type = 'error') AS n1, count(*) FILTER (WHERE event_type <> 'error') AS n2 FROM r)
SELECT {r6("s - n1 * (n1 + 1) / 2")} AS u, n1, n2, {r6("1 - 2 * (s - n1 * (n1 + 1) / 2) / (n1 * n2)")} AS rank_biserial FROM s""")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(stats.mann_whitney(table(spark, sf_dir, "events"), "value", F.col("event_type") == "error").drop("p_less"))


@query(f"""WITH d AS (SELECT o_totalprice - 150000 AS x FROM orders WHERE o_totalprice <> 150000), r AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2 AS rk FROM d)
SELECT {r6("coalesce(sum(rk) FILTER (WHERE x > 0), 0)")} AS w, count(*) AS n FROM r""")
def wilcoxon_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select((F.col("o_totalprice") - 150000).alias("x"))
    return rounding(stats.wilcoxon(d, "x").drop("p_greater"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice > 150000) AS n_pos FROM orders WHERE o_totalprice <> 150000")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sign_test(table(spark, sf_dir, "orders").select((F.col("o_totalprice") - 150000).alias("x")), "x").drop("p_greater")


@query(f"WITH d AS (SELECT o_totalprice - 150000 AS v FROM orders) SELECT count(*) AS n, {r6('avg(v)')} AS mean, {r6('median(v)')} AS median, count(*) FILTER (WHERE v > 0) AS n_pos, {r6('avg(cast(v > 0 AS DOUBLE))')} AS frac_pos FROM d")
def positive_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(stats.positive_effect(table(spark, sf_dir, "orders").select((F.col("o_totalprice") - 150000).alias("x")), "x"))


@query(f"WITH {FEATURES} SELECT {r6('corr(occ_entropy, mean_dwell)')} AS r, count(*) AS n FROM ft")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(stats.pearson(features(spark, sf_dir), "occ_entropy", "mean_dwell").drop("p"))


@query(f"""WITH {FEATURES}, r AS (SELECT {", ".join(f"rank() OVER (ORDER BY v{c}) + (count(*) OVER (PARTITION BY v{c}) - 1) / 2 AS r{c}" for c in "xy")} FROM (SELECT length AS vx, round(occ_entropy, 9) AS vy FROM ft))
SELECT {r6("corr(rx, ry)")} AS rho, count(*) AS n FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = features(spark, sf_dir).withColumn("occ_entropy", F.round("occ_entropy", 9))
    return rounding(stats.spearman(d, "length", "occ_entropy").drop("p"))


@query(f"""WITH g AS (SELECT event_type, count(*) AS k, avg(value) AS m, var_pop(value) * count(*) AS ss FROM events GROUP BY event_type),
t AS (SELECT sum(k) AS n, count(*) AS g, sum(m * k) / sum(k) AS mean, sum(ss) AS w FROM g)
SELECT {r6("sum(k * (m - mean) * (m - mean)) / (any_value(g) - 1) / (any_value(w) / (any_value(n) - any_value(g)))")} AS f, any_value(t.g) - 1 AS d1, cast(any_value(n) - any_value(t.g) AS BIGINT) AS d2 FROM g, t""".replace("any_value(g)", "any_value(t.g)"))
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(stats.anova(table(spark, sf_dir, "events"), "value", "event_type").drop("p"))


@query(f"""WITH d AS (SELECT s_nationkey AS family, s_suppkey AS test, (s_suppkey * 37 % 101) / 1000.0 AS p FROM supplier),
r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, test) AS k FROM d)
SELECT family, test, {r6("least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING))")} AS q, least(1, min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) <= 0.05 AS reject FROM r""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("test"), ((F.col("s_suppkey") * 37 % 101) / 1000.0).alias("p"))
    return rounding(stats.bh_fdr(d, "p", "family").drop("p"))


@query(f"""WITH {FEATURES}, s AS (SELECT dyad_id, count(*) AS n, regr_slope(mean_dwell, length) AS slope, regr_intercept(mean_dwell, length) AS b, stddev_pop(length) AS sx, stddev_pop(mean_dwell) AS sy FROM ft GROUP BY dyad_id)
SELECT dyad_id, n, {r6("slope")} AS slope, {r6("b")} AS intercept FROM s WHERE n >= 3 AND sx > 0 AND sy > 0""")
def ols_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(stats.ols_slopes(features(spark, sf_dir), "length", "mean_dwell", "dyad_id"))


@query(f"""WITH {FEATURES}, s AS (SELECT regr_slope(mean_dwell, length) AS s FROM ft GROUP BY dyad_id HAVING count(*) >= 3 AND stddev_pop(length) > 0 AND stddev_pop(mean_dwell) > 0),
a AS (SELECT count(*) AS n, avg(s) AS m, median(s) AS md, stddev_pop(s) AS sd, avg(cast(s > 0 AS DOUBLE)) AS pf, median(abs(s)) AS am FROM s)
SELECT n, {r6("m")} AS slope_mean, {r6("md")} AS slope_median, {r6("sd")} AS slope_sd, {r6("pf")} AS positive_fraction, {r6("am")} AS abs_median, abs(md) < 0.25 * greatest(sd, 1e-12) AS sym_centered, pf BETWEEN 0.30 AND 0.70 AS mixed_signs FROM a""")
def slope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(stats.slope_summary(stats.ols_slopes(features(spark, sf_dir), "length", "mean_dwell", "dyad_id")))
