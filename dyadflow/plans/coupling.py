"""Transition models, coupling and directionality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadflow.functions.scalars import multiset_digest, quadrant, rounded
from dyadflow.operators import markov
from dyadflow.operators.folds import fold_of
from dyadflow.operators.sequence import POS, transitions
from dyadflow.plans.registry import query
from dyadflow.plans.steps import STEPS, r6, steps

N_SPLITS = 5
_TR = f"""{STEPS}, tr AS (SELECT * FROM (SELECT session_id, dyad_id, therapist_id, pos, th, cl, lag(th) OVER w AS tp, lag(cl) OVER w AS cp FROM steps WINDOW w AS (PARTITION BY session_id ORDER BY pos)) WHERE tp IS NOT NULL)"""


@query(f"WITH {_TR} SELECT 'therapist' AS role, tp AS prev, th AS next, count(*) AS n FROM tr GROUP BY ALL UNION ALL SELECT 'client', cp, cl, count(*) FROM tr GROUP BY ALL")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = transitions(steps(spark, sf_dir), "th", "cl")
    both = d.select(F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"{c}_prev").alias("prev"), F.col(c).alias("next")) for r, c in (("therapist", "th"), ("client", "cl"))))).alias("x"))
    return both.select("x.*").groupBy("role", "prev", "next").agg(F.count("*").alias("n"))


_G = "g AS (SELECT * FROM unnest(range(3)) AS a(i), unnest(range(3)) AS b(j))"


@query(f"""WITH {_TR}, {_G}, c AS (SELECT 'therapist' AS role, tp AS i, th AS j, count(*) AS n FROM tr GROUP BY ALL UNION ALL SELECT 'client', cp, cl, count(*) FROM tr GROUP BY ALL),
f AS (SELECT role, g.i, g.j, coalesce(n, 0) AS n FROM (SELECT unnest(['therapist', 'client']) AS role) CROSS JOIN g LEFT JOIN c USING (role, i, j))
SELECT role, cast(i AS INT) AS prev, cast(j AS INT) AS next, {r6("(n + 1.0) / (sum(n) OVER (PARTITION BY role, i) + 3)")} AS p FROM f""")
def markov1_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = transition_counts(spark, sf_dir)
    states = F.sequence(F.lit(0), F.lit(2))
    grid = n.select("role").distinct().withColumn("prev", F.explode(states)).withColumn("next", F.explode(states))
    d = grid.join(n, ["role", "prev", "next"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return d.select("role", "prev", "next", rounded((F.col("n") + 1.0) / (F.sum("n").over(Window.partitionBy("role", "prev")) + 3)).alias("p"))


_CELLS = "cells AS (SELECT *, coalesce(n, 0) AS m FROM (SELECT f.fold, a.i AS tp, b.i AS cp, c.i AS th, d.i AS cl FROM (SELECT DISTINCT fold FROM sc) AS f, unnest(range(3)) AS a(i), unnest(range(3)) AS b(i), unnest(range(3)) AS c(i), unnest(range(3)) AS d(i)) LEFT JOIN (SELECT fold, tp, cp, th, cl, sum(n) AS n FROM sc GROUP BY ALL) USING (fold, tp, cp, th, cl))"


def _scores(group: str) -> str:
    """CTEs that end in s(fold, session_id, dyad_id, nt, t0, c0, t1, c1)."""
    p = lambda own, given: f"ln((sum(m) OVER (PARTITION BY fold, {own}) + 1.0) / (sum(m) OVER (PARTITION BY fold, {given}) + 3.0))"
    return f"""{_TR}, sc AS (SELECT cast('0x' || substr(md5(cast({group} AS VARCHAR)), 1, 8) AS BIGINT) % {N_SPLITS} AS fold, session_id, dyad_id, tp, cp, th, cl, count(*) AS n FROM tr GROUP BY ALL),
{_CELLS}, left_out AS (SELECT fold, tp, cp, th, cl, sum(m) OVER (PARTITION BY tp, cp, th, cl) - m AS m FROM cells),
grid AS (SELECT fold, tp, cp, th, cl, {p("tp, th", "tp")} AS t0, {p("cp, cl", "cp")} AS c0, {p("tp, cp, th", "tp, cp")} AS t1, {p("cp, tp, cl", "cp, tp")} AS c1 FROM left_out),
s AS (SELECT fold, session_id, dyad_id, cast(sum(n) AS BIGINT) AS nt, sum(n * t0) AS t0, sum(n * c0) AS c0, sum(n * t1) AS t1, sum(n * c1) AS c1 FROM sc JOIN grid USING (fold, tp, cp, th, cl) GROUP BY ALL)"""


def _coupling_sql(group: str) -> str:
    return f"""WITH {_scores(group)} SELECT cast(fold AS INT) AS fold, session_id, dyad_id, 2 * nt AS n_transitions, {r6("t0 + c0")} AS ll0_total, {r6("t1 + c1")} AS ll1_total,
{r6("(t0 + c0) / (2 * nt)")} AS ll0_per_trans, {r6("(t1 + c1) / (2 * nt)")} AS ll1_per_trans, {r6("(t1 + c1 - t0 - c0) / (2 * nt)")} AS gain_per_trans FROM s"""


def _round(d: DataFrame) -> DataFrame:
    return d.select(*(rounded(F.col(c)).alias(c) if t == "double" else c for c, t in d.dtypes))


def _sessions(spark: SparkSession, sf_dir: str, group: str = "dyad_id") -> DataFrame:
    return markov.cross_validated(steps(spark, sf_dir), fold_of(F.col(group), N_SPLITS))


@query(_coupling_sql("dyad_id"))
def coupling_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(markov.coupling(_sessions(spark, sf_dir)))


@query(_coupling_sql("therapist_id"))
def coupling_therapist_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(markov.coupling(_sessions(spark, sf_dir, "therapist_id")))


@query(f"""WITH {_scores("dyad_id")}, g AS (SELECT dyad_id, 2 * nt AS n, (t1 + c1 - t0 - c0) / (2 * nt) AS g FROM s)
SELECT dyad_id, count(*) AS n_samples, cast(sum(n) AS BIGINT) AS n_transitions, {r6("sum(g * n) / sum(n)")} AS gain_per_trans_wmean, {r6("avg(g)")} AS gain_per_trans_mean, {r6("median(g)")} AS gain_per_trans_median FROM g GROUP BY dyad_id""")
def coupling_by_dyad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(markov.coupling_by_dyad(markov.coupling(_sessions(spark, sf_dir))))


_DIRECTION = f"""WITH {_scores("dyad_id")}, d AS (SELECT fold, session_id, dyad_id, nt, t1 - t0 AS dt, c1 - c0 AS dc FROM s)"""


@query(f"""{_DIRECTION} SELECT cast(fold AS INT) AS fold, session_id, dyad_id, nt AS "nT", nt AS "nC", {r6("dt / nt")} AS "dT_per_trans", {r6("dc / nt")} AS "dC_per_trans", {r6("dt")} AS "dT_total", {r6("dc")} AS "dC_total" FROM d""")
def directionality_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(markov.directionality(_sessions(spark, sf_dir)))


@query(f"""{_DIRECTION}, a AS (SELECT dyad_id, count(*) AS k, cast(sum(nt) AS BIGINT) AS n, sum(dt) / sum(nt) AS wt, sum(dc) / sum(nt) AS wc FROM d GROUP BY dyad_id)
SELECT dyad_id, k AS n_samples, n AS "nT", n AS "nC", {r6("wt")} AS "dT_wmean", {r6("wc")} AS "dC_wmean", {r6("wt")} AS "dT_per_trans_wmean", {r6("wc")} AS "dC_per_trans_wmean", 2 * n AS n_transitions, {r6("2 * n / k")} AS avg_trans_per_session FROM a""")
def directionality_by_dyad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(markov.directionality_by_dyad(markov.directionality(_sessions(spark, sf_dir))))


@query(f"""{_DIRECTION}, a AS (SELECT dyad_id, sum(dt) / sum(nt) AS wt, sum(dc) / sum(nt) AS wc FROM d GROUP BY dyad_id)
SELECT dyad_id, {r6("wt - wc")} AS asymmetry, CASE WHEN wc > 0 AND wt > 0 THEN 'Bidirectional' WHEN wc > 0 THEN 'Client-led' WHEN wt > 0 THEN 'Therapist-led' ELSE 'Weak' END AS quadrant FROM a""")
def phase_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = markov.directionality_by_dyad(markov.directionality(_sessions(spark, sf_dir)))
    return d.select("dyad_id", rounded(F.col("dT_wmean") - F.col("dC_wmean")).alias("asymmetry"), quadrant(F.col("dC_wmean"), F.col("dT_wmean")).alias("quadrant"))


@query(f"""WITH {STEPS}, n AS (SELECT session_id, cast('0x' || substr(md5(cast(any_value(dyad_id) AS VARCHAR)), 1, 8) AS BIGINT) % {N_SPLITS} AS fold, count(*) AS k FROM steps GROUP BY session_id),
f AS (SELECT fold, count(*) AS sessions, cast(sum(greatest(k - 1, 0)) AS BIGINT) AS held FROM n GROUP BY fold)
SELECT cast(fold AS INT) AS fold, sessions, held AS test_transitions, cast((SELECT sum(held) FROM f) - held AS BIGINT) AS train_transitions FROM f""")
def fold_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = steps(spark, sf_dir).groupBy("session_id", "dyad_id").agg(F.count("*").alias("k")).withColumn("fold", fold_of(F.col("dyad_id"), N_SPLITS))
    f = n.groupBy("fold").agg(F.count("*").alias("sessions"), F.sum(F.greatest(F.col("k") - 1, F.lit(0))).alias("test_transitions"))
    return f.withColumn("train_transitions", F.sum("test_transitions").over(Window.partitionBy(F.lit(0))) - F.col("test_transitions"))


@query(f"""WITH {STEPS}, s AS (SELECT session_id, any_value(dyad_id) AS dyad_id, md5(string_agg(cast(th AS VARCHAR), ',' ORDER BY pos)) AS h FROM steps GROUP BY session_id)
SELECT dyad_id, count(*) AS n, md5(string_agg(h, '|' ORDER BY h)) AS digest FROM s GROUP BY dyad_id""")
def training_set_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(POS, "th"))), lambda x: x["th"].cast("string"))
    s = steps(spark, sf_dir).groupBy("session_id", "dyad_id").agg(F.md5(F.array_join(ordered, ",").cast("binary")).alias("h"))
    return s.groupBy("dyad_id").agg(F.count("*").alias("n"), multiset_digest(F.col("h")).alias("digest"))


@query("SELECT cast(h AS INT) AS horizon, cast(NULL AS DOUBLE) AS gain FROM unnest([1, 2, 5, 10]) AS t(h)")
def horizon_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizons asked for, without values: nothing is computed behind them."""
    return spark.createDataFrame([(h,) for h in (1, 2, 5, 10)], "horizon int").withColumn("gain", F.lit(None).cast("double"))
