"""Runs, debouncing, windows, episodes and what they sum up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions.scalars import episode_id, rounded, window_id
from dyadflow.operators import sequence as S
from dyadflow.plans.registry import query
from dyadflow.plans.steps import EPISODES, STEPS, r6, regimes, runs_sql, steps


@query(f"WITH {STEPS}, {runs_sql('event_type')} SELECT session_id, run, v AS event_type, a AS \"start\", b AS \"end\", n AS length FROM runs")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs(steps(spark, sf_dir), "event_type")


def _debounced_sql(k: int) -> str:
    return f"""WITH {STEPS}, {runs_sql("th")},
near AS (SELECT *, lag(v) OVER w AS lv, lag(n) OVER w AS ln, lead(v) OVER w AS rv, lead(n) OVER w AS rn FROM runs WINDOW w AS (PARTITION BY session_id ORDER BY run)),
fixed AS (SELECT session_id, run, CASE WHEN n > {k} OR (lv IS NULL AND rv IS NULL) THEN v WHEN lv IS NULL THEN rv WHEN rv IS NULL THEN lv WHEN lv = rv THEN lv WHEN ln >= rn THEN lv ELSE rv END AS v FROM near)
SELECT session_id, pos, th AS raw, v AS th FROM numbered JOIN fixed ON numbered.session_id = fixed.session_id AND numbered.run = fixed.run"""


@query(_debounced_sql(1).replace("SELECT session_id, pos", "SELECT numbered.session_id, pos"))
def debounced_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = steps(spark, sf_dir).withColumn("raw", F.col("th"))
    return S.debounced(d, "th", 1).select("session_id", "pos", "raw", "th")


@query(_debounced_sql(2).replace("SELECT session_id, pos, th AS raw, v AS th", "SELECT numbered.session_id, count(*) AS n, sum(cast(th <> v AS INT)) AS changed") + " GROUP BY ALL")
def debounce_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = steps(spark, sf_dir).withColumn("raw", F.col("th"))
    return S.debounced(d, "th", 2).groupBy("session_id").agg(F.count("*").alias("n"), F.sum((F.col("raw") != F.col("th")).cast("int")).alias("changed"))


@query(f"""WITH {STEPS}, n AS (SELECT session_id, count(*) AS n, least(30, count(*)) AS win FROM steps GROUP BY session_id),
w AS (SELECT session_id, i AS k, i * 10 AS a, i * 10 + win AS b FROM n, unnest(range(0, (n - win) // 10 + 1)) AS t(i))
SELECT w.session_id, k AS "window", session_id || '__w' || lpad(cast(k AS VARCHAR), 4, '0') AS window_id, a AS w_start, b AS w_end, count(*) AS n_steps, {r6("avg(th)")} AS mean_th, {r6("avg(cl)")} AS mean_cl
FROM w JOIN steps USING (session_id) WHERE pos >= a AND pos < b GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.windowed(steps(spark, sf_dir), 30, 10).groupBy("session_id", "window", "w_start", "w_end").agg(F.count("*").alias("n_steps"), rounded(F.avg("th")).alias("mean_th"), rounded(F.avg("cl")).alias("mean_cl"))
    return d.withColumn("window_id", window_id(F.col("session_id"), F.col("window")))


@query(f"""WITH {STEPS}, d AS (SELECT session_id, t - lag(t) OVER (PARTITION BY session_id ORDER BY pos) AS d FROM steps),
m AS (SELECT session_id, count(*) AS n, CASE WHEN median(d) > 0 THEN median(d) ELSE 1.0 END AS dt FROM d GROUP BY session_id),
w AS (SELECT *, cast(round_even(250000 / dt, 0) AS BIGINT) AS win FROM m)
SELECT session_id, n, {r6("dt")} AS dt, win, greatest(cast(round_even(win * 0.5, 0) AS BIGINT), 1) AS step FROM w""")
def session_window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.window_sizes(S.sampling_interval(steps(spark, sf_dir), "t"), 250_000, 0.5).withColumn("dt", rounded(F.col("dt")))


@query(f"WITH {EPISODES} SELECT episode AS episode_id, session_id, cast(regime AS INT) AS regime, a AS \"start\", b AS \"end\", duration FROM ep")
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.episodes(regimes(spark, sf_dir), 5).withColumn("episode_id", episode_id(*(F.col(c) for c in ("session_id", "regime", "start", "end"))))


@query(f"""WITH {STEPS}, {runs_sql("event_type")} SELECT v AS event_type, count(*) AS n_episodes, {r6("avg(n)")} AS mean_dwell, {r6("median(n)")} AS median_dwell, {r6("stddev_samp(n)")} AS sd_dwell, cast(sum(n) AS BIGINT) AS total FROM runs GROUP BY v""")
def dwell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.runs(steps(spark, sf_dir), "event_type")
    return r.groupBy("event_type").agg(F.count("*").alias("n_episodes"), rounded(F.avg("length")).alias("mean_dwell"), rounded(F.median("length")).alias("median_dwell"), rounded(F.stddev_samp("length")).alias("sd_dwell"), F.sum("length").alias("total"))


@query(f"""WITH {STEPS}, c AS (SELECT session_id, th <> lag(th) OVER (PARTITION BY session_id ORDER BY pos) AS c FROM steps)
SELECT session_id, count(*) AS n, {r6("coalesce(avg(cast(c AS DOUBLE)), 0)")} AS switching_rate FROM c GROUP BY session_id""")
def switching_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.switching(steps(spark, sf_dir), "th").withColumn("switching_rate", rounded(F.col("switching_rate")))


@query(f"""WITH {STEPS}, {runs_sql("th")} SELECT session_id, count(*) AS n_runs, {r6("avg(n)")} AS mean_dwell, {r6("stddev_pop(n) / avg(n)")} AS cv_dwell FROM runs GROUP BY session_id""")
def session_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.dwell(steps(spark, sf_dir), "th")
    return d.withColumns({c: rounded(F.col(c)) for c in ("mean_dwell", "cv_dwell")})
