"""The step tables that queries read, bound to `events`, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions.scalars import joint
from dyadflow.operators.sequence import positioned
from dyadflow.session import table


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, dyad_id, therapist_id, pos, t (seconds), th and cl (valence codes), event_type and value."""
    e = table(spark, sf_dir, "events")
    th = F.when(F.col("event_type") == "error", 0).when(F.col("event_type").isin("view", "click"), 1).otherwise(2)
    cl = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 3
    d = e.select(F.col("user_id").alias("session_id"), (F.col("user_id") % 10).alias("dyad_id"), (F.col("user_id") % 4).alias("therapist_id"), "ts", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), th.alias("th"), cl.alias("cl"), "event_type", "value")
    return positioned(d, "ts", "event_id")


#: Steps in a stretch of one regime: a stand-in for decoded paths where SQL checks the query.
STRETCH = 20


def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """steps with regime, which changes every STRETCH steps, and x, the joint symbol."""
    return steps(spark, sf_dir).withColumns({"regime": (F.floor(F.col("pos") / STRETCH) % 3).cast("int"), "x": joint("th", "cl")})


STEPS = f"""steps AS (
  SELECT *, cast(floor(pos / {STRETCH}) AS BIGINT) % 3 AS regime, th * 3 + cl AS x FROM (
  SELECT user_id AS session_id, user_id % 10 AS dyad_id, user_id % 4 AS therapist_id, ts, epoch_us(ts) / 1e6 AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         CASE WHEN event_type = 'error' THEN 0 WHEN event_type IN ('view', 'click') THEN 1 ELSE 2 END AS th,
         cast(regexp_extract(props, '([0-9]+)', 1) AS INT) % 3 AS cl, event_type, value FROM events))"""


def runs_sql(value: str, source: str = "steps") -> str:
    """CTEs that end in runs(session_id, run, value, a, b, n)."""
    return f"""flags AS (SELECT *, CASE WHEN lag({value}) OVER w = {value} OR lag({value}) OVER w IS NULL THEN 0 ELSE 1 END AS f FROM {source} WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
numbered AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY pos) AS run FROM flags),
runs AS (SELECT session_id, cast(run AS BIGINT) AS run, {value} AS v, min(pos) AS a, max(pos) + 1 AS b, count(*) AS n FROM numbered GROUP BY ALL)"""


#: CTEs that end in ep(episode, session_id, dyad_id, regime, a, b, duration) and eps (the steps inside, with q, the position inside).
EPISODES = f"""{STEPS}, {runs_sql("regime")},
ep AS (SELECT session_id || '_' || v || '_' || a || '_' || b AS episode, session_id, session_id % 10 AS dyad_id, v AS regime, a, b, n AS duration FROM runs WHERE n >= 5),
eps AS (SELECT ep.*, pos, pos - a AS q, x, th, cl FROM ep JOIN steps ON steps.session_id = ep.session_id AND pos >= a AND pos < b)"""


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
