"""Counts, ranges and samples that reports are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadflow.operators import hmm, motifs, recurrence, rollup
from dyadflow.operators import sequence as S
from dyadflow.operators.folds import balanced_folds
from dyadflow.plans.models import MODEL, sessions
from dyadflow.plans.patterns import EP, _ids, _metrics, _rqa, episode_steps
from dyadflow.plans.registry import ORACLES, query
from dyadflow.plans.relations import FEATURES, _TRANS, features, rounding, transition_matrix
from dyadflow.plans.steps import EPISODES, STEPS, r6, regimes, steps


@query(f"WITH {EPISODES} SELECT cast(regime AS INT) AS regime, count(*) AS n_episodes, cast(sum(duration) AS BIGINT) AS total, count(DISTINCT dyad_id) AS n_dyads, min(duration) AS shortest, max(duration) AS longest FROM ep GROUP BY regime")
def episode_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.episodes(regimes(spark, sf_dir).select("session_id", "dyad_id", "pos", "regime"), 5, by=("session_id", "dyad_id"))
    return e.groupBy("regime").agg(F.count("*").alias("n_episodes"), F.sum("duration").alias("total"), F.count_distinct("dyad_id").alias("n_dyads"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"))


@query(f"WITH {EPISODES} SELECT session_id, cast(regime AS INT) AS regime, a AS \"start\", duration FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY session_id, a) AS r FROM ep WHERE duration >= 10) WHERE r <= 3")
def example_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three long episodes of each regime, for plots: the limit is the report."""
    e = S.episodes(regimes(spark, sf_dir), 10)
    first = F.row_number().over(Window.partitionBy("regime").orderBy("session_id", "start"))
    return e.withColumn("r", first).where("r <= 3").select("session_id", "regime", "start", "duration")


@query(f"""WITH {_TRANS}, g AS (SELECT CASE WHEN i = 0 THEN 'negative' ELSE 'other' END AS grp, p FROM mt WHERE i = j)
SELECT grp AS "group", {r6("min(p)")} AS least, {r6("max(p)")} AS most, count(*) AS n FROM g GROUP BY grp""")
def regime_group_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rollup.regime_dynamics(transition_matrix(spark, sf_dir)).withColumn("group", F.when(F.col("i") == 0, "negative").otherwise("other"))
    return rounding(d.groupBy("group").agg(F.min("self_transition").alias("least"), F.max("self_transition").alias("most"), F.count("*").alias("n")))


_SANITY = ("motif_entropy", "repeat_rate", "top_mass")


@query(f"""WITH {EPISODES}, {_ids(2)}, {_metrics(2)}, l AS (UNPIVOT (SELECT episode, {", ".join(f"cast({m} AS DOUBLE) AS {m}" for m in _SANITY)} FROM met) ON {", ".join(_SANITY)} INTO NAME metric VALUE v)
SELECT metric, count(*) AS n, {r6("avg(v)")} AS mean, {r6("stddev_samp(v)")} AS sd FROM l GROUP BY metric""")
def metric_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motifs.motif_metrics(motifs.motif_ids(episode_steps(spark, sf_dir), 2, EP), 2, EP)
    d = m.unpivot("episode", list(_SANITY), "metric", "v")
    return rounding(d.groupBy("metric").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")))


@query(f"WITH {FEATURES} SELECT dyad_id, count(*) AS n, {', '.join(f'{r6(f'avg({c})')} AS {c}' for c in ('occ_entropy', 'mean_dwell', 'switching_rate'))} FROM ft GROUP BY dyad_id")
def dyad_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(features(spark, sf_dir).groupBy("dyad_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("occ_entropy", "mean_dwell", "switching_rate"))))


@query(f"""WITH {EPISODES}, {_rqa("episode")}, s AS (SELECT dyad_id, avg((det + lam) / 2) AS structure FROM rqa JOIN ep USING (episode) GROUP BY dyad_id), f AS (SELECT dyad_id, avg(cast(th = 0 AS DOUBLE)) AS negative, count(*) AS n FROM steps GROUP BY dyad_id)
SELECT dyad_id, {r6("structure")} AS structure, {r6("negative")} AS negative, n FROM f LEFT JOIN s USING (dyad_id)""")
def dyad_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = episode_steps(spark, sf_dir)
    who = d.select("episode", "dyad_id").distinct()
    s = recurrence.recurrence(d, EP).join(who, "episode").groupBy("dyad_id").agg(F.avg((F.col("det") + F.col("lam")) / 2).alias("structure"))
    f = steps(spark, sf_dir).groupBy("dyad_id").agg(F.avg((F.col("th") == 0).cast("double")).alias("negative"), F.count("*").alias("n"))
    return rounding(f.join(s, "dyad_id", "left").select("dyad_id", "structure", "negative", "n"))


@query(f"""WITH {STEPS}, d AS (SELECT dyad_id, session_id, pos, t, t - lag(t) OVER (PARTITION BY session_id ORDER BY pos) AS gap FROM steps)
SELECT dyad_id, count(gap) AS n, {r6("median(gap)")} AS median_gap, {r6("max(gap)")} AS longest_gap FROM d GROUP BY dyad_id""")
def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("session_id").orderBy("pos"))
    d = steps(spark, sf_dir).withColumn("gap", gap)
    median = rollup.quantiles(d, "gap", (0.5,), "dyad_id").select("dyad_id", F.col("value").alias("median_gap"))
    return rounding(d.groupBy("dyad_id").agg(F.count("gap").alias("n"), F.max("gap").alias("longest_gap")).join(median, "dyad_id", "left"))


@query(f"""WITH v AS ({ORACLES["hmm_viterbi"]}), p AS (SELECT session_id, i - 1 AS pos, cast(path[i] AS INT) AS regime FROM v, unnest(range(1, len(path) + 1)) AS t(i))
SELECT session_id, regime, count(*) AS n, min(pos) AS "first" FROM p GROUP BY session_id, regime""")
def hmm_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded path and each regime's share, in long form."""
    d = hmm.decoded(sessions(spark, sf_dir), MODEL)
    return hmm.paths_long(d, "session_id").groupBy("session_id", "regime").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@query(f"""WITH RECURSIVE {STEPS}, g AS (SELECT dyad_id, n, row_number() OVER (ORDER BY n DESC, dyad_id) AS r FROM (SELECT dyad_id, count(DISTINCT session_id) AS n FROM steps GROUP BY dyad_id)),
a AS (SELECT 0::BIGINT AS r, [0, 0, 0, 0, 0]::BIGINT[] AS load, NULL::BIGINT AS dyad_id, NULL::BIGINT AS fold
UNION ALL SELECT g.r, list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN n ELSE 0 END), g.dyad_id, list_position(load, list_min(load)) - 1 FROM a JOIN g ON g.r = a.r + 1)
SELECT dyad_id, cast(fold AS INT) AS fold FROM a WHERE r > 0""")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_folds(steps(spark, sf_dir).select("session_id", "dyad_id").distinct(), "dyad_id")
