"""The session table, models' blocks, roll-ups by class, and frames for plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.operators import analysis, hmm, lmm, markov, motifs, pca, recurrence
from dyadflow.operators import sequence as S
from dyadflow.plans.coupling import _sessions
from dyadflow.plans.models import _COLS, MODEL, sessions
from dyadflow.plans.patterns import EP, _ids, _metrics, _rqa, episode_steps
from dyadflow.plans.registry import ORACLES, query
from dyadflow.plans.relations import FEATURES, _MODEL, features, regime_labels, rounding
from dyadflow.plans.steps import EPISODES, STEPS, r6, regimes
from dyadflow.session import cut, table

_CODE = "CASE WHEN s_suppkey % 5 = 0 THEN 'none' ELSE ' ' || (s_suppkey - 1) || ' a' END"
_TOTALS = ("CASE WHEN s_suppkey % 7 = 0 THEN '#VALUE!' ELSE cast(s_acctbal AS VARCHAR) END", "cast(s_suppkey AS VARCHAR)")
PRIMARY, SUBSCALES = ("difference", "wait"), ("waic", "wait")


def _survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A survey out of `supplier`: codes of sessions, some missing, and cells that aren't all numbers."""
    k = F.col("s_suppkey")
    code = F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit(" "), (k - 1).cast("string"), F.lit(" a")))
    waic = F.when(k % 7 == 0, "#VALUE!").otherwise(F.col("s_acctbal").cast("string"))
    d = table(spark, sf_dir, "supplier").select(code.alias("Session Code"), waic.alias("waic"), k.cast("string").alias("wait"))
    return analysis.survey_rows(d, "Session Code", ("waic", "wait"), "waic", "wait")


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sessions(spark, sf_dir)
    f = features(spark, sf_dir)
    decoded = f.select("session_id", "dyad_id", "occ_0", "occ_1", "occ_2", F.col("length").alias("n_steps"))
    rest = f.select("session_id", "switching_rate", "mean_dwell", "cv_dwell", "trans_entropy", "occ_entropy")
    key = F.concat(F.format_string("%03d", F.col("session_id").cast("int")), F.lit("_A"))
    return analysis.session_table(markov.coupling(s), markov.directionality(s), decoded, rest, _survey(spark, sf_dir), key)


@query(f"""WITH s AS (SELECT printf('%03d', cast(s_suppkey - 1 AS INT)) || '_A' AS k, try_cast({_TOTALS[0]} AS DOUBLE) AS waic, cast(s_suppkey AS DOUBLE) AS wait FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT c.fold, c.session_id, c.dyad_id, c.n_transitions, f.length AS n_steps, c.gain_per_trans AS delta_ll, d."dT_per_trans" AS delta_t, d."dC_per_trans" AS delta_c, f.occ_0 AS p_1, f.occ_1 AS p_2, f.occ_2 AS p_3, f.switching_rate, f.mean_dwell, f.trans_entropy,
round(s.waic, 6) + 0.0 AS waic, s.wait + 0.0 AS wait, round(s.waic - s.wait, 6) + 0.0 AS difference
FROM ({ORACLES["coupling_cv"]}) AS c LEFT JOIN ({ORACLES["directionality_cv"]}) AS d USING (fold, session_id, dyad_id) LEFT JOIN ({ORACLES["session_features"]}) AS f USING (session_id, dyad_id) LEFT JOIN s ON s.k = printf('%03d', cast(c.session_id AS INT)) || '_A'""")
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("fold", "session_id", "dyad_id", "n_transitions", "n_steps", "delta_ll", "delta_t", "delta_c", "p_1", "p_2", "p_3", "switching_rate", "mean_dwell", "trans_entropy", "waic", "wait", "difference")
    return rounding(session_rows(spark, sf_dir).select(*names))


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(session_rows(spark, sf_dir))
    d = pca.scores(d, pca.fit(d, _COLS, 2))
    outcomes = {"coupling": ["delta_ll", "delta_t", "delta_c"], "volatility": ["pc1", "pc2", "switching_rate"], "occupancy": analysis.numbered(d.columns, "p_")}
    blocks = analysis.model_blocks(outcomes, PRIMARY, SUBSCALES, {"coupling": ["n_transitions"], "volatility": ["n_steps"], "occupancy": ["n_steps"]})
    return analysis.run_blocks(d, blocks, "dyad_id")


@query()
def survey_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(_effects(spark, sf_dir))


@query()
def six_test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(analysis.focus_summary(_effects(spark, sf_dir), ("delta_ll", "pc1", "pc2"), PRIMARY))


@query()
def coefficient_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(session_rows(spark, sf_dir))
    d = pca.scores(d, pca.fit(d, _COLS, 2))
    return rounding(analysis.coefficient_frame(analysis.coefficient_models(d, PRIMARY, ("pc1", "pc2"), "dyad_id")))


@query(f"""WITH x AS (SELECT round("dT_per_trans" - "dC_per_trans", 6) AS x FROM ({ORACLES["directionality_cv"]})), r AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2 AS k FROM x WHERE x <> 0)
SELECT count(*) AS n, {r6("avg(x)")} AS mean, {r6("median(x)")} AS median, (SELECT {r6("coalesce(sum(k) FILTER (WHERE x > 0), 0)")} FROM r) AS w, (SELECT count(*) FROM r) AS n_ranked FROM x""")
def asymmetry_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = markov.directionality(_sessions(spark, sf_dir))
    d = d.select(F.round(F.round("dT_per_trans", 6) - F.round("dC_per_trans", 6), 6).alias("t"), F.lit(0.0).alias("c"))
    return rounding(analysis.asymmetry(d, "t", "c").drop("p_greater", "p_two_sided"))


_METRICS = ("motif_entropy", "repeat_rate", "top_mass")
_CLASSES = {"1": "1/2", "2": "1/2"}


def _motif_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = episode_steps(spark, sf_dir)
    ep = d.select("episode", "session_id", "dyad_id", "regime", "duration").distinct()
    out = None
    for k in (2, 3):
        m = motifs.motif_metrics(motifs.motif_ids(d, k, EP), k, EP).select("episode", *_METRICS).withColumn("k", F.lit(k))
        out = m if out is None else out.unionByName(m)
    return out.join(ep, "episode").withColumn("regime_class", analysis.merged_classes(F.col("regime").cast("string"), _CLASSES))


@query(f"""WITH {EPISODES}, {_ids(2, name="m2")}, {_metrics(2, name="m2", out="e2")}, {_ids(3, name="m3")}, {_metrics(3, name="m3", out="e3")},
e AS (SELECT *, 2 AS k FROM e2 UNION ALL SELECT *, 3 AS k FROM e3), j AS (SELECT e.*, ep.session_id, ep.dyad_id, ep.duration, CASE WHEN regime IN (1, 2) THEN '1/2' ELSE cast(regime AS VARCHAR) END AS regime_class FROM e JOIN ep USING (episode)),
s AS (SELECT session_id, dyad_id, regime_class, k, {", ".join(f"sum({m} * duration) / sum(duration) AS {m}" for m in _METRICS)}, sum(duration) AS w, count(*) AS n FROM j GROUP BY ALL)
SELECT dyad_id, regime_class, k, {", ".join(f"{r6(f'sum({m} * w) / sum(w)')} AS {m}" for m in _METRICS)}, cast(sum(w) AS BIGINT) AS total_duration, count(DISTINCT session_id) AS n_sessions, cast(sum(n) AS BIGINT) AS n_episodes FROM s GROUP BY dyad_id, regime_class, k""")
def motif_class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(analysis.class_rollup(_motif_episodes(spark, sf_dir), _METRICS, ("regime_class", "k")))


@query(f"""WITH {EPISODES}, {_rqa("episode")}, e AS (SELECT * FROM rqa JOIN ep USING (episode)),
s AS (SELECT session_id, {", ".join(f"sum({m} * duration) / sum(duration) AS {m}" for m in ("rr", "det", "lam"))}, {", ".join(f"avg({m}) AS plain_{m}" for m in ("rr", "det", "lam"))} FROM e GROUP BY session_id)
SELECT f.session_id, f.dyad_id, f.occ_entropy, f.mean_dwell, {", ".join(f"{r6(c)} AS {c}" for m in ("rr", "det", "lam") for c in (m, f"plain_{m}"))} FROM ({ORACLES["session_features"]}) AS f JOIN s USING (session_id)""")
def session_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's features beside its episodes' recurrence, weighted by duration and, as without durations, plain."""
    d = episode_steps(spark, sf_dir)
    ep = d.select("episode", "session_id", "duration").distinct()
    names = ("rr", "det", "lam")
    e = recurrence.recurrence(d, EP).join(ep, "episode").persist()
    plain = analysis.by_session(e.drop("duration"), names).select("session_id", *(F.col(m).alias(f"plain_{m}") for m in names))
    both = analysis.by_session(e, names).join(plain, "session_id")
    return rounding(features(spark, sf_dir).select("session_id", "dyad_id", "occ_entropy", "mean_dwell").join(both, "session_id"))


@query(f"""WITH {EPISODES}, {_rqa("episode")}, s AS (SELECT dyad_id, avg(det) AS det, avg(lam) AS lam FROM rqa JOIN ep USING (episode) GROUP BY dyad_id)
SELECT s.dyad_id, {r6("det")} AS det, {r6("lam")} AS lam, c.n_samples AS n_samples_coupling, c.gain_per_trans_wmean, d.n_samples AS n_samples_direction, d."dT_wmean", d."dC_wmean"
FROM s JOIN ({ORACLES["coupling_by_dyad"]}) AS c USING (dyad_id) JOIN ({ORACLES["directionality_by_dyad"]}) AS d USING (dyad_id)""")
def structure_and_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = episode_steps(spark, sf_dir)
    who = d.select("episode", "dyad_id").distinct()
    s = recurrence.recurrence(d, EP).join(who, "episode").groupBy("dyad_id").agg(F.avg("det").alias("det"), F.avg("lam").alias("lam"))
    held = _sessions(spark, sf_dir)
    c = markov.coupling_by_dyad(markov.coupling(held)).select("dyad_id", F.col("n_samples").alias("n_samples_coupling"), "gain_per_trans_wmean")
    t = markov.directionality_by_dyad(markov.directionality(held)).select("dyad_id", F.col("n_samples").alias("n_samples_direction"), "dT_wmean", "dC_wmean")
    return rounding(s.join(c, "dyad_id").join(t, "dyad_id"))


@query(f"""WITH {EPISODES}, l AS ({ORACLES["regime_labels"]})
SELECT ep.session_id, cast(ep.regime AS INT) AS regime, ep.a AS "start", ep.duration, l.number, l.label FROM ep LEFT JOIN l ON l.state = ep.regime""")
def labelled_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with their regimes' numbers and labels: the labels are a row for each state of a model."""
    e = S.episodes(regimes(spark, sf_dir), 5)
    labels = regime_labels(spark, sf_dir).withColumnRenamed("state", "regime")
    assert len(_MODEL) < 1000  # bounds the broadcast
    return e.join(F.broadcast(labels), "regime", "left").select("session_id", "regime", "start", "duration", "number", "label")


@query(f"""WITH {FEATURES}, s AS (SELECT count(*) AS n, stddev_samp(mean_dwell) * pow(count(*), -0.2) AS h, min(mean_dwell) AS lo, max(mean_dwell) AS hi FROM ft),
g AS (SELECT k, lo + k * (hi - lo) / 49 AS x, n, h FROM s, unnest(range(50)) AS t(k))
SELECT cast(k AS INT) AS place, {r6("any_value(x)")} AS at, {r6("sum(exp(-0.5 * pow((x - mean_dwell) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))")} AS density FROM g, ft GROUP BY k""")
def dwell_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(analysis.density(features(spark, sf_dir), "mean_dwell"))


_X, _Y = ("occ_entropy", "trans_entropy"), ("switching_rate", "mean_dwell", "cv_dwell")


@query(f"""WITH {FEATURES} {" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r6(f'corr({a}, {b})')} AS r FROM ft" for a in _X for b in _Y)}""")
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(analysis.correlation_matrix(features(spark, sf_dir), _X, _Y))


@query()
def model_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    effects = lmm.model_table(spark, [({"outcome": "mean_dwell"}, lmm.random_intercept(f, "mean_dwell", ["occ_entropy", "length"], "dyad_id"))])
    return rounding(analysis.fitted_line(effects, f, "occ_entropy"))


@query(f"""WITH {STEPS}, l AS (SELECT session_id, dyad_id FROM steps GROUP BY ALL HAVING count(*) >= 30)
SELECT session_id, dyad_id, count(*) AS n_steps FROM steps SEMI JOIN l USING (session_id) GROUP BY ALL""")
def listed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the sessions that a manifest lists: here those of 30 steps or more."""
    from dyadflow.plans.steps import steps
    from dyadflow.sources.tables import listed

    d = steps(spark, sf_dir)
    manifest = d.groupBy("session_id").agg(F.count("*").alias("n_steps")).where("n_steps >= 30")
    return listed(d, manifest).groupBy("session_id", "dyad_id").agg(F.count("*").alias("n_steps"))


@query(f"""WITH v AS ({ORACLES["hmm_viterbi"]}), p AS (SELECT session_id, i - 1 AS pos, path[i] AS s FROM v, unnest(range(1, len(path) + 1)) AS t(i)),
f AS (SELECT *, CASE WHEN lag(s) OVER w = s THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY session_id ORDER BY pos)), g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY pos) AS run FROM f)
SELECT session_id, cast(s AS INT) AS regime, min(pos) AS "start", max(pos) + 1 AS "end", count(*) AS duration FROM g GROUP BY session_id, run, s HAVING count(*) >= 3""")
def decoded_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of decoded paths: from Viterbi to stretches of one regime."""
    d = hmm.decoded(sessions(spark, sf_dir), MODEL)
    return S.episodes(hmm.paths_long(d, "session_id"), 3)
