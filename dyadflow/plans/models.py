"""Hidden Markov models, components and mixed models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.operators import hmm, lmm, pca, stats
from dyadflow.operators.folds import fold_of
from dyadflow.plans.registry import query
from dyadflow.plans.relations import features, rounding
from dyadflow.plans.steps import STEPS, r6, steps

#: A model given as numbers, for the queries that SQL checks.
MODEL = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.3, 0.2], [0.1, 0.3, 0.6]]), np.array([[0.2, 0.3, 0.5], [0.4, 0.4, 0.2]]))


def _emit(k: int, s: str = "s") -> str:
    pick = lambda p, x: f"(CASE {s}.{x} WHEN 0 THEN {p[0]} WHEN 1 THEN {p[1]} ELSE {p[2]} END)"
    return f"({pick(MODEL.pt[k], 'th')} * {pick(MODEL.pc[k], 'cl')})"


_A, _PI = MODEL.a, MODEL.pi


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.sessions(steps(spark, sf_dir), "session_id", "dyad_id")


@query(f"""WITH RECURSIVE {STEPS}, f AS (SELECT session_id, 0::BIGINT AS pos, ln({_PI[0]} * {_emit(0)} + {_PI[1]} * {_emit(1)}) AS ll, {_PI[0]} * {_emit(0)} / ({_PI[0]} * {_emit(0)} + {_PI[1]} * {_emit(1)}) AS a0 FROM steps AS s WHERE pos = 0
UNION ALL SELECT session_id, pos, ll + ln(x + y), x / (x + y) FROM (SELECT s.session_id, s.pos, f.ll, (a0 * {_A[0, 0]} + (1 - a0) * {_A[1, 0]}) * {_emit(0)} AS x, (a0 * {_A[0, 1]} + (1 - a0) * {_A[1, 1]}) * {_emit(1)} AS y FROM f JOIN steps AS s ON s.session_id = f.session_id AND s.pos = f.pos + 1))
SELECT session_id, count(*) AS n_steps, {r6("arg_max(ll, pos)")} AS ll FROM f GROUP BY session_id""")
def hmm_forward_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sessions(spark, sf_dir)
    return rounding(d.select("session_id", F.size("T").cast("long").alias("n_steps"), hmm.forward_expression(MODEL, F.col("T"), F.col("C")).alias("ll")))


def _step(j: int) -> tuple[str, str]:
    return f"d0 + ln({_A[0, j]})", f"d1 + ln({_A[1, j]})"


@query(f"""WITH RECURSIVE {STEPS}, v AS (SELECT session_id, 0::BIGINT AS pos, ln({_PI[0]}) + ln({_emit(0)}) AS d0, ln({_PI[1]}) + ln({_emit(1)}) AS d1, [0] AS p0, [1] AS p1 FROM steps AS s WHERE pos = 0
UNION ALL SELECT session_id, pos, greatest({_step(0)[0]}, {_step(0)[1]}) + e0, greatest({_step(1)[0]}, {_step(1)[1]}) + e1,
CASE WHEN {_step(0)[0]} >= {_step(0)[1]} THEN list_append(p0, 0) ELSE list_append(p1, 0) END, CASE WHEN {_step(1)[0]} >= {_step(1)[1]} THEN list_append(p0, 1) ELSE list_append(p1, 1) END
FROM (SELECT s.session_id, s.pos, d0, d1, p0, p1, ln({_emit(0)}) AS e0, ln({_emit(1)}) AS e1 FROM v JOIN steps AS s ON s.session_id = v.session_id AND s.pos = v.pos + 1)),
l AS (SELECT session_id, arg_max(CASE WHEN d0 >= d1 THEN p0 ELSE p1 END, pos) AS path FROM v GROUP BY session_id)
SELECT session_id, cast(len(path) AS BIGINT) AS n_steps, array_to_string(path, '') AS path, cast(list_sum(path) AS BIGINT) AS in_state_1 FROM l""")
def hmm_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hmm.decoded(sessions(spark, sf_dir), MODEL)
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), "")
    return d.select("session_id", "n_steps", text.alias("path"), F.aggregate("path", F.lit(0).cast("long"), lambda a, x: a + x).alias("in_state_1"))


def _back(i: int) -> str:
    return f"({_A[i, 0]} * {_emit(0)} * b0 + {_A[i, 1]} * {_emit(1)} * (1 - b0))"


@query(f"""WITH RECURSIVE {STEPS}, n AS (SELECT session_id, any_value(dyad_id) AS dyad_id, count(*) AS n_steps FROM steps GROUP BY session_id),
f AS (SELECT session_id, 0::BIGINT AS pos, {_PI[0]} * {_emit(0)} / ({_PI[0]} * {_emit(0)} + {_PI[1]} * {_emit(1)}) AS a0 FROM steps AS s WHERE pos = 0
UNION ALL SELECT session_id, pos, x / (x + y) FROM (SELECT s.session_id, s.pos, (a0 * {_A[0, 0]} + (1 - a0) * {_A[1, 0]}) * {_emit(0)} AS x, (a0 * {_A[0, 1]} + (1 - a0) * {_A[1, 1]}) * {_emit(1)} AS y FROM f JOIN steps AS s ON s.session_id = f.session_id AND s.pos = f.pos + 1)),
b AS (SELECT session_id, n_steps - 1 AS pos, 0.5::DOUBLE AS b0 FROM n
UNION ALL SELECT session_id, pos, x / (x + y) FROM (SELECT s.session_id, s.pos - 1 AS pos, {_back(0)} AS x, {_back(1)} AS y FROM b JOIN steps AS s ON s.session_id = b.session_id AND s.pos = b.pos WHERE s.pos > 0)),
g AS (SELECT session_id, avg(a0 * b0 / (a0 * b0 + (1 - a0) * (1 - b0))) AS o FROM f JOIN b USING (session_id, pos) GROUP BY session_id)
SELECT session_id, dyad_id, n_steps, {r6("o")} AS occ_0, {r6("1 - o")} AS occ_1 FROM n JOIN g USING (session_id)""")
def hmm_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(hmm.occupancy_wide(hmm.decoded(sessions(spark, sf_dir), MODEL), 2, "session_id", "dyad_id"))


@query()
def hmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distributed fit: the model's parameters in long form."""
    m, ll = hmm.fit_distributed(sessions(spark, sf_dir), 3, 903_000, n_iter=150)
    rows = [("a", i, j, float(m.a[i, j])) for i in range(3) for j in range(3)] + [(n, i, j, float(p[i, j])) for n, p in (("pt", m.pt), ("pc", m.pc)) for i in range(3) for j in range(3)] + [("pi", i, 0, float(m.pi[i])) for i in range(3)] + [("ll", 0, 0, ll)]
    return rounding(spark.createDataFrame(rows, "part string, i int, j int, p double"))


@query()
def hmm_model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two and three states, five folds, three restarts of 150 iterations at most: all fits run in parallel."""
    d = sessions(spark, sf_dir).withColumn("fold", fold_of(F.col("dyad_id"), 5))
    return rounding(hmm.selection(hmm.fit_tasks(d, hmm.cv_tasks((2, 3), ((1.0, 1.0),), 5, 3), n_iter=150)))


_COLS = ("occ_entropy", "trans_entropy", "switching_rate", "mean_dwell", "cv_dwell")


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounding(pca.scores(f, pca.fit(f, _COLS, 3)).select("session_id", "dyad_id", "pc1", "pc2", "pc3"))


@query()
def mixed_model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(lmm.model_grid(features(spark, sf_dir), ("switching_rate", "mean_dwell"), ("occ_entropy", "trans_entropy"), ("length",), "dyad_id", "volatility"))


@query()
def within_between_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(lmm.model_table(spark, [({"outcome": "switching_rate"}, lmm.within_between(features(spark, sf_dir), "switching_rate", "occ_entropy", ["length"], "dyad_id"))]))


@query()
def slope_cancellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether slopes of opposite signs cancel in the fixed effect: the slopes' spread, the random slope's variance and the
    fixed effect's p together."""
    f = features(spark, sf_dir)
    fit = lmm.random_slope(f, "mean_dwell", "length", [], "dyad_id")
    s = stats.slope_summary(stats.ols_slopes(f, "length", "mean_dwell", "dyad_id"))
    p = next(r["p_value"] for r in fit.table() if r["term"] == "length")
    s = s.withColumns({"random_slope_variance": F.lit(float(fit.random_cov[1, 1])), "fixed_effect_p": F.lit(p)})
    likely = F.col("sym_centered") & F.col("mixed_signs") & (F.col("random_slope_variance") > 0) & (F.col("fixed_effect_p").isNull() | (F.col("fixed_effect_p") > 0.05))
    return rounding(s.withColumn("cancellation_likely", likely))
