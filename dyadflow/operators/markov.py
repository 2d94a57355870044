"""Smoothed Markov models of two coupled streams, fitted and scored for all folds in one plan.

Sessions are first reduced to counts of (previous, previous, next, next) cells, K^4 at most; everything after that works
on counts. A fold's training counts are all counts less its own, so nothing is scanned once per fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.operators.sequence import transitions

CELL = ("th_prev", "cl_prev", "th", "cl")


def cells(steps: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys and the four codes of a transition, with n. `keys` must determine the session."""
    return transitions(steps, "th", "cl").groupBy(*keys, *CELL).agg(F.count("*").alias("n"))


def _smoothed(n: Column, own: list[str], given: list[str], alpha: float, k: int) -> Column:
    of = lambda c: F.sum(n).over(Window.partitionBy(*c))
    return (of(own) + F.lit(float(alpha))) / (of(given) + F.lit(float(alpha * k)))


def model_grid(counts: DataFrame, alpha: float = 1.0, n_states: int = 3, fold: str = "fold", leave_out: bool = False) -> DataFrame:
    """For each fold and each cell of the dense grid: the log probabilities of the therapist's and the client's next code
    by themselves (th_own, cl_own) and given both previous codes (th_both, cl_both). counts(fold, cell, n) are the fold's
    training counts, or with leave_out what the fold holds out, so that all else trains it. Cells that aren't there
    count 0, so a state that wasn't seen has a uniform row."""
    if alpha <= 0:
        raise ValueError("alpha must be positive: unseen transitions would have no probability")
    states = F.sequence(F.lit(0), F.lit(n_states - 1))
    grid = counts.select(fold).distinct()
    for c in CELL:
        grid = grid.withColumn(c, F.explode(states))
    d = grid.join(counts, [fold, *CELL], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if leave_out:
        d = d.withColumn("n", F.sum("n").over(Window.partitionBy(*CELL)) - F.col("n"))
    n = F.col("n")
    # The grid has each (previous, previous, next, next) once, so sums over it are marginal counts.
    p = {
        "th_own": _smoothed(n, [fold, "th_prev", "th"], [fold, "th_prev"], alpha, n_states),
        "cl_own": _smoothed(n, [fold, "cl_prev", "cl"], [fold, "cl_prev"], alpha, n_states),
        "th_both": _smoothed(n, [fold, "th_prev", "cl_prev", "th"], [fold, "th_prev", "cl_prev"], alpha, n_states),
        "cl_both": _smoothed(n, [fold, "cl_prev", "th_prev", "cl"], [fold, "cl_prev", "th_prev"], alpha, n_states),
    }
    return d.select(fold, *CELL, *(F.log(v).alias(k) for k, v in p.items()))


def cross_validated(steps: DataFrame, fold: Column, keys: tuple[str, ...] = ("session_id", "dyad_id"), alpha: float = 1.0, n_states: int = 3) -> DataFrame:
    """fold, keys, nt (transitions) and the four log-likelihoods of each session under models of the other folds.

    Sessions of one step aren't scored. A code outside 0..n_states-1 is an error."""
    good = F.when(F.col("th").between(0, n_states - 1) & F.col("cl").between(0, n_states - 1), F.col("th"))
    checked = steps.withColumn("th", F.when(good.isNull(), F.raise_error(F.lit(f"a code outside 0..{n_states - 1}")).cast("int")).otherwise(good))
    c = cells(checked.withColumn("fold", fold), ("fold", *keys))
    grid = model_grid(c.groupBy("fold", *CELL).agg(F.sum("n").alias("n")), alpha, n_states, leave_out=True)
    scored = c.join(F.broadcast(grid), ["fold", *CELL])  # folds times K^4 rows
    total = lambda x: F.sum(F.col("n") * F.col(x)).alias(x)
    return scored.groupBy("fold", *keys).agg(F.sum("n").alias("nt"), *(total(x) for x in ("th_own", "cl_own", "th_both", "cl_both")))


def coupling(scores: DataFrame, keys: tuple[str, ...] = ("session_id", "dyad_id")) -> DataFrame:
    """How much better both streams together predict the next codes than each by itself, for each session."""
    n = 2 * F.col("nt")
    ll0, ll1 = F.col("th_own") + F.col("cl_own"), F.col("th_both") + F.col("cl_both")
    return scores.select("fold", *keys, n.alias("n_transitions"), ll0.alias("ll0_total"), ll1.alias("ll1_total"), (ll0 / n).alias("ll0_per_trans"), (ll1 / n).alias("ll1_per_trans"), ((ll1 - ll0) / n).alias("gain_per_trans"))


def directionality(scores: DataFrame, keys: tuple[str, ...] = ("session_id", "dyad_id")) -> DataFrame:
    """The same gain apart for the therapist's codes (dT) and the client's (dC)."""
    n, dt, dc = F.col("nt"), F.col("th_both") - F.col("th_own"), F.col("cl_both") - F.col("cl_own")
    return scores.select("fold", *keys, n.alias("nT"), n.alias("nC"), (dt / n).alias("dT_per_trans"), (dc / n).alias("dC_per_trans"), dt.alias("dT_total"), dc.alias("dC_total"))


def coupling_by_dyad(sessions: DataFrame) -> DataFrame:
    g, n = F.col("gain_per_trans"), F.col("n_transitions")
    return sessions.groupBy("dyad_id").agg(F.count("*").alias("n_samples"), F.sum(n).alias("n_transitions"), (F.sum(g * n) / F.sum(n)).alias("gain_per_trans_wmean"), F.avg(g).alias("gain_per_trans_mean"), F.median(g).alias("gain_per_trans_median"))


def directionality_by_dyad(sessions: DataFrame) -> DataFrame:
    wmean = lambda v, w: F.sum(F.col(v) * F.col(w)) / F.sum(w)
    d = sessions.groupBy("dyad_id").agg(F.count("*").alias("n_samples"), F.sum("nT").alias("nT"), wmean("dT_per_trans", "nT").alias("dT_wmean"), F.sum("nC").alias("nC"), wmean("dC_per_trans", "nC").alias("dC_wmean"))
    total = F.col("nT") + F.col("nC")
    return d.withColumns({"dT_per_trans_wmean": F.col("dT_wmean"), "dC_per_trans_wmean": F.col("dC_wmean"), "n_transitions": total, "avg_trans_per_session": total / F.col("n_samples")})
