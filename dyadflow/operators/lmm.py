"""Linear mixed models by maximum likelihood, from sums that Spark makes.

A random intercept needs, for each group size, sums over its groups of products of group totals: rows by size, however
many groups there are. Random slopes need each group's own cross products, MAX_GROUPS groups at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.functions.tails import normal_sf

MAX_GROUPS = 200_000


@dataclass
class MixedFit:
    terms: list[str]
    beta: np.ndarray
    cov: np.ndarray
    sigma2: float
    random_cov: np.ndarray
    llf: float
    n: int
    n_groups: int
    converged: bool = True

    def table(self) -> list[dict]:
        """A row for each fixed effect: coef, se, z, two-sided p and a 95 % interval."""
        out = []
        for t, b, v in zip(self.terms, self.beta.tolist(), np.diag(self.cov).tolist(), strict=True):
            se = max(v, 0.0) ** 0.5
            z = b / se if se else None
            out.append({"term": t, "coef": b, "se": se, "z": z, "p_value": 2 * normal_sf(abs(z)) if z is not None else None, "ci_low": b - 1.959963984540054 * se, "ci_high": b + 1.959963984540054 * se, "effect_per_sd": b if t != "Intercept" else None, "n_sessions": self.n, "n_groups": self.n_groups})
        return out


TABLE = "term string, coef double, se double, z double, p_value double, ci_low double, ci_high double, effect_per_sd double, n_sessions long, n_groups long"


def prepared(df: DataFrame, outcome: str, predictors: Sequence[str], group: str) -> tuple[DataFrame, list[str]]:
    """Complete rows as (g, y, x0, x1, ...) with z-scored predictors; those without spread are left out."""
    d = df.select(F.col(group).alias("g"), *(F.nullif(F.col(c).try_cast("double"), F.lit(float("nan"))).alias(f"v{i}") for i, c in enumerate([outcome, *predictors]))).dropna()
    stats = d.agg(*(f(f"v{i}").alias(f"{k}{i}") for i in range(1, len(predictors) + 1) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    used = [i for i in range(1, len(predictors) + 1) if stats[f"s{i}"]]
    z = [((F.col(f"v{i}") - stats[f"m{i}"]) / stats[f"s{i}"]).alias(f"x{j}") for j, i in enumerate(used)]
    return d.select("g", F.col("v0").alias("y"), *z), [predictors[i - 1] for i in used]


def _minimum(f: Callable[[float], float], lo: float, hi: float) -> float:
    """Golden section after a coarse look."""
    grid = np.linspace(lo, hi, 41)
    k = int(np.argmin([f(x) for x in grid]))
    a, b = grid[max(0, k - 1)], grid[min(40, k + 1)]
    r = (5**0.5 - 1) / 2
    for _ in range(80):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if f(c) < f(d) else (c, b)
    return (a + b) / 2


def random_intercept(df: DataFrame, outcome: str, predictors: Sequence[str], group: str) -> MixedFit | None:
    """outcome ~ 1 + predictors + (1 | group), by maximum likelihood over the ratio of variances. None with fewer than two
    groups or no usable predictor."""
    d, used = prepared(df, outcome, predictors, group)
    if not used:
        return None
    names = ["1", *(f"x{j}" for j in range(len(used))), "y"]
    p = len(names)
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    per = d.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(col(c)).alias(f"t{i}") for i, c in enumerate(names)), *(F.sum(col(names[i]) * col(names[j])).alias(f"q{i}_{j}") for i, j in pairs))
    rows = per.groupBy("n").agg(F.count("*").alias("k"), *(F.sum(f"q{i}_{j}").alias(f"q{i}_{j}") for i, j in pairs), *(F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"o{i}_{j}") for i, j in pairs)).collect()  # a row for each group size
    groups = sum(r.k for r in rows)
    if groups < 2:
        return None
    n = np.array([r.n for r in rows], float)
    k = np.array([r.k for r in rows], float)

    def square(prefix: str) -> np.ndarray:
        m = np.zeros((len(rows), p, p))
        for i, j in pairs:
            m[:, i, j] = m[:, j, i] = [r[f"{prefix}{i}_{j}"] for r in rows]
        return m

    within, outer = square("q").sum(0), square("o")
    total = float((n * k).sum())

    def solve(ratio: float):
        m = within - np.tensordot(ratio / (1 + n * ratio), outer, 1)
        xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        s2 = max((yy - beta @ xy) / total, 1e-300)
        ll = -0.5 * (total * np.log(2 * np.pi * s2) + float((k * np.log1p(n * ratio)).sum()) + total)
        return ll, beta, s2, xx

    best = np.exp(_minimum(lambda u: -solve(np.exp(u))[0], -14.0, 8.0))
    if solve(0.0)[0] >= solve(best)[0]:
        best = 0.0
    ll, beta, s2, xx = solve(best)
    return MixedFit(["Intercept", *used], beta, s2 * np.linalg.pinv(xx), s2, np.array([[best * s2]]), ll, int(total), groups)


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 600, tol: float = 1e-10) -> tuple[np.ndarray, bool]:
    n = len(start)
    points = [start, *(start + 0.5 * np.eye(n)[i] for i in range(n))]
    values = [f(x) for x in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tol * (abs(values[0]) + tol):
            return points[0], True
        centre = np.mean(points[:-1], axis=0)
        away = centre + (centre - points[-1])
        v = f(away)
        if v < values[0]:
            far = centre + 2 * (centre - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (away, v)
        elif v < values[-2]:
            points[-1], values[-1] = away, v
        else:
            near = centre + 0.5 * (points[-1] - centre)
            w = f(near)
            if w < values[-1]:
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *(points[0] + 0.5 * (x - points[0]) for x in points[1:])]
                values = [values[0], *(f(x) for x in points[1:])]
    return points[int(np.argmin(values))], False


def random_slope(df: DataFrame, outcome: str, slope: str, covariates: Sequence[str], group: str) -> MixedFit | None:
    """outcome ~ 1 + slope + covariates + (1 + slope | group), by maximum likelihood over the covariance's factor."""
    d, used = prepared(df, outcome, [slope, *covariates], group)
    if not used or used[0] != slope:
        return None
    names = ["1", *(f"x{j}" for j in range(len(used))), "y"]
    p = len(names)
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rows = d.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(col(names[i]) * col(names[j])).alias(f"q{i}_{j}") for i, j in pairs)).limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    if len(rows) < 2:
        return None
    q = np.zeros((len(rows), p, p))
    for i, j in pairs:
        q[:, i, j] = q[:, j, i] = [r[f"q{i}_{j}"] for r in rows]
    zz, zm, total = q[:, :2, :2], q[:, :2, :], float(sum(r.n for r in rows))

    def solve(u: np.ndarray):
        c = np.array([[np.exp(u[0]), 0.0], [u[1], np.exp(u[2])]])
        dd = c @ c.T  # the random effects' covariance over sigma2
        inner = np.eye(2) + zz @ dd
        m = (q - np.einsum("gia,gij,gjb->gab", zm, dd @ np.linalg.inv(inner), zm)).sum(0)
        xx, xy, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        s2 = max((yy - beta @ xy) / total, 1e-300)
        ll = -0.5 * (total * np.log(2 * np.pi * s2) + np.log(np.maximum(np.linalg.det(inner), 1e-300)).sum() + total)
        return ll, beta, s2, xx, dd

    def cost(u: np.ndarray) -> float:
        return -solve(u)[0] if np.abs(u).max() < 20 else np.inf

    best, ok = min((nelder_mead(cost, np.array(s, float)) for s in ((-1, 0, -1), (-3, 0, -3), (0, 0, -2))), key=lambda r: cost(r[0]))
    ll, beta, s2, xx, dd = solve(best)
    return MixedFit(["Intercept", *used], beta, s2 * np.linalg.pinv(xx), s2, s2 * dd, ll, int(total), len(rows), ok)


def within_between(df: DataFrame, outcome: str, x: str, covariates: Sequence[str], group: str) -> MixedFit | None:
    """A random-intercept model of x's deviation from its group's mean and of that mean, beside the covariates."""
    from dyadflow.operators.rollup import centred

    complete = df.select(group, outcome, x, *covariates).dropna()
    return random_intercept(centred(complete, x, group), outcome, [f"{x}_within", f"{x}_between", *covariates], group)


def model_table(spark, fits: list[tuple[dict, MixedFit | None]]) -> DataFrame:
    """Fixed effects of several models, each row with its model's description (strings)."""
    names = list(dict.fromkeys(k for d, _ in fits for k in d))
    rows = [(*(d.get(n) for n in names), *(r[c.split()[0]] for c in TABLE.split(", "))) for d, f in fits if f is not None for r in f.table()]
    return spark.createDataFrame(rows, ", ".join([*(f"{n} string" for n in names), TABLE]))


def model_grid(df: DataFrame, outcomes: Sequence[str], predictors: Sequence[str], covariates: Sequence[str], group: str, block: str = "") -> DataFrame:
    """Random-intercept models of every outcome on every predictor with the covariates. The models' sums are few and small;
    each is a job of its own over the cached rows."""
    d = df.select(group, *dict.fromkeys([*outcomes, *predictors, *covariates])).persist()
    try:
        return model_table(df.sparkSession, [({"model_block": block, "outcome": o, "predictor": p}, random_intercept(d, o, [p, *covariates], group)) for o in outcomes for p in predictors])
    finally:
        d.unpersist()
