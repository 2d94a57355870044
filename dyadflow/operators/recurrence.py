"""Categorical recurrence: how often a sequence comes back to a symbol, along diagonals and verticals.

A group's sequence is dealt once, as an array; its recurrent pairs are made behind that exchange, a row's at a time, and
line lengths are islands of consecutive positions there. So pairs never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the matrices that short sequences of one length are compared in at once.
CELLS = 1 << 22


def _sequences(steps: DataFrame, by: tuple[str, ...], x: str, at: str) -> DataFrame:
    """by and __xs, each group's symbols in order: they fit a task."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("i"), F.col(x).alias("v"))))
    return steps.groupBy(*by).agg(F.transform(ordered, lambda s: s["v"]).alias("__xs"))


def recurrence(steps: DataFrame, by: tuple[str, ...], x: str = "x", at: str = "at", theiler: int = 1, l_min: int = 2, v_min: int = 2) -> DataFrame:
    """by with n, rr, det and lam, over the symbols in order of `at`. Pairs nearer than or at `theiler` don't count (a negative
    one leaves in even a step with itself). rr: recurrent pairs over eligible ones; det, lam: the share of recurrent points
    on diagonals of l_min or verticals of v_min points. Without eligible or recurrent points they are 0."""
    rows = _sequences(steps, by, x, at)
    xs, i = F.col("__xs"), F.col("__i")
    each = rows.select(*by, "__xs", F.posexplode("__xs").alias("__i", "__x"))
    other = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda j: (xs[j] == F.col("__x")) & (F.abs(i - j) > theiler))
    pairs = each.select(*by, "__i", F.explode(other).alias("__j")).withColumn("__d", F.col("__j") - i)
    for line, name in (("__d", "__diagonal"), ("__j", "__vertical")):
        island = F.col("__i") - F.row_number().over(Window.partitionBy(*by, line).orderBy("__i"))
        pairs = pairs.withColumn("__g", island).withColumn(name, F.count("*").over(Window.partitionBy(*by, line, "__g")))
    found = pairs.groupBy(*by).agg(F.count("*").alias("__rec"), F.sum((F.col("__diagonal") >= l_min).cast("long")).alias("__det"), F.sum((F.col("__vertical") >= v_min).cast("long")).alias("__lam"))
    n = F.col("n")
    m = F.greatest(n - theiler - 1, F.lit(0)) if theiler >= 0 else None
    eligible = m * (m + 1) if theiler >= 0 else n * n
    sizes = rows.select(*by, F.size("__xs").cast("long").alias("n"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return sizes.join(found, list(by), "left").select(*by, "n", share("__rec", eligible).alias("rr"), share("__det", F.col("__rec")).alias("det"), share("__lam", F.col("__rec")).alias("lam"))


def rr_det_lam(x: np.ndarray, theiler: int = 1, l_min: int = 2, v_min: int = 2) -> tuple[float, float, float]:
    """The same of one sequence in numpy, a diagonal or a column at a time: memory grows with its length, not its square."""
    n = len(x)
    recurrent = on_diagonals = on_verticals = 0

    def long_runs(hit: np.ndarray, least: int) -> int:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        sizes = edge[1::2] - edge[::2]
        return int(sizes[sizes >= least].sum())

    for d in range(max(theiler + 1, 0), n):
        hit = x[d:] == x[: n - d]
        twice = 1 if d == 0 else 2
        recurrent += twice * int(hit.sum())
        on_diagonals += twice * long_runs(hit, l_min)
    at = np.arange(n)
    for j in range(n):
        on_verticals += long_runs((x == x[j]) & (np.abs(at - j) > theiler), v_min)
    m = max(n - theiler - 1, 0)
    eligible = m * (m + 1) if theiler >= 0 else n * n
    if not recurrent:
        return 0.0, 0.0, 0.0
    return recurrent / eligible, on_diagonals / recurrent, on_verticals / recurrent


def _in_lines(hit: np.ndarray, least: int, step: tuple[int, int]) -> np.ndarray:
    """Of (sequences, n, n) hits, the number in each that lie on a line of `least` or more along a step: lines of that length
    are found by their first hit, and their hits marked."""

    def shifted(m: np.ndarray, k: int) -> np.ndarray:
        """m at (i + k * step[0], j + k * step[1]), False beyond the matrix."""
        out = np.zeros_like(m)
        di, dj = k * step[0], k * step[1]
        n = m.shape[1]
        if abs(di) < n and abs(dj) < n:
            out[:, max(0, -di) : n - max(0, di), max(0, -dj) : n - max(0, dj)] = m[:, max(0, di) : n + min(0, di), max(0, dj) : n + min(0, dj)]
        return out

    first = hit.copy()
    for k in range(1, least):
        first &= shifted(hit, k)
    on = first.copy()
    for k in range(1, least):
        on |= shifted(first, -k)
    return on.sum((1, 2))


def rr_det_lam_of_many(xs: np.ndarray, theiler: int = 1, l_min: int = 2, v_min: int = 2) -> np.ndarray:
    """rr_det_lam() of each row of xs, all of one length: (rows, 3)."""
    k, n = xs.shape
    out = np.zeros((k, 3))
    at = np.arange(n)
    far = np.abs(at[:, None] - at[None, :]) > theiler
    m = max(n - theiler - 1, 0)
    eligible = m * (m + 1) if theiler >= 0 else n * n
    step = max(1, CELLS // max(1, n * n))
    for a in range(0, k, step):
        x = xs[a : a + step]
        hit = (x[:, :, None] == x[:, None, :]) & far
        recurrent = hit.sum((1, 2))
        some = np.maximum(recurrent, 1)
        det, lam = _in_lines(hit, max(l_min, 1), (1, 1)), _in_lines(hit, max(v_min, 1), (1, 0))
        out[a : a + step] = np.where(recurrent[:, None] > 0, np.stack([recurrent / max(eligible, 1), det / some, lam / some], axis=1), 0.0)
    return out


def recurrence_by_sequence(steps: DataFrame, by: tuple[str, ...], x: str = "x", at: str = "at", **options) -> DataFrame:
    """recurrence() in numpy on each group's own sequence, for long groups and null draws: sequences of one length whose matrices
    are small together, longer ones by rr_det_lam(). A group's sequence must fit a task."""
    kept = _sequences(steps, by, x, at)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seqs = [np.asarray(v) for v in f["__xs"]]
            n = np.array([len(v) for v in seqs])
            got = np.zeros((len(seqs), 3))
            for length in np.unique(n).tolist():
                own = np.flatnonzero(n == length)
                if length * length <= CELLS:
                    got[own] = rr_det_lam_of_many(np.stack([seqs[k] for k in own]), **options)
                else:
                    got[own] = [rr_det_lam(seqs[k], **options) for k in own]
            yield f[list(by)].assign(n=n, rr=got[:, 0], det=got[:, 1], lam=got[:, 2])

    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in by)
    return kept.mapInPandas(each, f"{fields}, n long, rr double, det double, lam double")
