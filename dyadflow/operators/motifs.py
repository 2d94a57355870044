"""Motifs: runs of k joint symbols inside episodes, their distribution and how they follow each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.functions.scalars import N_JOINT, motif_text

METRICS = ("motif_entropy", "effective_motif_count", "top_mass", "repeat_rate", "motif_transition_diversity")


def motif_ids(steps: DataFrame, k: int, by: tuple[str, ...], x: str = "x", at: str = "at", base: int = N_JOINT) -> DataFrame:
    """by, at and motif: the symbols at .. at + k - 1 as digits of one number. The last k - 1 steps begin none."""
    if k < 1 or base**k > 2**62:
        raise ValueError("k must be at least 1, and small enough for a long")
    w = Window.partitionBy(*by).orderBy(at)
    number = sum((F.lead(x, i).over(w).cast("long") * F.lit(base ** (k - 1 - i)) for i in range(k)), F.lit(0).cast("long"))
    return steps.withColumn("motif", number).where(F.col("motif").isNotNull()).select(*by, at, "motif")


def _entropy(n, total):
    """Of the counts in a group, in nats."""
    return F.log(total) - F.sum(n * F.log(n)) / total


def motif_metrics(windows: DataFrame, k: int, by: tuple[str, ...], top_n: int = 5, at: str = "at") -> DataFrame:
    """by with n_windows, n_unique, METRICS, transition_entropy, top_motif, top_motif_prob and top_motifs (JSON).

    Ties among the commonest motifs are broken by the smaller number. Groups without windows have no row. All steps keep
    the rows of a group together, so they share one exchange."""
    group = Window.partitionBy(*by)
    d = windows.withColumn("__next", F.lead("motif").over(group.orderBy(at)))
    singles = d.groupBy(*by, "motif").agg(F.count("*").cast("double").alias("n"))
    ranked = singles.withColumns({"__r": F.row_number().over(group.orderBy(F.desc("n"), "motif")), "__t": F.sum("n").over(group)})
    top = F.col("__r") <= top_n
    p = F.col("n") / F.col("__t")
    entry = F.when(top, F.struct(F.col("__r").alias("r"), F.struct(motif_text(F.col("motif"), k).alias("motif"), p.alias("prob")).alias("v")))
    one = ranked.groupBy(*by).agg(
        F.sum("n").cast("long").alias("n_windows"),
        F.count("*").alias("n_unique"),
        F.greatest(_entropy(F.col("n"), F.sum("n")), F.lit(0.0)).alias("motif_entropy"),
        F.sum(F.when(top, p)).alias("top_mass"),
        F.max(F.when(F.col("__r") == 1, F.col("motif"))).alias("__top"),
        F.max(F.when(F.col("__r") == 1, p)).alias("top_motif_prob"),
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"])).alias("top_motifs"),
    )
    pairs = d.where("__next is not null").groupBy(*by, "motif", "__next").agg(F.count("*").cast("double").alias("n"))
    two = pairs.groupBy(*by).agg(
        (F.sum(F.when(F.col("motif") == F.col("__next"), F.col("n")).otherwise(0.0)) / F.sum("n")).alias("repeat_rate"),
        F.greatest(_entropy(F.col("n"), F.sum("n")), F.lit(0.0)).alias("transition_entropy"),
        F.count("*").alias("__kinds"),
    )
    both = one.join(two, list(by), "left")
    diversity = F.when(F.col("__kinds") > 1, F.col("transition_entropy") / F.log("__kinds")).otherwise(F.lit(0.0))
    return both.withColumns({"effective_motif_count": F.exp("motif_entropy"), "top_motif": motif_text(F.col("__top"), k), "motif_transition_diversity": diversity, "repeat_rate": F.coalesce("repeat_rate", F.lit(0.0)), "transition_entropy": F.coalesce("transition_entropy", F.lit(0.0))}).drop("__top", "__kinds")


#: Rows of up to so many windows are counted for all rows at once, a repetition at a time.
SHORT = 64


def _counts(values: np.ndarray, top_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the sum of n * ln(n) over its values' counts, the number of different values, and the top_n counts' sum."""
    rows, width = values.shape
    s = np.sort(values, axis=1)
    if width <= SHORT:  # from the number of values that come j times or more
        s = np.ascontiguousarray(s.T)
        new = np.ones(s.shape, bool)
        new[1:] = s[1:] != s[:-1]
        kinds = new.view(np.uint8).sum(0, dtype=np.uint8).astype(np.int64)
        logs, top = np.zeros(rows), np.minimum(kinds, top_n)
        for j in range(2, width + 1):
            new = new[: width - j + 1] & (s[j - 1 :] == s[: width - j + 1])
            more = new.view(np.uint8).sum(0, dtype=np.uint8)
            if not more.any():
                break
            logs += more * (j * np.log(j) - (j - 1) * np.log(j - 1))
            top += np.minimum(more, top_n)
        return logs, kinds, top
    new = np.ones(s.shape, bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    starts = np.flatnonzero(new)
    n, row = np.diff(starts, append=s.size), starts // width
    kinds = np.bincount(row, minlength=rows)
    order = np.lexsort((-n, row))
    rank = np.arange(len(n)) - np.repeat(np.cumsum(kinds) - kinds, kinds)
    top = np.add.reduceat(np.where(rank < top_n, n[order], 0), np.cumsum(kinds) - kinds)
    return np.bincount(row, n * np.log(n), rows), kinds, top


def metrics_of_many(xs: np.ndarray, k: int, missing: np.ndarray | None = None, top_n: int = 5, base: int = N_JOINT) -> np.ndarray:
    """METRICS of each row of symbols, all of one length: (rows, 5), as motif_metrics() of motif_ids() has them. Windows with a
    missing symbol don't count; a row without windows is NaN."""
    if k < 1 or base**k > 2**62:
        raise ValueError("k must be at least 1, and small enough for a long")
    rows, width = xs.shape[0], max(xs.shape[1] - k + 1, 0)
    ids = sum((xs[:, i : i + width].astype(np.int64) * base ** (k - 1 - i) for i in range(k)), np.zeros((rows, width), np.int64))
    out = np.full((rows, len(METRICS)), np.nan)
    if missing is None or not missing.any():
        parts = [(slice(None), ids)]
    else:
        there = ~np.logical_or.reduce([missing[:, i : i + width] for i in range(k)])
        each = there.sum(1)
        parts = [(own, ids[own][there[own]].reshape(len(own), n)) for n in np.unique(each).tolist() if len(own := np.flatnonzero(each == n))]
    for own, m in parts:
        n = m.shape[1]
        if not m.size:
            continue
        if m.min() < 0 or m.max() >= 2**15:  # numbers by rank: only which are equal matters
            m = np.unique(m, return_inverse=True)[1].reshape(m.shape)
        span = int(m.max()) + 1
        small = lambda top: np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
        logs, _, top = _counts(m.astype(small(span)), top_n)
        entropy = np.maximum(np.log(n) - logs / n, 0.0)
        repeats, diversity = np.zeros(len(m)), np.zeros(len(m))
        if n > 1:
            a, b = m[:, :-1], m[:, 1:]
            repeats = (a == b).sum(1) / (n - 1)
            logs, kinds, _ = _counts((a.astype(small(span * span)) * span + b).astype(small(span * span)), top_n)
            diversity = np.where(kinds > 1, np.maximum(np.log(n - 1) - logs / (n - 1), 0.0) / np.log(np.maximum(kinds, 2)), 0.0)
        out[own] = np.stack([entropy, np.exp(entropy), top / n, repeats, diversity], axis=1)
    return out
