"""Grouped folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GROUPS = 1_000_000


def fold_of(group: Column, n_splits: int = 5) -> Column:
    """A group's fold by a hash of its id: no pass over the groups, the same on every engine."""
    return F.pmod(F.conv(F.substring(F.md5(group.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n_splits)).cast("int")


def balanced_folds(sessions: DataFrame, group: str, n_splits: int = 5) -> DataFrame:
    """group, fold: groups from the largest (by sessions) to the smallest, each to the fold with fewest sessions; equal sizes
    in order of the group's id. Greedy, so it runs on the driver over one row a group, MAX_GROUPS at most."""
    sizes = sessions.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: use fold_of()")
    if len(sizes) < n_splits:
        raise ValueError(f"{n_splits} folds need as many groups; there are {len(sizes)}")
    load, out = [0] * n_splits, []
    for r in sizes:
        f = min(range(n_splits), key=lambda k: (load[k], k))
        load[f] += r.n
        out.append((r[group], f))
    return sessions.sparkSession.createDataFrame(out, f"`{group}` {sessions.schema[group].dataType.simpleString()}, fold int")
