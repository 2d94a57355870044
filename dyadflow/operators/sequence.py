"""Sequence operators over long tables of steps(session, pos, values): runs, debouncing, windows, episodes, transitions.

Every operator deals rows by session once and orders by position, so that a chain of them shares one exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION, POS = "session_id", "pos"


def positioned(df: DataFrame, *order: str, session: str = SESSION) -> DataFrame:
    """Adds pos, from 0, in each session."""
    return df.withColumn(POS, (F.row_number().over(Window.partitionBy(session).orderBy(*order)) - 1).cast("long"))


def _ordered(by: tuple[str, ...]):
    return Window.partitionBy(*by).orderBy(POS)


def with_runs(steps: DataFrame, value: str, by: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """Adds run: the number, from 0, of the stretch of equal values that the step lies in."""
    w = _ordered(by)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("long"), F.lit(0))
    first = F.row_number().over(w) == 1
    return steps.withColumn("__new", F.when(first, F.lit(0)).otherwise(new)).withColumn("run", F.sum("__new").over(w)).drop("__new")


def runs(steps: DataFrame, value: str, by: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """Run-length encoding: by, run, value, start, end (half-open) and length."""
    return with_runs(steps, value, by).groupBy(*by, "run", value).agg(F.min(POS).alias("start"), (F.max(POS) + 1).alias("end"), F.count("*").alias("length"))


def debounced(steps: DataFrame, value: str, k: int, by: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """Replaces runs of k steps or fewer: by the value on both sides if that is one, else by the longer neighbour's (the left
    one's if both are as long), at an edge by the only neighbour's. All runs are judged by the given sequence; a
    session of one run, and k <= 0, change nothing."""
    if k <= 0:
        return steps
    w, r = _ordered(by), Window.partitionBy(*by, "run")
    d = with_runs(steps, value, by).withColumns({"__len": F.count("*").over(r), "__before": F.lag(value).over(w), "__after": F.lead(value).over(w)})
    d = d.withColumns({"__blen": F.lag("__len").over(w), "__alen": F.lead("__len").over(w)})
    first, last = F.col(POS) == F.min(POS).over(r), F.col(POS) == F.max(POS).over(r)
    pick = lambda c, edge: F.max(F.when(edge, F.col(c))).over(r)
    d = d.withColumns({"__lv": pick("__before", first), "__ll": pick("__blen", first), "__rv": pick("__after", last), "__rl": pick("__alen", last)})
    new = F.when(F.col("__lv").isNull(), F.col("__rv")).when(F.col("__rv").isNull() | (F.col("__ll") >= F.col("__rl")), F.col("__lv")).otherwise(F.col("__rv"))
    return d.withColumn(value, F.when((F.col("__len") <= k) & new.isNotNull(), new).otherwise(F.col(value))).select(*steps.columns)


def windowed(steps: DataFrame, win: Column | int, step: Column | int, by: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """Each step once for each full window that it lies in, with window (from 0), w_start and w_end. Windows that don't fit
    are left out; a session shorter than a window is one window. A step's windows follow from its position: no join."""
    if isinstance(win, int) and win <= 0 or isinstance(step, int) and step <= 0:
        raise ValueError("win and step must be positive")
    win = (F.lit(win) if isinstance(win, int) else win).cast("long")
    step = (F.lit(step) if isinstance(step, int) else step).cast("long")
    d = steps.withColumns({"__n": F.count("*").over(Window.partitionBy(*by)), "__win": win, "__step": step})
    d = d.withColumn("__win", F.least("__win", "__n")).withColumn("__last", F.floor((F.col("__n") - F.col("__win")) / F.col("__step")))
    lo = F.greatest(F.ceil((F.col(POS) - F.col("__win") + 1) / F.col("__step")), F.lit(0))
    hi = F.least(F.floor(F.col(POS) / F.col("__step")), F.col("__last"))
    d = d.where(lo <= hi).withColumn("window", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    d = d.withColumn("w_start", F.col("window") * F.col("__step"))
    return d.withColumn("w_end", F.col("w_start") + F.col("__win")).drop("__n", "__win", "__step", "__last")


def episodes(regimes: DataFrame, min_len: int, regime: str = "regime", by: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """Stretches of one regime of at least min_len steps: by, regime, start, end (half-open), duration."""
    found = runs(regimes, regime, by).where(F.col("length") >= min_len)
    return found.select(*by, regime, "start", "end", F.col("length").alias("duration"))


def in_episodes(steps: DataFrame, min_len: int, regime: str = "regime", by: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """The steps inside episodes, with start, end, duration and at (the position within the episode). One exchange."""
    r = Window.partitionBy(*by, "run")
    d = with_runs(steps, regime, by).withColumns({"start": F.min(POS).over(r), "duration": F.count("*").over(r)})
    d = d.where(F.col("duration") >= min_len)
    return d.withColumns({"end": F.col("start") + F.col("duration"), "at": F.col(POS) - F.col("start")}).drop("run")


def transitions(steps: DataFrame, *values: str, by: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """Steps but each session's first, with <value>_prev for each value."""
    w = _ordered(by)
    d = steps.withColumns({f"{v}_prev": F.lag(v).over(w) for v in values} | {"__k": F.row_number().over(w)})
    return d.where("__k > 1").drop("__k")


def switching(steps: DataFrame, value: str, by: tuple[str, ...] = (SESSION,), alone: float | None = 0.0) -> DataFrame:
    """by, n, switching_rate: changes over length - 1; `alone` for a session of one step."""
    changed = (F.col(value) != F.col(f"{value}_prev")).cast("double")
    w = _ordered(by)
    d = steps.withColumn(f"{value}_prev", F.lag(value).over(w))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg(changed), F.lit(alone).cast("double")).alias("switching_rate"))


def dwell(steps: DataFrame, value: str, by: tuple[str, ...] = (SESSION,)) -> DataFrame:
    """by, n_runs, mean_dwell and cv_dwell (population deviation over mean) over all runs, those at the edges too."""
    return runs(steps, value, by).groupBy(*by).agg(F.count("*").alias("n_runs"), F.avg("length").alias("mean_dwell"), (F.stddev_pop("length") / F.avg("length")).alias("cv_dwell"))


def sampling_interval(steps: DataFrame, t: str, by: tuple[str, ...] = (SESSION,), default: float = 1.0) -> DataFrame:
    """by, dt: the median difference of t, `default` where that is missing or not positive."""
    d = steps.withColumn("__d", F.col(t) - F.lag(t).over(_ordered(by)))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.median("__d").alias("__m")).withColumn("dt", F.when(F.col("__m") > 0, F.col("__m")).otherwise(F.lit(default))).drop("__m")


def window_sizes(intervals: DataFrame, seconds: float, overlap: float) -> DataFrame:
    """Adds win and step in steps: halves round to even; a step is 1 at least."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must lie in [0, 1)")
    d = intervals.withColumn("win", F.bround(F.lit(float(seconds)) / F.col("dt"), 0).cast("long"))
    return d.withColumn("step", F.greatest(F.bround(F.col("win") * F.lit(1.0 - overlap), 0).cast("long"), F.lit(1).cast("long")))
