"""Weighted aggregation, session features and the shapes of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.operators.sequence import runs, transitions
from dyadflow.session import cut


def weighted_mean(value: Column | str, weight: Column | str, missing: str = "skip", no_weight: str = "null") -> Column:
    """sum(v * w) / sum(w) by a policy. missing: `skip` leaves rows with a null value or weight out, `keep_weight` leaves them
    out of the numerator only, `spread` makes the result null. no_weight: `null` or `zero`, where the weights sum to 0."""
    v, w = (F.col(x) if isinstance(x, str) else x for x in (value, weight))
    gone = v.isNull() | w.isNull()
    total = F.sum(F.when(~gone, w)) if missing == "skip" else F.sum(w)
    out = F.sum(v * w) / F.nullif(total, F.lit(0))
    if missing == "spread":
        out = F.when(F.max(gone.cast("int")) == 0, out)
    return F.when(total == 0, F.lit(0.0)).otherwise(out) if no_weight == "zero" else out


def rolled_up(df: DataFrame, metrics: Sequence[str], weight: str, lower: Sequence[str], upper: Sequence[str]) -> DataFrame:
    """Weighted means in two levels: within `lower`, then of those within `upper`, by the summed weight of each. Also the
    summed weight and how many groups and rows there were."""
    one = df.groupBy(*lower).agg(*(weighted_mean(m, weight).alias(m) for m in metrics), F.sum(weight).alias("__w"), F.count("*").alias("__rows"))
    two = one.groupBy(*upper).agg(*(weighted_mean(m, "__w").alias(m) for m in metrics), F.sum("__w").alias(f"total_{weight}"), F.count("*").alias("n_groups"), F.sum("__rows").alias("n_rows"))
    return two


def without_outliers(df: DataFrame, columns: Sequence[str], most: float) -> DataFrame:
    """Rows with no value beyond `most` either way; null and NaN aren't beyond it."""
    far = [F.coalesce(F.abs(F.nullif(F.col(c), F.lit(float("nan")))) > most, F.lit(False)) for c in columns]
    keep = F.lit(True)
    for f in far:
        keep = keep & ~f
    return df.where(keep)


def trimmed(df: DataFrame, columns: Sequence[str], low: float, high: float) -> DataFrame:
    """Rows within the exact quantiles low..high of every column (interpolated)."""
    for c in columns:
        q = {r.p: r.value for r in quantiles(df, c, (low, high)).collect()}  # two rows
        if q:
            df = df.where(F.col(c).between(q[low], q[high]))
    return df


def standardised(df: DataFrame, zs: Sequence[str] = (), scales: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """df with {c}_z, against the population deviation of all rows (null where that is 0), and {c}_scaled: low + span * the value
    scaled to 0..1 (low where all are equal). The moments are one row, which is joined to all."""
    scales = scales or {}
    moments = [f(c).alias(f"__{k}_{c}") for c in zs for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    moments += [f(c).alias(f"__{k}_{c}") for c in scales for k, f in (("lo", F.min), ("hi", F.max))]
    one = df.agg(*moments).withColumn("__one", F.lit(0))
    d = df.withColumn("__one", F.lit(0)).join(F.broadcast(one), "__one")
    d = d.withColumns({f"{c}_z": (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)) for c in zs})
    part = lambda c: F.coalesce((F.col(c) - F.col(f"__lo_{c}")) / F.nullif((F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).cast("double"), F.lit(0.0)), F.lit(0.0))
    d = d.withColumns({f"{c}_scaled": F.lit(low) + F.lit(span) * part(c) for c, (low, span) in scales.items()})
    return d.select(*df.columns, *(f"{c}_z" for c in zs), *(f"{c}_scaled" for c in scales))


#: Groups up to so many have their quantiles by ranges of values; more groups are small enough for one task each.
FEW_GROUPS = 1000


def quantiles(df: DataFrame, x: str, ps: Sequence[float], *by: str) -> DataFrame:
    """by, p and value: exact quantiles of the values that aren't null, interpolated between neighbours.

    Values are counted and dealt by ranges; a group's rows before each range (a row a range and group) are offsets. So
    no task holds a group's values, as it would for percentile(); that is used beyond FEW_GROUPS groups."""
    d = df.where(F.col(x).isNotNull()).select(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), F.col(x).cast("double").alias("__v"))
    keys = [f"__g{i}" for i in range(len(by))]
    named = [F.col(f"__g{i}").alias(c) for i, c in enumerate(by)]
    if keys and d.select(*keys).distinct().limit(FEW_GROUPS + 1).count() > FEW_GROUPS:
        q = d.groupBy(*keys).agg(F.percentile("__v", list(ps)).alias("q"))
        return q.select(*named, F.explode(F.arrays_zip(F.array(*(F.lit(float(p)) for p in ps)).alias("p"), F.col("q").alias("value"))).alias("z")).select(*by, "z.p", "z.value")
    counts = d.groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    counts = cut(counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()))
    totals = counts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__n"))  # a row for each range, and one more for each group
    each = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = totals.withColumns({"__before": F.sum("__n").over(each.orderBy("__part")) - F.col("__n"), "__all": F.sum("__n").over(each)}).drop("__n")
    upto = F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v"))
    places = counts.withColumn("__upto", upto).join(F.broadcast(offsets), [*keys, "__part"]).withColumn("__upto", F.col("__upto") + F.col("__before"))
    asked = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), (F.lit(float(p)) * (F.col("__all") - 1)).alias("at")) for p in ps)))
    rows = places.select(*keys, "__v", "__n", "__upto", asked.alias("a"))
    here = lambda k: (F.col("__upto") - F.col("__n") <= k) & (k < F.col("__upto"))
    lo, hi = F.floor("a.at"), F.ceil("a.at")
    found = rows.where(here(lo) | here(hi)).groupBy(*keys, "a.p").agg(F.first("a.at").alias("__at"), F.max(F.when(here(lo), F.col("__v"))).alias("__l"), F.max(F.when(here(hi), F.col("__v"))).alias("__h"))
    return found.select(*named, "p", (F.col("__l") + (F.col("__at") - F.floor("__at")) * (F.col("__h") - F.col("__l"))).alias("value"))


def centred(df: DataFrame, x: str, by: str) -> DataFrame:
    """Adds {x}_mean (of the group), {x}_within and {x}_between."""
    m = F.avg(x).over(Window.partitionBy(by))
    return df.withColumns({f"{x}_mean": m, f"{x}_within": F.col(x) - m, f"{x}_between": m})


def occupancy(steps: DataFrame, state: str, n_states: int, by: tuple[str, ...]) -> DataFrame:
    """by, length and occ_0 .. occ_{n-1}: the share of steps in each state."""
    shares = [F.avg((F.col(state) == k).cast("double")).alias(f"occ_{k}") for k in range(n_states)]
    return steps.groupBy(*by).agg(F.count("*").alias("length"), *shares)


def entropy2(*p: Column) -> Column:
    """In bits; terms of 0 are 0."""
    return F.greatest(-sum((F.when(x > 0, x * F.log2(x)).otherwise(0.0) for x in p), F.lit(0.0)), F.lit(0.0))


def session_features(steps: DataFrame, state: str, n_states: int, by: tuple[str, ...] = ("session_id",), alone: float | None = 0.0) -> DataFrame:
    """Length, occupancies and their entropy, switching rate, mean and variation of dwell, and the entropy of transitions
    (bits, rows weighed by occupancy). `alone` is the switching rate of a session of one step. One exchange by session."""
    occ = occupancy(steps, state, n_states, by)
    occ = occ.withColumn("occ_entropy", entropy2(*(F.col(f"occ_{k}") for k in range(n_states))))
    moves = transitions(steps, state, by=by).groupBy(*by, f"{state}_prev", state).agg(F.count("*").alias("n"))
    rows = moves.groupBy(*by, f"{state}_prev").agg(F.sum("n").alias("r"), F.greatest(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), F.lit(0.0)).alias("h"), F.sum(F.when(F.col(state) != F.col(f"{state}_prev"), F.col("n")).otherwise(0)).alias("away"))
    joined = rows.join(occ.select(*by, F.array(*(F.col(f"occ_{k}") for k in range(n_states))).alias("__o")), list(by))
    trans = joined.groupBy(*by).agg(F.sum(F.col("__o")[F.col(f"{state}_prev")] * F.col("h")).alias("trans_entropy"), (F.sum("away") / F.sum("r")).alias("switching_rate"))
    dwell = runs(steps, state, by).groupBy(*by).agg(F.avg("length").alias("mean_dwell"), (F.stddev_pop("length") / F.avg("length")).alias("cv_dwell"))
    out = occ.join(trans, list(by), "left").join(dwell, list(by), "left")
    return out.withColumns({"switching_rate": F.coalesce("switching_rate", F.lit(alone).cast("double")), "trans_entropy": F.coalesce("trans_entropy", F.lit(0.0))})


def regime_dynamics(matrix: DataFrame) -> DataFrame:
    """From matrix(i, j, p): self-transition, expected dwell 1 / (1 - p) (null where p is 1), exit entropy in bits after the
    self-transition is left out, and the three likeliest exits."""
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("p")))
    exits = matrix.where("i <> j").withColumn("q", F.col("p") / F.nullif(F.sum("p").over(Window.partitionBy("i")), F.lit(0.0)))
    exits = exits.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("p"), "j")))
    h = exits.groupBy("i").agg(F.sum(F.when(F.col("q") > 0, -F.col("q") * F.log2("q")).otherwise(0.0)).alias("exit_entropy"), *(F.max(F.when((F.col("r") == k) & (F.col("p") > 0), F.col("j"))).alias(f"exit_{k}") for k in (1, 2, 3)))
    return matrix.groupBy("i").agg(own.alias("self_transition")).withColumn("expected_dwell", 1 / F.nullif(1 - F.col("self_transition"), F.lit(0.0))).join(h, "i", "left")


def survival(dynamics: DataFrame, steps: int = 20) -> DataFrame:
    """i, t and the probability of still being there: p^(t - 1) for t = 1 .. steps."""
    d = dynamics.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return d.select("i", "t", F.pow("self_transition", F.col("t") - 1).alias("survival"))


def matrix_power(matrix: DataFrame, k: int) -> DataFrame:
    """matrix(i, j, p) to the power k, by repeated joins on the inner index; halving keeps them to log2(k)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    times = lambda a, b: a.select("i", F.col("j").alias("m"), F.col("p").alias("p1")).join(b.select(F.col("i").alias("m"), "j", F.col("p").alias("p2")), "m").groupBy("i", "j").agg(F.sum(F.col("p1") * F.col("p2")).alias("p"))
    out = None
    while k:
        if k & 1:
            out = matrix if out is None else times(out, matrix)
        k >>= 1
        if k:
            matrix = times(matrix, matrix)
    return out


def completed(df: DataFrame, axes: dict[str, Sequence], fill: dict | None = None) -> DataFrame:
    """A row for every combination of the axes' values (literals, so the grid is small), from df where it has one."""
    grid = df.sparkSession.range(1).drop("id")
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    out = grid.join(df, list(axes), "left")
    return out.fillna(fill) if fill else out


def first_of(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each group in the given order: a defined `drop duplicates, keep first`."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """bin, low, high, n over equal bins from the least to the largest finite value; the largest lies in the last bin."""
    v = F.col(x).cast("double")
    d = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(v.alias("v"))
    edge = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if edge.lo is None:
        return d.select(F.lit(0).alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n")).limit(0)
    lo, width = edge.lo, (edge.hi - edge.lo) / bins or 1.0
    k = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = d.groupBy(k.alias("bin")).agg(F.count("*").alias("n"))
    return completed(counts, {"bin": range(bins)}, {"n": 0}).select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), "n")


def box_stats(df: DataFrame, x: str, *by: str) -> DataFrame:
    """by with n, q1, median, q3 and the whiskers: the outermost values within 1.5 interquartile ranges of the box."""
    at = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = quantiles(df, x, tuple(at.values()), *by).groupBy(*by).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(k) for k, p in at.items()))
    q = df.groupBy(*by).agg(F.count(x).alias("n")).join(q, list(by)) if by else q.withColumn("n", F.lit(df.where(F.col(x).isNotNull()).count()))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = df.join(q, list(by)) if by else df.withColumn("__one", F.lit(0)).join(F.broadcast(q.withColumn("__one", F.lit(0))), "__one")
    inside = joined.where(F.col(x).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*by, "n", "q1", "median", "q3").agg(F.min(x).alias("whisker_low"), F.max(x).alias("whisker_high"))
