"""Rank and moment tests. Statistics are sums that Spark makes; tail probabilities are taken on the few rows of results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.functions import tails
from dyadflow.session import cut


def average_ranks(df: DataFrame, x: str, out: str = "rank", ties: str = "ties") -> DataFrame:
    """Adds the rank among all rows (equal values share the mean of theirs) and the number of rows with the value.

    Values are counted first, so a hot value is one row; the counts are summed along ranges of values, with the ranges'
    totals (a row a partition) as offsets. No task sees all rows, as it would under a window without a partition."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("__x")).agg(F.count("*").alias(ties))
    counts = cut(counts.repartitionByRange("__x").withColumn("__part", F.spark_partition_id()))
    totals = sorted((r["__part"], r.n) for r in counts.groupBy("__part").agg(F.sum(ties).alias("n")).collect())
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(offsets, "__part int, __before long")
    upto = F.sum(ties).over(Window.partitionBy("__part").orderBy("__x"))
    ranked = counts.join(F.broadcast(offsets), "__part").select("__x", ties, (F.col("__before") + upto - (F.col(ties) - 1) / 2).alias(out))
    return df.join(ranked, df[x] == ranked["__x"]).drop("__x")


def ranks_within(x: str, *by: str) -> Column:
    """The same within groups that fit a task."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def with_tail(df: DataFrame, out: str, tail: Callable[..., float | None], *inputs: str) -> DataFrame:
    """Adds a probability to result rows; null where an input is."""

    def f(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(tail(*row)) for row in zip(*columns, strict=True)], dtype="float64")

    from pyspark.sql.types import DoubleType

    return df.withColumn(out, F.pandas_udf(_named(f, len(inputs)), DoubleType())(*(F.col(c).cast("double") for c in inputs)))


def _named(f, n: int):
    """pandas_udf reads argument counts and hints from the signature."""
    if n == 1:
        def g(a: pd.Series) -> pd.Series:
            return f(a)
    elif n == 2:
        def g(a: pd.Series, b: pd.Series) -> pd.Series:
            return f(a, b)
    else:
        def g(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return f(a, b, c)
    return g


def _ties() -> Column:
    """Of t rows with one value each adds t^2 - 1, so that the value's t^3 - t add up."""
    return F.sum(F.col("ties").cast("double") * F.col("ties") - 1)


def _rank_sums(df: DataFrame, x: str, group: str) -> tuple[DataFrame, int, float]:
    """group, r (the sum of ranks) and k, from one pass over the ranked rows; the number of rows; the sum of t^3 - t over values."""
    ranked = average_ranks(df.where(F.col(group).isNotNull()), x)
    g = cut(ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("k"), _ties().alias("t")))
    total = g.agg(F.sum("k").alias("n"), F.sum("t").alias("t")).first()
    return g.drop("t"), total.n or 0, total.t or 0.0


def kruskal_wallis(df: DataFrame, x: str, group: str) -> DataFrame:
    """h (corrected for ties), p and n_groups; null where all values are equal."""
    g, n, t = _rank_sums(df, x, group)
    correction = 1 - t / (n**3 - n) if n > 1 else 0.0
    h = (F.lit(12.0 / (n * (n + 1)) if n else 0.0) * F.sum(F.col("r") ** 2 / F.col("k")) - 3 * (n + 1)) / F.nullif(F.lit(correction), F.lit(0.0))
    out = g.agg(h.alias("h"), F.count("*").alias("n_groups")).withColumn("df", F.col("n_groups") - 1)
    return with_tail(out, "p", tails.chi2_sf, "h", "df").drop("df")


def dunn(df: DataFrame, x: str, group: str) -> DataFrame:
    """a, b (groups, a before b), z and p (two-sided, times the number of pairs, 1 at most)."""
    g, n, t = _rank_sums(df, x, group)
    g = g.withColumn("m", F.col("r") / F.col("k"))
    a = g.select(F.col(group).alias("a"), F.col("m").alias("ma"), F.col("k").alias("ka"))
    b = g.select(F.col(group).alias("b"), F.col("m").alias("mb"), F.col("k").alias("kb"))
    spread = n * (n + 1) / 12 - t / (12 * (n - 1)) if n > 1 else 0.0
    pairs = a.join(b, F.col("a") < F.col("b"))
    out = pairs.select("a", "b", ((F.col("ma") - F.col("mb")) / F.sqrt(F.nullif(F.lit(spread), F.lit(0.0)) * (1 / F.col("ka") + 1 / F.col("kb")))).alias("z"))
    m = g.count() * (g.count() - 1) // 2
    return with_tail(out, "p", lambda z: min(1.0, 2 * tails.normal_sf(abs(z)) * m), "z")


def mann_whitney(df: DataFrame, x: str, first: Column) -> DataFrame:
    """u of the rows where `first` holds, rank-biserial 1 - 2u / (n1 n2), and p that they are smaller (normal, corrected for
    ties and continuity)."""
    ranked = average_ranks(df.withColumn("__first", first), x)
    sums = (F.sum(F.when(F.col("__first"), F.col("rank"))).alias("r"), F.sum(F.col("__first").cast("long")).alias("n1"), F.sum((~F.col("__first")).cast("long")).alias("n2"))
    g = ranked.agg(*sums, F.count("*").alias("n"), _ties().alias("t")).withColumn("u", F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2)
    pairs, n = F.col("n1") * F.col("n2"), F.col("n")
    spread = F.sqrt(pairs / 12.0 * (n + 1.0 - F.coalesce(F.col("t") / F.nullif(n * (n - 1), F.lit(0)), F.lit(0.0))))
    out = g.select("u", "n1", "n2", (1 - 2 * F.col("u") / F.nullif(pairs, F.lit(0))).alias("rank_biserial"), ((F.col("u") - pairs / 2 + 0.5) / F.nullif(spread, F.lit(0.0))).alias("z"))
    return with_tail(out, "p_less", lambda z: tails.normal_sf(-z), "z").drop("z")


def wilcoxon(df: DataFrame, x: str) -> DataFrame:
    """w (positive ranks; zeros are left out), n and p that values are positive: exact up to 25 without ties, else normal."""
    d = df.where((F.col(x) != 0) & F.col(x).isNotNull()).withColumn("__abs", F.abs(x))
    ranked = average_ranks(d, "__abs")
    out = ranked.agg(F.coalesce(F.sum(F.when(F.col(x) > 0, F.col("rank"))), F.lit(0.0)).alias("w"), F.count("*").alias("n"), F.coalesce(_ties(), F.lit(0.0)).alias("__t"))

    def p(w: float, k: float, t: float) -> float:
        if k <= 25 and not t:
            return tails.signed_rank_sf(w, int(k))
        spread = (k * (k + 1) * (2 * k + 1) / 24 - t / 48) ** 0.5
        return tails.normal_sf((w - k * (k + 1) / 4) / spread) if spread else 1.0

    return with_tail(out, "p_greater", p, "w", "n", "__t").drop("__t")


def sign_test(df: DataFrame, x: str) -> DataFrame:
    """n (values other than 0), n_pos and the binomial p that values are positive."""
    d = df.where((F.col(x) != 0) & F.col(x).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col(x) > 0).cast("long")), F.lit(0)).alias("n_pos"))
    return with_tail(d, "p_greater", lambda k, n: tails.binomial_sf(int(k), int(n)), "n_pos", "n")


def positive_effect(df: DataFrame, x: str) -> DataFrame:
    """N, mean, median, positives and their share, of the finite values."""
    v = F.nullif(F.col(x), F.lit(float("nan")))
    d = df.select(v.alias("v")).where("v is not null")
    return d.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("median"), F.sum((F.col("v") > 0).cast("long")).alias("n_pos"), F.avg((F.col("v") > 0).cast("double")).alias("frac_pos"))


def correlation(x: str, y: str) -> Column:
    """Null where either has no spread."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(correlation(x, y).alias("r"), F.count("*").alias("n"))
    return _correlation_p(d, "r")


def _correlation_p(d: DataFrame, r: str) -> DataFrame:
    t = F.col(r) * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col(r) ** 2, F.lit(0.0)))
    d = d.withColumns({"__t": F.when(F.col("n") > 2, t), "__df": F.col("n") - 2})
    return with_tail(d, "p", tails.t_two_sided, "__t", "__df").drop("__t", "__df")


def spearman(df: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """rho, n and p; null with fewer than `least` rows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = average_ranks(average_ranks(d, x, "__rx", "__tx"), y, "__ry", "__ty")
    out = d.agg(correlation("__rx", "__ry").alias("rho"), F.count("*").alias("n")).withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))
    return _correlation_p(out, "rho")


def anova(df: DataFrame, x: str, group: str) -> DataFrame:
    """F and p from group counts, means and sums of squares."""
    g = df.where(F.col(x).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("k"), F.avg(x).alias("m"), (F.var_pop(x) * F.count("*")).alias("ss"))
    t = g.agg(F.sum("k").alias("n"), F.count("*").alias("g"), (F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("mean"), F.sum("ss").alias("within"), F.sum(F.col("k") * F.col("m") ** 2).alias("raw"))
    t = t.select("n", (F.col("g") - 1).alias("d1"), (F.col("n") - F.col("g")).alias("d2"), (F.col("raw") - F.col("n") * F.col("mean") ** 2).alias("between"), "within")
    t = t.withColumn("f", (F.col("between") / F.nullif(F.col("d1"), F.lit(0))) / F.nullif(F.col("within") / F.nullif(F.col("d2"), F.lit(0)), F.lit(0.0)))
    return with_tail(t.select("f", "d1", "d2"), "p", tails.f_sf, "f", "d1", "d2")


def bh_fdr(df: DataFrame, p: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """Adds q and reject within each family `by` (a family's tests fit a task); null p-values aren't tests."""
    family = Window.partitionBy(*by)
    m, rank = F.count(p).over(family), F.row_number().over(family.orderBy(F.asc_nulls_last(p)))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * m / rank)
    d = df.withColumns({"__raw": raw, "__rank": rank})
    q = F.least(F.lit(1.0), F.min("__raw").over(family.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("q", F.when(F.col(p).isNotNull(), q)).withColumn("reject", F.col("q") <= alpha).drop("__raw", "__rank")


def ols_slopes(df: DataFrame, x: str, y: str, *by: str, least: int = 3) -> DataFrame:
    """by, n, slope and intercept, of groups with enough rows and some spread in both."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), (F.covar_pop(y, x) / F.nullif(F.var_pop(x), F.lit(0.0))).alias("slope"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.stddev_pop(x).alias("__sx"), F.stddev_pop(y).alias("__sy"))
    d = d.where((F.col("n") >= least) & (F.col("__sx") > 0) & (F.col("__sy") > 0))
    return d.withColumn("intercept", F.col("__my") - F.col("slope") * F.col("__mx")).drop("__sx", "__sy", "__mx", "__my")


def slope_summary(slopes: DataFrame) -> DataFrame:
    s = F.col("slope")
    d = slopes.agg(F.count("*").alias("n"), F.avg(s).alias("slope_mean"), F.median(s).alias("slope_median"), F.stddev_pop(s).alias("slope_sd"), F.avg((s > 0).cast("double")).alias("positive_fraction"), F.median(F.abs(s)).alias("abs_median"))
    return d.withColumns({"sym_centered": F.abs("slope_median") < 0.25 * F.greatest("slope_sd", F.lit(1e-12)), "mixed_signs": F.col("positive_fraction").between(0.30, 0.70)})
