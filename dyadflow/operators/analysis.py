"""The session table that models read, the models' blocks, and summaries of their results."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.functions.scalars import number, session_key
from dyadflow.operators import lmm, stats
from dyadflow.operators.rollup import weighted_mean
from dyadflow.session import cut


def numbered(names: Sequence[str], prefix: str) -> list[str]:
    """The names that are the prefix and a number, in order of the number: occ_10 after occ_9."""
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(f"{re.escape(prefix)}([0-9]+)", n))]
    return [n for _, n in sorted(found)]


def once(names: Sequence[str]) -> list[str]:
    """Each name once, in order of its first place."""
    return list(dict.fromkeys(names))


def survey_rows(survey: DataFrame, code: str, measures: Sequence[str], client: str | None = None, therapist: str | None = None, difference: str = "difference") -> DataFrame:
    """session_key and the measures as numbers (null where a cell isn't one) of rows whose session code is one; with the client's
    and the therapist's totals, their difference too."""
    d = survey.withColumn("session_key", session_key(F.col(f"`{code}`"))).where("session_key is not null")
    out = [number(F.col(f"`{m}`")).alias(m) for m in once(measures)]
    if client and therapist:
        out.append((number(F.col(f"`{client}`")) - number(F.col(f"`{therapist}`"))).alias(difference))
    return d.select("session_key", *out)


def session_table(coupling: DataFrame, directionality: DataFrame, decoded: DataFrame, features: DataFrame, survey: DataFrame, key: Column) -> DataFrame:
    """A row for each session of `coupling` with what the other tables have on it, null where they have nothing.

    coupling and directionality meet on fold, session_id and dyad_id; decoded (occ_0, occ_1, ...) on session_id and
    dyad_id, features on session_id, and the survey on `key`, the session's survey code. Gains are named delta_ll, delta_t
    and delta_c, occupancies p_1, p_2, ..., in order of their number."""
    d = coupling.join(directionality, ["fold", "session_id", "dyad_id"], "left")
    d = d.join(decoded, ["session_id", "dyad_id"], "left").join(features, "session_id", "left")
    names = {"delta_ll": F.col("gain_per_trans"), "delta_t": F.col("dT_per_trans"), "delta_c": F.col("dC_per_trans")}
    names |= {f"p_{k}": F.col(c) for k, c in enumerate(numbered(d.columns, "occ_"), 1)}
    return d.withColumns(names).withColumn("session_key", key).join(survey, "session_key", "left")


def model_blocks(outcomes: Mapping[str, Sequence[str]], primary: Sequence[str], exploratory: Sequence[str], covariates: Mapping[str, Sequence[str]]) -> list[dict]:
    """For each kind of outcome (coupling, volatility, occupancy, ...) a primary block, and an exploratory one where there are
    such predictors that aren't primary."""
    out = []
    for kind, names in outcomes.items():
        sets = {"primary": once(primary), "exploratory": [p for p in once(exploratory) if p not in primary]}
        out += [{"block": f"{kind}_{s}", "outcomes": list(names), "predictors": ps, "covariates": list(covariates.get(kind, ()))} for s, ps in sets.items() if ps]
    return out


def run_blocks(df: DataFrame, blocks: Sequence[Mapping], group: str) -> DataFrame:
    """The fixed effects of every block's models. Columns that df lacks are left out. In exploratory blocks q and reject are by
    Benjamini and Hochberg over the predictors' rows of the block; elsewhere they are null."""
    out = None
    for b in blocks:
        there = {k: [c for c in b[k] if c in df.columns] for k in ("outcomes", "predictors", "covariates")}
        if not there["outcomes"] or not there["predictors"]:
            continue
        t = lmm.model_grid(df, there["outcomes"], there["predictors"], there["covariates"], group, b["block"])
        own = F.col("term") == F.col("predictor")
        t = t.withColumn("__p", F.when(own, F.col("p_value")))
        if b["block"].endswith("exploratory"):
            t = stats.bh_fdr(t, "__p", "model_block")
        else:
            t = t.withColumns({"q": F.lit(None).cast("double"), "reject": F.lit(None).cast("boolean")})
        t = t.drop("__p")
        out = t if out is None else out.unionByName(t)
    return out


def coefficient_models(df: DataFrame, targets: Sequence[str], predictors: Sequence[str], group: str) -> DataFrame:
    """Fixed effects of each target on all the predictors at once, with a random intercept."""
    d = df.select(group, *once([*targets, *predictors])).persist()
    try:
        return lmm.model_table(df.sparkSession, [({"coef_target": t}, lmm.random_intercept(d, t, list(predictors), group)) for t in targets])
    finally:
        d.unpersist()


def focus_summary(effects: DataFrame, outcomes: Sequence[str], predictors: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """A row for each outcome and predictor, in their order: the predictor's own effect from the first block by name that has it,
    null where none has, and whether p is below alpha."""
    spark = effects.sparkSession
    grid = spark.createDataFrame([(i, o, p) for i, (o, p) in enumerate((o, p) for o in outcomes for p in predictors)], "place int, outcome string, predictor string")
    columns = ("coef", "se", "p_value", "ci_low", "ci_high", "n_sessions", "n_groups")
    own = effects.where(F.col("term") == F.col("predictor")).groupBy("outcome", "predictor").agg(F.min_by(F.struct(*columns, "model_block"), F.col("model_block")).alias("x"))
    d = grid.join(F.broadcast(own), ["outcome", "predictor"], "left")  # a row for each model
    d = d.select("place", "outcome", "predictor", *(F.col("x")[c].alias(c) for c in (*columns, "model_block")))
    return d.withColumn("significant", F.col("p_value") < alpha)


def asymmetry(df: DataFrame, first: str, second: str) -> DataFrame:
    """Of the differences of two columns: n, mean, median, and the signed-rank tests (w and n_ranked without zeros, p that they
    aren't 0 and that they are positive). No differences give nulls."""
    d = df.select((number(F.col(first)) - number(F.col(second))).alias("x")).where("x is not null")
    d = cut(d)
    moments = d.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"))
    up = stats.wilcoxon(d, "x").select("w", F.col("n").alias("n_ranked"), F.col("p_greater"))
    down = stats.wilcoxon(d.select((-F.col("x")).alias("x")), "x").select(F.col("p_greater").alias("p_less"))
    one = lambda t: t.withColumn("k", F.lit(0))
    both = one(moments).join(one(up), "k").join(one(down), "k")
    return both.select("n", "mean", "median", "w", "n_ranked", "p_greater", F.least(F.lit(1.0), 2 * F.least("p_greater", "p_less")).alias("p_two_sided"))


def by_session(episodes: DataFrame, metrics: Sequence[str], key: str = "session_id", weight: str = "duration") -> DataFrame:
    """Means of the metrics in each session, weighted where there is such a column (null where the weights sum to 0), else plain."""
    mean = (lambda m: weighted_mean(m, weight)) if weight in episodes.columns else F.avg
    return episodes.groupBy(key).agg(*(mean(m).alias(m) for m in metrics))


def merged_classes(regime: Column, classes: Mapping[str, str]) -> Column:
    """A regime's class: what `classes` names it, else itself."""
    pairs = [F.lit(x) for kv in classes.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), regime), regime) if pairs else regime


def class_rollup(episodes: DataFrame, metrics: Sequence[str], group: Sequence[str], weight: str = "duration", session: str = "session_id", dyad: str = "dyad_id") -> DataFrame:
    """Weighted means in two levels, sessions and then dyads, by `group` (a regime's class, k, ...), with the weight's sum, the
    number of sessions and of episodes."""
    one = episodes.groupBy(session, dyad, *group).agg(*(weighted_mean(m, weight).alias(m) for m in metrics), F.sum(weight).alias("__w"), F.count("*").alias("__n"))
    return one.groupBy(dyad, *group).agg(*(weighted_mean(m, "__w").alias(m) for m in metrics), F.sum("__w").alias(f"total_{weight}"), F.count_distinct(session).alias("n_sessions"), F.sum("__n").alias("n_episodes"))


# Frames that plots are drawn from.


def density(df: DataFrame, x: str, points: int = 50, *by: str) -> DataFrame:
    """by, at and density on `points` even places from the least to the largest value: a Gaussian kernel, its width the sample
    deviation times n^(-1/5). Each value adds to each place, so sums combine before they move. Groups of one value, or
    without spread, have no density."""
    v = number(F.col(x))
    d = df.select(*by, v.alias("__v")).where("__v is not null")
    s = d.groupBy(*by).agg(F.count("*").alias("__n"), F.stddev_samp("__v").alias("__s"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).where("__s > 0")
    s = s.withColumn("__h", F.col("__s") * F.pow("__n", F.lit(-0.2)))
    places = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct(k.alias("k"), (F.col("__lo") + k * (F.col("__hi") - F.col("__lo")) / (points - 1)).alias("at")))
    joined = d.join(F.broadcast(s), list(by)) if by else d.withColumn("__k", F.lit(0)).join(F.broadcast(s.withColumn("__k", F.lit(0))), "__k")
    joined = joined.select(*by, "__v", "__n", "__h", F.explode(places).alias("p"))
    kernel = F.exp(-0.5 * F.pow((F.col("p.at") - F.col("__v")) / F.col("__h"), F.lit(2))) / (F.col("__n") * F.col("__h") * F.lit((2 * 3.141592653589793) ** 0.5))
    return joined.groupBy(*by, F.col("p.k").alias("place")).agg(F.first("p.at").alias("at"), F.sum(kernel).alias("density"))


def correlation_matrix(df: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """x, y and r for each of rows against each of columns, of the rows that have both: one pass."""
    pairs = [(a, b) for a in rows for b in columns]
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c))
    one = df.agg(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), (F.covar_pop(a, b) / F.nullif(F.stddev_pop(both(a, b, a)) * F.stddev_pop(both(a, b, b)), F.lit(0.0))).alias("r")) for a, b in pairs)).alias("m"))
    return one.select(F.inline("m"))


def fitted_line(effects: DataFrame, df: DataFrame, x: str, points: int = 20) -> DataFrame:
    """x and y along a model's line from the least to the largest value of x, other predictors at their means: effects(term,
    coef) of z-scored predictors."""
    e = {r.term: r.coef for r in effects.select("term", "coef").collect()}  # a row for each term
    s = df.where(F.col(x).isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / (points - 1)))
    d = s.select("m", "s", at.alias(x))
    return d.select(x, (F.lit(e.get("Intercept", 0.0)) + F.lit(e.get(x, 0.0)) * F.coalesce((F.col(x) - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), F.lit(0.0))).alias("y"))


def coefficient_frame(effects: DataFrame) -> DataFrame:
    """What a coefficient plot shows: all terms but the intercept, with error bars to either side."""
    d = effects.where("term <> 'Intercept'")
    return d.withColumns({"minus": F.col("coef") - F.col("ci_low"), "plus": F.col("ci_high") - F.col("coef")})
