"""Features, roll-ups, joins, sets and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dyadflow.functions.scalars import rounded, unlike, valence_label
from dyadflow.operators import recurrence, rollup
from dyadflow.plans.patterns import EP, _rqa, episode_steps
from dyadflow.plans.registry import query
from dyadflow.plans.steps import EPISODES, STEPS, r6, runs_sql, steps
from dyadflow.session import cut, table


def rounding(d: DataFrame) -> DataFrame:
    return d.select(*(rounded(F.col(c)).alias(c) if t == "double" else c for c, t in d.dtypes))


FEATURES = f"""{STEPS}, {runs_sql("th")},
occ AS (SELECT session_id, any_value(dyad_id) AS dyad_id, count(*) AS length, avg(CAST(th = 0 AS DOUBLE)) AS occ_0, avg(CAST(th = 1 AS DOUBLE)) AS occ_1, avg(CAST(th = 2 AS DOUBLE)) AS occ_2 FROM steps GROUP BY session_id),
mv AS (SELECT session_id, tp, th, count(*) AS n FROM (SELECT session_id, th, lag(th) OVER (PARTITION BY session_id ORDER BY pos) AS tp FROM steps) WHERE tp IS NOT NULL GROUP BY ALL),
rw AS (SELECT session_id, tp, sum(n) AS r, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS h, coalesce(sum(n) FILTER (WHERE th <> tp), 0) AS away FROM mv GROUP BY ALL),
te AS (SELECT session_id, sum(CASE tp WHEN 0 THEN occ_0 WHEN 1 THEN occ_1 ELSE occ_2 END * h) AS trans_entropy, sum(away) / sum(r) AS switching_rate FROM rw JOIN occ USING (session_id) GROUP BY session_id),
dw AS (SELECT session_id, avg(n) AS mean_dwell, stddev_pop(n) / avg(n) AS cv_dwell FROM runs GROUP BY session_id),
ft AS (SELECT occ.*, greatest(-({" + ".join(f"CASE WHEN occ_{k} > 0 THEN occ_{k} * log2(occ_{k}) ELSE 0 END" for k in range(3))}), 0) AS occ_entropy, coalesce(trans_entropy, 0) AS trans_entropy, coalesce(switching_rate, 0) AS switching_rate, mean_dwell, cv_dwell FROM occ LEFT JOIN te USING (session_id) JOIN dw USING (session_id))"""
_F = ("occ_0", "occ_1", "occ_2", "occ_entropy", "trans_entropy", "switching_rate", "mean_dwell", "cv_dwell")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.session_features(steps(spark, sf_dir), "th", 3, ("session_id", "dyad_id"))


@query(f"WITH {FEATURES} SELECT session_id, dyad_id, length, {', '.join(f'{r6(c)} AS {c}' for c in _F)} FROM ft")
def session_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(features(spark, sf_dir))


@query(f"WITH {FEATURES} SELECT session_id, {', '.join(f'{r6(f'({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0)')} AS {c}' for c in ('occ_entropy', 'mean_dwell'))}, {r6('80 + 320 * (length - min(length) OVER ()) / nullif(max(length) OVER () - min(length) OVER (), 0)')} AS marker FROM ft")
def standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rollup.standardised(features(spark, sf_dir), ("occ_entropy", "mean_dwell"), {"length": (80.0, 320.0)})
    return rounding(d.select("session_id", F.col("occ_entropy_z").alias("occ_entropy"), F.col("mean_dwell_z").alias("mean_dwell"), F.col("length_scaled").alias("marker")))


@query(f"""WITH {FEATURES} SELECT session_id, dyad_id, {r6("avg(occ_entropy) OVER w")} AS occ_entropy_mean, {r6("occ_entropy - avg(occ_entropy) OVER w")} AS occ_entropy_within FROM ft WINDOW w AS (PARTITION BY dyad_id)""")
def within_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rollup.centred(features(spark, sf_dir), "occ_entropy", "dyad_id")
    return rounding(d.select("session_id", "dyad_id", "occ_entropy_mean", "occ_entropy_within"))


@query(f"""WITH {EPISODES}, {_rqa("episode")}, e AS (SELECT * FROM rqa JOIN ep USING (episode)),
s AS (SELECT session_id, dyad_id, regime, {", ".join(f"sum({m} * duration) / sum(duration) AS {m}" for m in ("rr", "det", "lam"))}, sum(duration) AS w, count(*) AS k FROM e GROUP BY ALL)
SELECT dyad_id, cast(regime AS INT) AS regime, {", ".join(f"{r6(f'sum({m} * w) / sum(w)')} AS {m}" for m in ("rr", "det", "lam"))}, cast(sum(w) AS BIGINT) AS total_duration, count(*) AS n_groups, cast(sum(k) AS BIGINT) AS n_rows FROM s GROUP BY ALL""")
def weighted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = episode_steps(spark, sf_dir)
    ep = d.select("episode", "session_id", "dyad_id", "regime", "duration").distinct()
    e = recurrence.recurrence(d, EP).join(ep, "episode")
    return rounding(rollup.rolled_up(e, ("rr", "det", "lam"), "duration", ("session_id", "dyad_id", "regime"), ("dyad_id", "regime")))


_V, _W = "nullif(l_discount, 0)", "(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_quantity END)"


@query(f"""WITH d AS (SELECT l_suppkey, {_V} AS v, {_W} AS w FROM lineitem)
SELECT l_suppkey, {r6("sum(v * w) / nullif(sum(w) FILTER (WHERE v IS NOT NULL), 0)")} AS skip_null, {r6("CASE WHEN sum(w) = 0 THEN 0 ELSE sum(v * w) / nullif(sum(w), 0) END")} AS keep_zero,
{r6("sum(v * w) / nullif(sum(w), 0)")} AS keep_null, {r6("CASE WHEN count(*) = count(v) THEN sum(v * w) / nullif(sum(w), 0) END")} AS spread FROM d GROUP BY l_suppkey""")
def weighted_mean_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("v"), F.when(F.col("l_suppkey") % 5 == 0, 0.0).otherwise(F.col("l_quantity")).alias("w"))
    m = rollup.weighted_mean
    return rounding(d.groupBy("l_suppkey").agg(m("v", "w").alias("skip_null"), m("v", "w", "keep_weight", "zero").alias("keep_zero"), m("v", "w", "keep_weight").alias("keep_null"), m("v", "w", "spread").alias("spread")))


@query(f"""WITH d AS (SELECT *, CASE WHEN l_orderkey % 97 = 0 THEN 'NaN'::DOUBLE ELSE (l_extendedprice - 25000) / 1000 END AS z FROM lineitem)
SELECT l_returnflag, count(*) AS n, {r6("avg(CASE WHEN NOT isnan(z) THEN z END)")} AS mean FROM d WHERE NOT (NOT isnan(z) AND abs(z) > 20) GROUP BY l_returnflag""")
def outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.when(F.col("l_orderkey") % 97 == 0, float("nan")).otherwise((F.col("l_extendedprice") - 25000) / 1000)
    d = rollup.without_outliers(table(spark, sf_dir, "lineitem").withColumn("z", z), ["z"], 20)
    return rounding(d.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg(F.nullif(F.col("z"), F.lit(float("nan")))).alias("mean")))


@query(f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders)
SELECT o_orderstatus, count(*) AS n, {r6("min(o_totalprice)")} AS least, {r6("max(o_totalprice)")} AS most FROM orders, q WHERE o_totalprice BETWEEN lo AND hi GROUP BY o_orderstatus""")
def quantile_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rollup.trimmed(table(spark, sf_dir, "orders"), ["o_totalprice"], 0.01, 0.99)
    return rounding(d.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most")))


_TRANS = f"""{STEPS}, mc AS (SELECT tp AS i, th AS j, count(*) AS n FROM (SELECT th, lag(th) OVER (PARTITION BY session_id ORDER BY pos) AS tp FROM steps) WHERE tp IS NOT NULL GROUP BY tp, th),
mt AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p FROM mc)"""


def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dyadflow.operators.sequence import transitions

    n = transitions(steps(spark, sf_dir), "th").groupBy(F.col("th_prev").alias("i"), F.col("th").alias("j")).agg(F.count("*").alias("n"))
    return n.select("i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy("i"))).alias("p"))


@query(f"""WITH {_TRANS}, o AS (SELECT i, max(p) FILTER (WHERE i = j) AS s FROM mt GROUP BY i),
x AS (SELECT i, j, p, p / nullif(sum(p) OVER (PARTITION BY i), 0) AS q, row_number() OVER (PARTITION BY i ORDER BY p DESC, j) AS r FROM mt WHERE i <> j),
h AS (SELECT i, sum(CASE WHEN q > 0 THEN -q * log2(q) ELSE 0 END) AS e, {", ".join(f"max(j) FILTER (WHERE r = {k} AND p > 0) AS x{k}" for k in (1, 2, 3))} FROM x GROUP BY i)
SELECT o.i, {r6("s")} AS self_transition, {r6("1 / nullif(1 - s, 0)")} AS expected_dwell, {r6("e")} AS exit_entropy, x1 AS exit_1, x2 AS exit_2, x3 AS exit_3 FROM o LEFT JOIN h USING (i)""")
def regime_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(rollup.regime_dynamics(transition_matrix(spark, sf_dir)))


@query(f"WITH {_TRANS} SELECT i, cast(t AS INT) AS t, {r6('pow(p, t - 1)')} AS survival FROM mt, unnest(range(1, 21)) AS u(t) WHERE i = j")
def survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(rollup.survival(rollup.regime_dynamics(transition_matrix(spark, sf_dir))))


@query(f"""WITH {_TRANS}, p2 AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM mt AS a JOIN mt AS b ON a.j = b.i GROUP BY ALL),
p4 AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM p2 AS a JOIN p2 AS b ON a.j = b.i GROUP BY ALL), p5 AS (SELECT a.i, b.j, sum(a.p * b.p) AS p FROM p4 AS a JOIN mt AS b ON a.j = b.i GROUP BY ALL)
SELECT i, j, {r6("p")} AS p FROM p5""")
def transition_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(rollup.matrix_power(transition_matrix(spark, sf_dir), 5))


#: Sessions of one pair in dyad_pairs_distance: a pair has few, however many pairs there are.
_PAIR_SESSIONS = 8


@query(f"""WITH {FEATURES.replace("ft AS (SELECT occ.*", f"ft AS (SELECT occ.* REPLACE (session_id // {_PAIR_SESSIONS} AS dyad_id)")}, k AS (SELECT dyad_id FROM ft GROUP BY dyad_id HAVING count(*) >= 2), n AS (SELECT ft.*, row_number() OVER (PARTITION BY dyad_id ORDER BY session_id) AS r FROM ft JOIN k USING (dyad_id))
SELECT a.dyad_id, a.session_id AS a, b.session_id AS b, {r6("sqrt(pow(a.occ_entropy - b.occ_entropy, 2) + pow(a.mean_dwell - b.mean_dwell, 2))")} AS distance FROM n AS a JOIN n AS b ON a.dyad_id = b.dyad_id AND a.r < b.r""")
def dyad_pairs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a pair's sessions: what is asked for, over the few sessions that one has."""
    d = features(spark, sf_dir).withColumn("dyad_id", F.floor(F.col("session_id") / _PAIR_SESSIONS)).select("dyad_id", "session_id", "occ_entropy", "mean_dwell")
    d = d.withColumn("k", F.count("*").over(Window.partitionBy("dyad_id"))).where("k >= 2")
    a, b = d.alias("a"), d.alias("b")
    pairs = a.join(b, (F.col("a.dyad_id") == F.col("b.dyad_id")) & (F.col("a.session_id") < F.col("b.session_id")))
    far = F.sqrt((F.col("a.occ_entropy") - F.col("b.occ_entropy")) ** 2 + (F.col("a.mean_dwell") - F.col("b.mean_dwell")) ** 2)
    return rounding(pairs.select("a.dyad_id", F.col("a.session_id").alias("a"), F.col("b.session_id").alias("b"), far.alias("distance")))


_PAIRS = 1000


@query(f"""WITH {STEPS}, s AS (SELECT DISTINCT session_id, dyad_id FROM steps), n AS (SELECT *, row_number() OVER (ORDER BY session_id) - 1 AS r, count(*) OVER () AS c FROM s),
k AS (SELECT d, cast('0x' || substr(md5('a|' || d), 1, 8) AS BIGINT) AS x, cast('0x' || substr(md5('b|' || d), 1, 8) AS BIGINT) AS y FROM unnest(range({64 * _PAIRS})) AS t(d)),
p AS (SELECT d, a.session_id AS a, b.session_id AS b FROM k JOIN n AS a ON a.r = x % a.c JOIN n AS b ON b.r = y % b.c WHERE a.dyad_id <> b.dyad_id)
SELECT a, b FROM p ORDER BY d LIMIT {_PAIRS}""")
def random_between_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed number of pairs of sessions of different pairs, drawn by hashes of the draw's number: no pair is built to be
    thrown away. Draws of one pair's sessions don't count; rounds of draws, each twice as many, go on until there are enough.
    Sessions get their numbers by an ordered count of ranges. Sessions of one pair only give no rows."""
    from dyadflow.operators.stats import average_ranks

    s = steps(spark, sf_dir).select("session_id", "dyad_id").distinct()
    n = cut(average_ranks(s, "session_id").select("session_id", "dyad_id", (F.col("rank") - 1).cast("long").alias("r")))
    c = n.agg(F.count("*").alias("n"), F.min("dyad_id").alias("lo"), F.max("dyad_id").alias("hi")).first()
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % max(c.n, 1)
    side = lambda name, key: n.select(F.col("r").alias(key), F.col("session_id").alias(name), F.col("dyad_id").alias(f"d{name}"))
    draws = 2 * _PAIRS
    while True:
        k = spark.range(draws if c.n and c.lo != c.hi else 0).withColumns({"x": draw("a"), "y": draw("b")})
        p = cut(k.join(side("a", "x"), "x").join(side("b", "y"), "y").where("da <> db").select("id", "a", "b"))
        if not c.n or c.lo == c.hi or p.count() >= _PAIRS:
            return p.orderBy("id").limit(_PAIRS).select("a", "b")
        draws *= 2


@query(f"""WITH {FEATURES}, g AS (SELECT dyad_id, sum(mean_dwell * length) / sum(length) AS dwell_geom, count(*) AS n_sessions, cast(sum(length) AS BIGINT) AS total_length FROM ft GROUP BY dyad_id)
SELECT g.dyad_id, n_sessions, total_length, {r6("dwell_geom")} AS dwell_geom, a.session_id AS session_cpl, {r6("a.occ_entropy")} AS entropy_cpl, b.session_id AS session_dir, {r6("b.switching_rate")} AS switching_dir
FROM g JOIN ft AS a USING (dyad_id) JOIN ft AS b USING (dyad_id)""")
def geometry_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair's geometry against two session tables by pair only, so each pair has its sessions squared: as the analysis
    does it, over all sessions."""
    f = features(spark, sf_dir)
    g = f.groupBy("dyad_id").agg(rollup.weighted_mean("mean_dwell", "length").alias("dwell_geom"), F.count("*").alias("n_sessions"), F.sum("length").alias("total_length"))
    a = f.select("dyad_id", F.col("session_id").alias("session_cpl"), F.col("occ_entropy").alias("entropy_cpl"))
    b = f.select("dyad_id", F.col("session_id").alias("session_dir"), F.col("switching_rate").alias("switching_dir"))
    return rounding(g.join(a, "dyad_id").join(b, "dyad_id"))


@query(f"""WITH {STEPS}, m(video, code) AS (VALUES (0, 'A1'), (1, 'B2'), (3, 'C3')), s AS (SELECT DISTINCT session_id, dyad_id, therapist_id FROM steps)
SELECT session_id, dyad_id, CASE WHEN code IS NULL THEN 'UNMAPPED_' || dyad_id ELSE 'THER_' || code END AS therapist FROM s LEFT JOIN m ON video = therapist_id""")
def therapist_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dyadflow.sources.tables import therapist_groups as grouped

    m = spark.createDataFrame([(0, "old"), (0, "A1"), (1, "B2"), (3, "C3")], "video_code int, therapist_code string")
    s = steps(spark, sf_dir).select("session_id", "dyad_id", "therapist_id").distinct()
    return grouped(s, m, "therapist_id").select("session_id", "dyad_id", "therapist")


@query(f"""WITH {FEATURES}, l AS (SELECT dyad_id, regime, occ FROM (SELECT dyad_id, avg(occ_0) AS "0", avg(occ_1) AS "1", avg(occ_2) AS "2" FROM ft GROUP BY dyad_id) UNPIVOT (occ FOR regime IN ("0", "1", "2")))
SELECT dyad_id, cast(regime AS INT) AS regime, {r6("occ")} AS occ FROM l""")
def occupancy_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = features(spark, sf_dir).groupBy("dyad_id").agg(*(F.avg(f"occ_{k}").alias(str(k)) for k in range(3)))
    return rounding(d.unpivot("dyad_id", ["0", "1", "2"], "regime", "occ").withColumn("regime", F.col("regime").cast("int")))


@query(f"""WITH {STEPS} SELECT dyad_id, {", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS {e}" for e in ("click", "error", "view"))} FROM steps GROUP BY dyad_id""")
def event_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("dyad_id").pivot("event_type", ["click", "error", "view"]).count().fillna(0)


@query(f"""WITH {STEPS}, c AS (SELECT event_type, th, count(*) AS n FROM steps GROUP BY ALL), e AS (SELECT * FROM unnest(['click', 'error', 'purchase', 'view', 'none']) AS a(event_type), unnest([0, 1, 2]) AS b(th))
SELECT event_type, cast(e.th AS INT) AS th, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (event_type, th)""")
def grid_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = steps(spark, sf_dir).groupBy("event_type", "th").agg(F.count("*").alias("n"))
    return rollup.completed(c, {"event_type": ["click", "error", "purchase", "view", "none"], "th": [0, 1, 2]}, {"n": 0})


_MODEL = [(0, [0.7, 0.2, 0.1], [0.6, 0.3, 0.1]), (1, [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]), (2, [0.7, 0.1, 0.2], [0.5, 0.3, 0.2]), (3, [0.4, 0.4, 0.2], [0.1, 0.8, 0.1])]
_MAX = lambda a: f"(list_position({a}, list_max({a})) - 1)"


@query(f"""WITH m(state, pt, pc) AS (VALUES {", ".join(f"({s}, {t}::DOUBLE[], {c}::DOUBLE[])" for s, t, c in _MODEL)}),
l AS (SELECT state, {_MAX("pt")} AS t, {_MAX("pc")} AS c, pt, pc FROM m), b AS (SELECT *, 'T' || ['neg', 'neu', 'pos'][t + 1] || '-C' || ['neg', 'neu', 'pos'][c + 1] AS base, row_number() OVER (ORDER BY t, c, pt, pc, state) AS number FROM l)
SELECT cast(state AS INT) AS state, number, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || row_number() OVER (PARTITION BY base ORDER BY number) ELSE base END AS label FROM b""")
def regime_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dyadflow.functions.scalars import first_largest

    m = spark.createDataFrame(_MODEL, "state int, pt array<double>, pc array<double>")
    d = m.withColumns({"t": first_largest(F.col("pt")), "c": first_largest(F.col("pc")), "base": valence_label(F.col("pt"), F.col("pc"))})
    d = d.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("t", "c", "pt", "pc", "state")).cast("long"))
    return d.select("state", "number", unlike("base", ["number"]).alias("label"))


@query(f"""WITH {STEPS}, a AS (SELECT DISTINCT session_id FROM steps WHERE event_type = 'error'), b AS (SELECT DISTINCT session_id FROM steps WHERE event_type = 'purchase')
SELECT 'only_error' AS kind, session_id FROM (SELECT session_id FROM a EXCEPT SELECT session_id FROM b) UNION ALL SELECT 'both', session_id FROM (SELECT session_id FROM a INTERSECT SELECT session_id FROM b)
UNION ALL SELECT 'neither', session_id FROM (SELECT DISTINCT session_id FROM steps) WHERE session_id NOT IN (SELECT session_id FROM a) AND session_id NOT IN (SELECT session_id FROM b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = steps(spark, sf_dir)
    a, b, every = (x.select("session_id").distinct() for x in (s.where("event_type = 'error'"), s.where("event_type = 'purchase'"), s))
    named = lambda d, k: d.select(F.lit(k).alias("kind"), "session_id")
    neither = every.join(a, "session_id", "left_anti").join(b, "session_id", "left_anti")
    return named(a.subtract(b), "only_error").unionByName(named(a.intersect(b), "both")).unionByName(named(neither, "neither"), allowMissingColumns=True)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.first_of(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"""WITH {FEATURES}, e AS (SELECT min(mean_dwell) AS lo, (max(mean_dwell) - min(mean_dwell)) / 30 AS w FROM ft), c AS (SELECT least(floor((mean_dwell - lo) / w), 29) AS b, count(*) AS n FROM ft, e GROUP BY ALL)
SELECT cast(k AS INT) AS bin, {r6("lo + k * w")} AS low, {r6("lo + (k + 1) * w")} AS high, coalesce(n, 0) AS n FROM unnest(range(30)) AS t(k) CROSS JOIN e LEFT JOIN c ON k = b""")
def dwell_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(rollup.histogram(features(spark, sf_dir), "mean_dwell", 30))


@query(f"""WITH q AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, n, {r6("q1")} AS q1, {r6("median")} AS median, {r6("q3")} AS q3, {r6("min(value)")} AS whisker_low, {r6("max(value)")} AS whisker_high FROM q JOIN events USING (event_type) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")
def value_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounding(rollup.box_stats(table(spark, sf_dir, "events"), "value", "event_type"))


@query(f"""WITH {FEATURES}, r AS (SELECT dyad_id, {r6("avg(occ_entropy)")} AS v FROM ft GROUP BY dyad_id)
SELECT dyad_id, v, {r6("sum(v / (SELECT sum(v) FROM r)) OVER (ORDER BY v DESC, dyad_id)")} AS cumulative FROM r""")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = features(spark, sf_dir).groupBy("dyad_id").agg(rounded(F.avg("occ_entropy")).alias("v"))
    every = Window.partitionBy(F.lit(0))
    return rounding(r.withColumn("cumulative", F.sum(F.col("v")).over(every.orderBy(F.desc("v"), "dyad_id").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("v").over(every)))
