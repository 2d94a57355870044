"""Codes, ids and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions import scalars
from dyadflow.plans.registry import query
from dyadflow.plans.steps import STEPS, steps
from dyadflow.sources import tables
from dyadflow.streaming.online import windowed_counts
from dyadflow.session import table

#: codes 0..79 to valences; codes beyond have none
LEGEND = {k: (k * 7) % 3 for k in range(80)}
_CODE = "cast(regexp_extract(props, '([0-9]+)', 1) AS INT)"


def _code():
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


@query(f"SELECT cast(CASE WHEN {_CODE} < 80 THEN ({_CODE} * 7) % 3 END AS INT) AS valence, count(*) AS n FROM events GROUP BY ALL")
def valence_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(scalars.mapped(_code(), LEGEND).alias("valence")).groupBy("valence").agg(F.count("*").alias("n"))


@query(f"SELECT {_CODE} AS code, count(*) AS n FROM events WHERE {_CODE} >= 80 GROUP BY ALL")
def unknown_codes_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unknown_codes(table(spark, sf_dir, "events").select(_code().alias("c")), "c", LEGEND)


@query(f"WITH {STEPS} SELECT session_id, any_value(dyad_id) AS dyad_id, count(*) AS n_steps, count(*) >= 60 AS long, count(DISTINCT event_type) AS kinds FROM steps GROUP BY session_id")
def session_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).groupBy("session_id", "dyad_id").agg(F.count("*").alias("n_steps"), (F.count("*") >= 60).alias("long"), F.count_distinct("event_type").alias("kinds"))


@query(f"WITH {STEPS} SELECT session_id, sha256(string_agg(th || ',' || cl, ',' ORDER BY pos)) AS digest FROM steps GROUP BY session_id")
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "th", "cl"))), lambda s: F.array(s["th"], s["cl"])))
    return steps(spark, sf_dir).groupBy("session_id").agg(scalars.digest(codes).alias("digest"))


_RAW = "CASE c_custkey % 5 WHEN 0 THEN ' ' || c_custkey || 'a' WHEN 1 THEN c_custkey || ' B' WHEN 2 THEN 'X' || c_custkey || '.5' WHEN 3 THEN c_custkey || 'C' ELSE c_name END"


@query(f"""WITH r AS (SELECT c_custkey, {_RAW} AS raw FROM customer), s AS (SELECT *, upper(replace(trim(raw), ' ', '')) AS s, split_part(trim(raw), '.', 1) AS h FROM r),
d AS (SELECT *, regexp_replace(h, '[^0-9]', '', 'g') AS hd, regexp_replace(left(s, length(s) - 1), '[^0-9]', '', 'g') AS sd FROM s)
SELECT c_custkey, raw, CASE WHEN hd <> '' THEN printf('%03d', cast(hd AS INT)) ELSE upper(h) END AS dyad_key,
CASE WHEN length(s) >= 2 AND right(s, 1) IN ('A', 'B') AND sd <> '' THEN printf('%03d', cast(sd AS INT)) || '_' || right(s, 1) END AS session_key, try_cast(regexp_extract(raw, '^([0-9]+)', 1) AS INT) AS leading FROM d""")
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    kind = F.col("c_custkey") % 5
    raw = F.when(kind == 0, F.concat(F.lit(" "), k, F.lit("a"))).when(kind == 1, F.concat(k, F.lit(" B"))).when(kind == 2, F.concat(F.lit("X"), k, F.lit(".5"))).when(kind == 3, F.concat(k, F.lit("C"))).otherwise(F.col("c_name"))
    d = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw"))
    return d.withColumns({"dyad_key": scalars.dyad_key(F.col("raw")), "session_key": scalars.session_key(F.col("raw")), "leading": scalars.leading_number(F.col("raw"))})


@query("WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '#VALUE!' WHEN o_orderkey % 7 = 1 THEN ' ' ELSE cast(cast(o_totalprice AS BIGINT) AS VARCHAR) END AS x, o_orderstatus FROM orders) SELECT o_orderstatus, count(*) AS n, count(try_cast(x AS DOUBLE)) AS readable, sum(try_cast(x AS DOUBLE)) AS total FROM r GROUP BY o_orderstatus")
def survey_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    x = F.when(k == 0, "#VALUE!").when(k == 1, " ").otherwise(F.bround("o_totalprice", 0).cast("long").cast("string"))
    d = table(spark, sf_dir, "orders").select("o_orderstatus", scalars.number(x).alias("x"))
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("x").alias("readable"), F.sum("x").alias("total"))


@query("SELECT cast(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e, "ts", "event_type").select(F.to_date("start").alias("day"), "event_type", "n")
