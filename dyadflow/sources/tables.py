"""Readers of session files, legends, manifests, maps and surveys, and the guards on them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions.scalars import number
from dyadflow.operators.rollup import first_of
from dyadflow.operators.sequence import positioned


def java_pattern(pattern: str) -> str:
    """A start-anchored Java pattern from one with Python's named groups."""
    pattern = pattern.replace("(?P<", "(?<")
    return pattern if pattern.startswith("^") else f"^{pattern}"


def name_parts(name: Column, pattern: str, *groups: int) -> list[Column]:
    """Groups of a file name; an error where it doesn't match from its start."""
    p = java_pattern(pattern)
    bad = F.raise_error(F.concat(F.lit("file name doesn't match: "), name)).cast("string")
    return [F.when(F.regexp_like(name, F.lit(p)), F.regexp_extract(name, p, g)).otherwise(bad) for g in groups]


def resolved(df: DataFrame, *wanted: str) -> DataFrame:
    """Columns by name whatever their case; an error lists those that aren't there."""
    have = {c.lower(): c for c in df.columns}
    if missing := [w for w in wanted if w.lower() not in have]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df.select(*(F.col(f"`{have[w.lower()]}`").alias(w) for w in wanted))


def legend(spark: SparkSession, path: str, collapse: Mapping[str, int]) -> dict[int, int]:
    """code -> valence number, from a CSV of code_number, code_name, valence; valences that `collapse` lacks are an error."""
    rows = resolved(spark.read.csv(path, header=True), "code_number", "valence").limit(100_000).collect()
    if bad := sorted({r.valence for r in rows if r.valence not in collapse}):
        raise ValueError(f"unknown valences {bad}")
    return {int(r.code_number): collapse[r.valence] for r in rows}


def raw_sessions(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """session_id, dyad_id, file, pos, t, therapist, client from a folder of CSV files, one a session, all columns as text.

    t is the file's unnamed index column, or the row's number where there is none; rows keep the order of t. The two codes
    are doubles, null where they can't be read."""
    d = spark.read.option("header", True).option("inferSchema", False).csv(folder, pathGlobFilter="*.csv").select("*", F.col("_metadata.file_name").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    codes = resolved(d, "therapist", "client", "__file", "__row")
    index = next((c for c in d.columns if c in ("_c0", "Unnamed: 0")), None)
    dyad, letter = name_parts(F.col("__file"), pattern, 1, 2)
    if index:
        codes = d.select(*(F.col(f"`{c}`").alias(k) for k in ("therapist", "client", "__file", "__row") for c in d.columns if c.lower() == k), number(F.col(f"`{index}`")).alias("t"))
    else:
        codes = codes.withColumn("t", F.lit(None).cast("double"))
    codes = codes.select(F.concat_ws("_", dyad, letter).alias("session_id"), dyad.alias("dyad_id"), F.col("__file").alias("file"), "t", number(F.col("therapist")).alias("therapist"), number(F.col("client")).alias("client"), "__row")
    return positioned(codes, "t", "__row").withColumn("t", F.coalesce("t", F.col("pos").cast("double"))).drop("__row")


def unknown_codes(df: DataFrame, code: str, known: Mapping[int, int] | DataFrame) -> DataFrame:
    """The codes that the legend lacks, with counts."""
    have = known if isinstance(known, DataFrame) else df.sparkSession.createDataFrame([(int(k),) for k in known], "code int")
    return df.select(F.col(code).cast("int").alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n")).join(have.select(F.col("code").cast("int").alias("code")), "code", "left_anti")


def valences(raw: DataFrame, known: Mapping[int, int], strict: bool = True) -> DataFrame:
    """session steps with th and cl; missing values and unknown codes are errors that name them."""
    if strict:
        gone = raw.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in ("therapist", "client"))).first()
        if any(gone[c] for c in ("therapist", "client")):
            raise ValueError(f"missing codes: {gone.asDict()}")
        for c in ("therapist", "client"):
            if bad := sorted(r.code for r in unknown_codes(raw, c, known).limit(1000).collect()):
                raise ValueError(f"unknown {c} codes {bad}")
    at = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    code = lambda c: F.try_element_at(at, F.col(c).cast("int"))
    return raw.withColumns({"th": code("therapist"), "cl": code("client")})


def therapist_groups(sessions: DataFrame, therapists: DataFrame, video: str) -> DataFrame:
    """Adds therapist: THER_<code> of the video, or UNMAPPED_<dyad>. Of repeated videos the last code in order counts."""
    known = first_of(resolved(therapists, "video_code", "therapist_code").withColumn("__r", F.monotonically_increasing_id()), ["video_code"], [F.desc("__r")]).drop("__r")
    joined = sessions.join(known, sessions[video] == known["video_code"], "left")
    return joined.withColumn("therapist", F.coalesce(F.concat(F.lit("THER_"), "therapist_code"), F.concat(F.lit("UNMAPPED_"), F.col("dyad_id").cast("string")))).drop("video_code", "therapist_code")


def listed(steps: DataFrame, manifest: DataFrame, on: str = "session_id") -> DataFrame:
    """The steps of sessions that the manifest lists."""
    return steps.join(manifest.select(on).distinct(), on, "left_semi")


def misaligned(manifest: DataFrame, stored: DataFrame, key: str = "file", name: str = "session_id", most: int = 10) -> DataFrame:
    """Up to `most` files whose session differs between the manifest and what is stored, in order of the file: a report."""
    a = manifest.select(key, F.col(name).alias("listed"))
    return a.join(stored.select(key, F.col(name).alias("stored")), key).where(~F.col("listed").eqNullSafe(F.col("stored"))).orderBy(key).limit(most)


def survey(spark: SparkSession, path: str) -> DataFrame:
    """A wide survey CSV as text columns; unnamed columns keep Spark's names. Read cells with functions.number()."""
    return spark.read.option("header", True).csv(path)
