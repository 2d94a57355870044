"""Writers: session tables, manifests, run records, append-only checkpoints, and the guard against changed settings."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sessions(steps: DataFrame, path: str, clean: bool = False) -> None:
    """One dataset partitioned by pair: t, th and cl with the ids as columns. `clean` replaces what is there."""
    steps.write.mode("overwrite" if clean else "errorifexists").partitionBy("dyad_id").parquet(path)


def config_hash(config: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def run_signature(sessions: DataFrame, config: Mapping[str, Any]) -> str:
    """16 hex digits that change with any setting and with any session's id, length or codes (an order-free sum of hashes)."""
    r = sessions.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(sessions.columns))).alias("x")).first()
    return config_hash({"config": dict(config), "rows": r.n, "hash": r.x})[:16]


def manifest(steps: DataFrame, settings: Mapping[str, Any]) -> DataFrame:
    """A row for each session (or window, where steps have window): ids, steps, digests of raw and processed codes, whether
    they differ, and the settings."""
    by = [c for c in ("session_id", "dyad_id", "window", "file") if c in steps.columns]
    raw = [c for c in ("raw_th", "raw_cl") if c in steps.columns] or ["th", "cl"]
    same = steps.select(*by, "pos", *(F.col(c).alias(f"__r{i}") for i, c in enumerate(raw)), F.col("th").alias("__p0"), F.col("cl").alias("__p1"))
    one = lambda k: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", f"__{k}0", f"__{k}1"))), lambda s: F.concat_ws(",", s[f"__{k}0"].cast("string"), s[f"__{k}1"].cast("string"))), ";").cast("binary"), 256)
    d = same.groupBy(*by).agg(F.count("*").alias("n_steps"), one("r").alias("raw_hash"), one("p").alias("processed_hash"))
    d = d.withColumn("changed_from_raw", F.col("raw_hash") != F.col("processed_hash"))
    for k, v in settings.items():
        d = d.withColumn(k, F.lit(v))
    return d.withColumn("run_config_hash", F.lit(config_hash(settings)))


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def record(spark: SparkSession, path: str, **facts: Any) -> None:
    """One JSON row about a run, through Spark's file systems; written aside and renamed by the committer."""
    text = json.dumps({"written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **facts}, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def guard(stored: DataFrame, settings: Mapping[str, Any], tolerance: float = 1e-12) -> None:
    """An error if the stored manifest was made with other settings. Only settings that are in force are compared: the
    details of a step that is off don't count."""
    row = stored.limit(1).collect()
    if not row:
        return
    have = row[0].asDict()
    off = {p for p in ("debounce", "windowing") if not settings.get(f"{p}_enabled", True)}
    details = {"debounce": ("debounce_k",), "windowing": ("window_sec", "overlap")}
    skip = {d for p in off for d in details[p]}
    bad = {}
    for k, v in settings.items():
        w = have.get(k)
        if k in skip or k not in have:
            continue
        same = abs(float(w) - float(v)) <= tolerance if isinstance(v, float) and w is not None else str(w).lower() == str(v).lower()
        if not same:
            bad[k] = (w, v)
    if bad:
        raise RuntimeError(f"settings differ from the stored ones (stored, now): {bad}")


def append(df: DataFrame, path: str, signature: str) -> None:
    """Adds rows under a run's signature; what other runs wrote stays."""
    df.withColumn("run_signature", F.lit(signature)).write.mode("append").parquet(path)


def finished(spark: SparkSession, path: str, signature: str) -> DataFrame | None:
    """Rows of an earlier attempt at this run, None if there are none."""
    try:
        d = spark.read.parquet(path).where(F.col("run_signature") == signature)
        return d if d.limit(1).collect() else None
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """file and sha256 (hex) of each file that a path or pattern names, read by Spark; a file fits a task."""
    d = spark.read.format("binaryFile").load(path)
    return d.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear(spark: SparkSession, path: str) -> None:
    """Removes what an earlier run stored at a path, if anything."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def first_complete(spark: SparkSession, folders: list[str], names: tuple[str, ...]) -> str:
    """The first of the folders that holds all the named results; an error that lists the folders where none does."""
    for f in folders:
        if all(exists(spark, f"{f}/{n}") for n in names):
            return f
    raise FileNotFoundError(f"no folder with {list(names)} among {folders}")


def by_prefix(names: list[str], signature: str | None) -> str | None:
    """A run's name among stored ones: the signature itself, else the first in order that begins with it."""
    if not signature:
        return None
    return signature if signature in names else next((n for n in sorted(names) if n.startswith(signature)), None)


def write_tables(tables: Mapping[str, DataFrame | None], folder: str) -> list[str]:
    """Each table as CSV with a header under its name, through Spark; tables that are None are left out. Returns the names."""
    done = []
    for name, df in tables.items():
        if df is not None:
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
            done.append(name)
    return done


def write_result(df: DataFrame, folder: str, name: str, suffix: str = "") -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}{suffix}")


def finished_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV table that an earlier run wrote, None if there is none."""
    try:
        return spark.read.option("header", True).csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
