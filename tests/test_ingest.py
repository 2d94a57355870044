"""Files to results: readers, guards, and the command line's steps end to end with a resume."""

import pytest
from pyspark.sql import functions as F

from dyadflow import cli
from dyadflow.functions import scalars
from dyadflow.operators import rollup
from dyadflow.sources import sinks, tables
from dyadflow.sources.config import Analysis, Ingest, load


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (tmp_path / "legend.csv").write_text("code_number,code_name,valence\n1,anger,Negative\n2,calm,Neutral\n3,joy,Positive\n")
    for s in ("001A", "001B", "002A", "003A", "003B", "004A"):
        k = int(s[:3])
        body = "\n".join(f"{i},{1 + (i * k + i // 5) % 3},{1 + (i + k) % 3}" for i in range(60))
        (folder / f"{s}_session.csv").write_text(f",Therapist,CLIENT\n{body}\n")
    return tmp_path


def config(raw, **more):
    return Ingest(raw_dir=str(raw / "raw"), legend=str(raw / "legend.csv"), out_dir=str(raw / "out"), **more)


def test_ingest(spark, raw):
    d = cli.ingest(spark, config(raw))
    rows = d.where("session_id = '001_A'").orderBy("pos").collect()
    assert len(rows) == 60 and d.select("session_id").distinct().count() == 6
    assert [r.th for r in rows[:6]] == [(i + i // 5) % 3 for i in range(6)] and [r.t for r in rows[:3]] == [0.0, 1.0, 2.0]
    m = spark.read.option("header", True).csv(f"{raw}/out/manifest")
    assert m.count() == 6 and {r.changed_from_raw for r in m.collect()} == {"false"}
    cli.ingest(spark, config(raw))  # the same settings pass the guard
    with pytest.raises(RuntimeError, match="debounce"):
        cli.ingest(spark, config(raw, debounce_enabled=True, debounce_k=1))
    d = cli.ingest(spark, config(raw, debounce_enabled=True, debounce_k=1, windowing_enabled=True, window_sec=20.0, overlap=0.5), clean=True)
    assert d.select("session_id").distinct().count() == 6 * 5
    assert {r.n for r in d.groupBy("session_id").agg(F.count("*").alias("n")).collect()} == {20}
    assert d.where("session_id = '001_A__w0003'").agg(F.min("pos"), F.max("pos")).first() == (0, 19)


def test_ingest_guards(spark, raw):
    (raw / "raw" / "005A_session.csv").write_text(",therapist,client\n0,1,9\n1,2,3\n")
    with pytest.raises(ValueError, match="unknown client codes \\[9\\]"):
        cli.ingest(spark, config(raw))
    (raw / "raw" / "005A_session.csv").write_text(",therapist,client\n0,1,\n1,2,3\n")
    with pytest.raises(ValueError, match="missing codes"):
        cli.ingest(spark, config(raw))
    (raw / "raw" / "005A_session.csv").unlink()
    (raw / "raw" / "nonsense.csv").write_text(",therapist,client\n0,1,1\n")
    with pytest.raises(Exception, match="file name"):
        cli.ingest(spark, config(raw))
    with pytest.raises(ValueError, match="unknown valences"):
        tables.legend(spark, str(raw / "legend.csv"), {"Negative": 0})
    with pytest.raises(ValueError, match="missing columns"):
        tables.resolved(spark.createDataFrame([(1,)], "a int"), "b")
    assert tables.java_pattern("(?P<n>x)") == "^(?<n>x)"


def test_steps_after_ingest(spark, raw):
    cli.ingest(spark, config(raw))
    c = Analysis(steps=f"{raw}/out/steps", out_dir=f"{raw}/res", n_splits=2, k_min=2, k_max=2, n_iter=3, n_restarts=1, refit_restarts=2, hmm_k=2, n_min=3, n_null=3, min_null_windows=2, min_null_duration=3, ks=[2])
    (raw / "map.csv").write_text("therapist_code,video_code\nX,1\nY,2\nZ,2\n")
    c.therapist_map = f"{raw}/map.csv"
    cli.coupling(spark, c)
    one = spark.read.parquet(f"{raw}/res/coupling_results")
    assert one.count() == 6 and spark.read.parquet(f"{raw}/res/coupling_results_therapist_grouped_cv").count() == 6
    assert spark.read.parquet(f"{raw}/res/directionality_by_dyad").count() == 4
    out = cli.fit_hmm(spark, c)
    assert out.count() == 6 and out.where("size(path) = 60").count() == 6
    fits = spark.read.parquet(f"{raw}/res/restart_results").count()
    assert fits == 2 + 2
    cli.fit_hmm(spark, c)
    assert spark.read.parquet(f"{raw}/res/restart_results").count() == fits, "a second run repeats nothing"
    r = cli.run_recurrence(spark, c).collect()
    m = cli.run_motifs(spark, c).collect()
    assert all(0 <= x.rr <= 1 for x in r) and all(x.n_windows >= 1 for x in m)


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("alpha: 2.5\nks: [3]\n")
    c = load(Analysis, str(p), n_splits=0, tol=None)
    assert (c.alpha, c.ks, c.n_splits, c.tol) == (2.5, [3], 0, 1e-4)
    with pytest.raises(ValueError):
        load(Analysis, None, nonsense=1)
    with pytest.raises(ValueError):
        Ingest(overlap=1.0)


def test_keys(spark):
    rows = [("1a",), ("001 B",), ("12C",), (" ",), (None,), ("A",), ("x7b",), ("7.5",), ("ab",)]
    d = spark.createDataFrame(rows, "s string").select("s", scalars.session_key(F.col("s")).alias("k"), scalars.dyad_key(F.col("s")).alias("d")).collect()
    assert [r.k for r in d] == ["001_A", "001_B", None, None, None, None, "007_B", None, None]
    assert [r.d for r in d] == ["001", "001", "012", "", None, "A", "007", "007", "AB"]


def test_guard_compares_only_what_is_on(spark):
    stored = spark.createDataFrame([("false", "9", "false", "60.0", "0.5")], "debounce_enabled string, debounce_k string, windowing_enabled string, window_sec string, overlap string")
    sinks.guard(stored, Ingest().settings())
    with pytest.raises(RuntimeError):
        sinks.guard(stored, Ingest(debounce_enabled=True).settings())


def test_weighted_mean_policies(spark):
    d = spark.createDataFrame([(1.0, 1.0), (None, 3.0), (5.0, 1.0)], "v double, w double")
    m = rollup.weighted_mean
    r = d.agg(m("v", "w").alias("a"), m("v", "w", "keep_weight").alias("b"), m("v", "w", "spread").alias("c")).first()
    assert (r.a, r.b, r.c) == (3.0, 1.2, None)
    z = d.withColumn("w", F.lit(0.0)).agg(m("v", "w").alias("a"), m("v", "w", no_weight="zero").alias("b")).first()
    assert (z.a, z.b) == (None, 0.0)


def test_misaligned_report_and_listing(spark):
    a = spark.createDataFrame([("f1", "s1"), ("f2", "s2")], "file string, session_id string")
    b = spark.createDataFrame([("f1", "s1"), ("f2", "s2__w0000")], "file string, session_id string")
    assert [r.file for r in tables.misaligned(a, b).collect()] == ["f2"]
    assert tables.listed(b, a).count() == 1
