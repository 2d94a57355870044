"""Runs that break off half-way, priors for a given number of states, manifests, and stored artifacts."""

import numpy as np
import pytest

from dyadflow import cli
from dyadflow.operators import hmm
from dyadflow.sources import sinks
from dyadflow.sources.config import Analysis


@pytest.fixture()
def stored(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(f"s{k}", f"d{k % 4}", i, float(i), int(r.integers(3)), int(r.integers(3))) for k in range(8) for i in range(20)]
    spark.createDataFrame(rows, "session_id string, dyad_id string, pos long, t double, th int, cl int").write.parquet(f"{tmp_path}/steps")
    return Analysis(steps=f"{tmp_path}/steps", out_dir=f"{tmp_path}/res", n_splits=2, k_min=2, k_max=2, n_iter=3, n_restarts=3, refit_restarts=2, hmm_k=2)


def test_a_broken_run_repeats_only_the_rest(spark, stored, monkeypatch):
    calls, fit = [], hmm.fit_tasks

    def breaking(df, tasks, *rest):
        if len(calls) == 1:
            raise RuntimeError("lost")
        calls.append(list(tasks))
        return fit(df, tasks, *rest)

    monkeypatch.setattr(hmm, "fit_tasks", breaking)
    with pytest.raises(RuntimeError):
        cli.fit_hmm(spark, stored)
    first = spark.read.parquet(f"{stored.out_dir}/restart_results").count()
    assert first == len(calls[0]) == 4, "as many as run at once are stored before the next begin"
    again = []
    monkeypatch.setattr(hmm, "fit_tasks", lambda df, tasks, *rest: again.extend(tasks) or fit(df, tasks, *rest))
    out = cli.fit_hmm(spark, stored)
    assert len(again) == 2 * 3 + 2 - first and not {t[:6] for t in again} & {t[:6] for t in calls[0]}
    assert out.count() == 8


def test_decoding_goes_on_where_it_broke_off(spark, stored, monkeypatch):
    decoded, seen = hmm.decoded, []

    def breaking(df, model):
        if len(seen) == 2:
            raise RuntimeError("lost")
        seen.append(1)
        return decoded(df, model)

    monkeypatch.setattr(hmm, "decoded", breaking)
    with pytest.raises(RuntimeError):
        cli.fit_hmm(spark, stored)
    kept = {r.session_id for r in spark.read.parquet(f"{stored.out_dir}/decoded_sessions/K=2").collect()}
    assert 0 < len(kept) < 8
    rest = []
    monkeypatch.setattr(hmm, "decoded", lambda df, model: rest.extend(r.session_id for r in df.collect()) or decoded(df, model))
    out = cli.fit_hmm(spark, stored)
    assert sorted(rest) == sorted({f"s{k}" for k in range(8)} - kept) and out.count() == 8
    stored.n_iter = 4  # another model: all are decoded again
    out = cli.fit_hmm(spark, stored)
    assert out.select("run_signature").distinct().count() == 1 and out.count() == 8


def test_priors_of_a_given_k_are_the_selected_ones(spark, stored):
    stored.alpha_trans = [1.0, 2.0, 3.0]
    rows = [(8, 1.0, 1.0, -2.0, "other"), (8, 2.0, 1.5, -1.0, "other"), (2, 3.0, 1.0, -0.5, "other"), (2, 2.0, 1.0, -0.4, "other")]
    spark.createDataFrame(rows, "k int, alpha_trans double, alpha_emit double, mean_ll_per_step double, run_signature string").write.parquet(f"{stored.out_dir}/model_selection")
    assert cli.priors_for(spark, stored, 8, "x") == (2.0, 1.5)
    assert cli.priors_for(spark, stored, 5, "x") == (1.0, 1.0), "not stored: the first given"
    cli.fit_hmm(spark, stored, only_k=2)
    best = spark.read.parquet(f"{stored.out_dir}/best_model/K=2").first()
    assert (best.alpha_trans, best.alpha_emit) == (2.0, 1.0)


def test_only_listed_sessions_are_read_and_switches_hold(spark, stored, tmp_path):
    spark.createDataFrame([("s0", "d0"), ("s1", "d1"), ("s2", "d2"), ("s3", "d3")], "session_id string, dyad_id string").write.option("header", True).csv(f"{tmp_path}/manifest")
    stored.manifest = f"{tmp_path}/manifest"
    stored.run_directionality = stored.run_hmm = stored.run_recurrence = stored.run_motifs = False
    cli.run_all(spark, stored)
    assert spark.read.parquet(f"{stored.out_dir}/coupling_results").count() == 4
    assert not sinks.exists(spark, f"{stored.out_dir}/directionality_results") and not sinks.exists(spark, f"{stored.out_dir}/decoded_sessions")
    stored.manifest = f"{tmp_path}/nothing"
    with pytest.raises(FileNotFoundError):
        cli.coupling(spark, stored)


def test_artifacts(spark, tmp_path):
    d = spark.range(3)
    assert sinks.write_tables({"S1_a": d, "S2_b": None, "S3_c": d}, f"{tmp_path}/t") == ["S1_a", "S3_c"]
    assert sinks.first_complete(spark, [f"{tmp_path}/none", f"{tmp_path}/t"], ("S1_a", "S3_c")) == f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        sinks.first_complete(spark, [f"{tmp_path}/t"], ("S2_b",))
    assert sinks.by_prefix(["ab1", "ab", "c"], "ab") == "ab" and sinks.by_prefix(["ab2", "ab1"], "ab") == "ab1" and sinks.by_prefix(["a"], None) is None
    (tmp_path / "f.txt").write_text("x")
    r = sinks.file_sha256(spark, f"{tmp_path}/f.txt").first()
    assert r.sha256 == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881" and r.file.endswith("f.txt")


def test_tables_and_survey(spark, stored, tmp_path):
    d = spark.read.parquet(stored.steps)
    ids = d.select("*").selectExpr("concat(lpad(cast(int(substr(session_id, 2)) div 2 as string), 3, '0'), if(int(substr(session_id, 2)) % 2 = 0, '_A', '_B')) AS session_id", "lpad(cast(int(substr(session_id, 2)) div 2 as string), 3, '0') AS dyad_id", "pos", "t", "th", "cl")
    stored.steps = f"{tmp_path}/named"
    ids.write.parquet(stored.steps)
    stored.n_min, stored.n_null, stored.min_null_windows, stored.min_null_duration, stored.ks = 2, 4, 2, 3, [2]
    cells = "".join(f"{k // 2}{'ab'[k % 2]},{k * 1.5},{'#VALUE!' if k == 3 else 10 - k},{k % 3}\n" for k in range(8))
    (tmp_path / "survey.csv").write_text("Session Code,client total,therapist total,other\n" + cells + ",1,1,1\nnone,2,2,2\n")
    stored.survey, stored.survey_client, stored.survey_therapist = f"{tmp_path}/survey.csv", "client total", "therapist total"
    stored.survey_primary, stored.survey_subscales = ["other"], ["client total"]
    cli.run_all(spark, stored)
    names = {p.name for p in (tmp_path / "res/tables").iterdir()}
    assert {"S1_regime_emissions", "S1_regime_dynamics", "S1_dwell_summary", "S2_catrqa_by_dyad", "S2_catrqa_kruskal", "S3_grammar_regime_means", "S4_session_features", "S4_features_and_recurrence"} <= names
    one = spark.read.csv(f"{stored.out_dir}/survey/session_table", header=True, inferSchema=True).collect()
    assert len(one) == 8 and {r.session_id: r.difference for r in one if r.difference is not None} == {f"{k // 2:03d}_{'AB'[k % 2]}": k * 1.5 - (10 - k) for k in range(8) if k != 3}
    models = spark.read.csv(f"{stored.out_dir}/survey/models_volatility_exploratory", header=True, inferSchema=True)
    assert models.where("term = predictor and q is null").count() == 0
    assert spark.read.csv(f"{stored.out_dir}/survey/summary_primary", header=True).count() == 6
