"""Command line: python -m dyadflow.cli {ingest,coupling,hmm,recurrence,motifs,tables,survey,all} --config FILE [--set name=value ...]

`all` runs the steps after each other that the settings' run_* switches leave on, after ingest where --ingest_config names
its settings.
"""

from __future__ import annotations

import argparse
import ast
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions.scalars import N_VALENCE, joint, unlike, valence_label, window_id
from dyadflow.operators import analysis, hmm, markov, motifs, nulls, pca, recurrence, rollup, stats
from dyadflow.operators import sequence as S
from dyadflow.operators.folds import balanced_folds
from dyadflow.session import cut
from dyadflow.sources import sinks, tables
from dyadflow.sources.config import Analysis, Ingest, load


def ingest(spark: SparkSession, c: Ingest, clean: bool = False) -> DataFrame:
    """Raw session files to the steps dataset and its manifest."""
    known = tables.legend(spark, c.legend, c.collapse)
    d = tables.valences(tables.raw_sessions(spark, c.raw_dir, c.pattern), known)
    d = d.withColumns({"raw_th": F.col("th"), "raw_cl": F.col("cl")})
    stored = sinks.finished_csv(spark, f"{c.out_dir}/manifest")
    if stored is not None and not clean:
        sinks.guard(stored, c.settings())
    if c.debounce_enabled:
        d = S.debounced(S.debounced(d, "th", c.debounce_k), "cl", c.debounce_k)
    if c.windowing_enabled:
        sizes = S.window_sizes(S.sampling_interval(d, "t"), c.window_sec, c.overlap).select("session_id", "win", "step")
        d = S.windowed(d.join(sizes, "session_id"), F.greatest("win", F.lit(1)), F.col("step")).drop("win", "step")
        d = d.withColumns({"parent_id": F.col("session_id"), "session_id": window_id(F.col("session_id"), F.col("window")), "pos": F.col("pos") - F.col("w_start")})
    sinks.write_sessions(d, f"{c.out_dir}/steps", clean=True)
    d = spark.read.parquet(f"{c.out_dir}/steps")
    m = sinks.manifest(d, c.settings())
    sinks.write_manifest(m, f"{c.out_dir}/manifest")
    n = m.agg(F.count("*").alias("rows"), F.count_distinct("session_id").alias("sessions")).first()
    sinks.record(spark, f"{c.out_dir}/processing_run", rows=n.rows, sessions=n.sessions, **c.settings())
    return d


def steps_of(spark: SparkSession, c: Analysis) -> DataFrame:
    """The steps of the sessions that the manifest lists, all of them where the settings name none."""
    d = spark.read.parquet(c.steps)
    if not c.manifest:
        return d
    m = sinks.finished_csv(spark, c.manifest)
    if m is None:
        raise FileNotFoundError(f"no manifest at {c.manifest}")
    return tables.listed(d, m.select(F.col("session_id").cast(d.schema["session_id"].dataType)))


def with_folds(steps: DataFrame, group: str, n_splits: int) -> DataFrame:
    s = steps.select("session_id", group).distinct()
    folds = balanced_folds(s, group, n_splits)
    return steps.join(F.broadcast(folds), group)  # a row a group, folds.MAX_GROUPS at most


def coupling(spark: SparkSession, c: Analysis) -> None:
    d = steps_of(spark, c)
    runs = [("dyad_id", "", d)]
    if c.therapist_map and c.run_therapist_grouped:
        named = d.withColumn("video", F.regexp_extract(F.col("dyad_id").cast("string"), "^([0-9]+)", 1).try_cast("int"))
        runs.append(("therapist", "_therapist_grouped_cv", tables.therapist_groups(named, spark.read.csv(c.therapist_map, header=True).withColumn("video_code", F.col("video_code").try_cast("int")), "video")))
    for group, suffix, rows in runs:
        grouped = with_folds(rows, group, c.n_splits)
        s = markov.cross_validated(grouped, F.col("fold"), ("session_id", "dyad_id"), c.alpha, c.n_states).persist()
        one, two = markov.coupling(s), markov.directionality(s)
        results = {}
        if c.run_coupling:
            results |= {"coupling_results": one, "coupling_by_dyad": markov.coupling_by_dyad(one)}
        if c.run_directionality:
            results |= {"directionality_results": two, "directionality_by_dyad": markov.directionality_by_dyad(two)}
        for name, df in results.items():
            sinks.write_result(df, c.out_dir, name, suffix)
        s.unpersist()
    sinks.write_result(spark.createDataFrame([(h,) for h in c.horizons], "horizon int"), c.out_dir, "directionality_horizon")


def priors_for(spark: SparkSession, c: Analysis, k: int, signature: str) -> tuple[float, float]:
    """The priors of the best stored model selection for k states, this run's before others'; without one the first given."""
    path = f"{c.out_dir}/model_selection"
    if sinks.exists(spark, path):
        own = (F.col("run_signature") == signature).cast("int")
        best = spark.read.parquet(path).where(F.col("k") == k).orderBy(own.desc(), F.desc("mean_ll_per_step"), "alpha_trans", "alpha_emit").first()
        if best is not None:
            return best.alpha_trans, best.alpha_emit
    return c.alpha_trans[0], c.alpha_emit[0]


#: Decoding is stored in so many parts, so that a run that broke off goes on with the rest.
DECODE_PARTS = 8


def decode(spark: SparkSession, seqs: DataFrame, model: hmm.Hmm, path: str, signature: str, resume: bool) -> DataFrame:
    """Decoded sessions under `path`, a part after the other; those that an earlier attempt with the same data and model stored
    aren't decoded again."""
    done = sinks.finished(spark, path, signature) if resume else None
    if done is None:
        sinks.clear(spark, path)
    part = F.pmod(F.xxhash64("session_id"), F.lit(DECODE_PARTS))
    left = seqs if done is None else seqs.join(done.select("session_id"), "session_id", "left_anti")
    parts = sorted(r.part for r in left.select(part.alias("part")).distinct().collect())
    for k in parts:
        sinks.append(hmm.decoded(left.where(part == k), model), path, signature)
    return spark.read.parquet(path)


def fit_hmm(spark: SparkSession, c: Analysis, resume: bool = True, only_k: int | None = None) -> DataFrame:
    """Cross-validation, selection, refit and decoding. Fits are stored as many at a time as run at once, and decoded sessions
    by parts; an attempt that broke off loses those under way, and the next repeats only what isn't stored."""
    d = with_folds(steps_of(spark, c), "dyad_id", c.n_splits)
    seqs = hmm.sessions(d, "session_id", "dyad_id", "fold").persist()
    signature = sinks.run_signature(seqs, {k: getattr(c, k) for k in ("n_splits", "k_min", "k_max", "n_iter", "tol", "alpha_trans", "alpha_emit", "n_restarts", "refit_restarts")})
    path = f"{c.out_dir}/restart_results"
    attempt = "" if resume else f"-{uuid.uuid4().hex[:8]}"

    def fitted(tasks: list[tuple]) -> DataFrame:
        done = sinks.finished(spark, path, signature + attempt)
        known = {tuple(r) for r in done.select(*hmm.TASK_KEYS).collect()} if done is not None else set()  # a row for each task at most
        todo = [t for t in tasks if t[: len(hmm.TASK_KEYS)] not in known]
        wave = max(1, spark.sparkContext.defaultParallelism)
        for i in range(0, len(todo), wave):
            sinks.append(hmm.fit_tasks(seqs, todo[i : i + wave], None, c.n_iter, c.tol), path, signature + attempt)
        return sinks.finished(spark, path, signature + attempt)

    alphas = [(a, b) for a in c.alpha_trans for b in c.alpha_emit]
    if only_k is None:
        fits = fitted(hmm.cv_tasks(range(c.k_min, c.k_max + 1), alphas, c.n_splits, c.n_restarts))
        chosen = hmm.selection(fits)
        sinks.append(chosen, f"{c.out_dir}/model_selection", signature)
        if c.save_diagnostics:
            sinks.write_result(hmm.best_restarts(fits.where("stage = 'cv'")).withColumns({"train_ll_per_step": F.col("train_ll") / F.col("train_steps"), "test_ll_per_step": F.col("test_ll") / F.col("test_steps")}), c.out_dir, "cv_diagnostics")
        best = chosen.where("rank = 1").first()
        k, at, ae = best.k, best.alpha_trans, best.alpha_emit
    else:
        k, (at, ae) = only_k, priors_for(spark, c, only_k, signature)
    fits = fitted(hmm.refit_tasks(k, at, ae, c.refit_restarts)).where((F.col("stage") == "refit") & (F.col("k") == k) & (F.col("alpha_trans") == at) & (F.col("alpha_emit") == ae))
    row = hmm.best_restarts(fits).first()
    model = hmm.Hmm.from_row(row.asDict())
    sinks.write_result(spark.createDataFrame([(*model.as_row().values(), at, ae, row.train_ll, signature)], f"{hmm.FIELDS}, alpha_trans double, alpha_emit double, train_ll double, run_signature string"), c.out_dir, "best_model", f"/K={k}")
    sinks.record(spark, f"{c.out_dir}/run_info/hmm_K={k}", signature=signature, k=k, alpha_trans=at, alpha_emit=ae, selection_metric=c.selection_metric, refit_restarts=c.refit_restarts, resumed=resume)
    out = decode(spark, seqs, model, f"{c.out_dir}/decoded_sessions/K={k}", sinks.config_hash({"run": signature, "model": model.as_row()})[:16], resume)
    seqs.unpersist()
    return out


def _episodes(spark: SparkSession, c: Analysis, least: int) -> DataFrame:
    paths = hmm.paths_long(spark.read.parquet(f"{c.out_dir}/decoded_sessions/K={c.hmm_k}"), "session_id")
    d = steps_of(spark, c).join(paths, ["session_id", "pos"]).withColumn("x", joint("th", "cl"))
    return S.in_episodes(d, least)


_EPISODE = ("session_id", "dyad_id", "regime", "start", "end", "duration")


def run_recurrence(spark: SparkSession, c: Analysis) -> DataFrame:
    d = _episodes(spark, c, max(c.n_min, c.l_min, c.v_min))
    options = {"theiler": c.theiler, "l_min": c.l_min, "v_min": c.v_min}
    observed = recurrence.recurrence_by_sequence(d, _EPISODE, **options)
    draws = recurrence.recurrence_by_sequence(nulls.shuffled(d, _EPISODE, c.n_null, seed=c.seed), (*_EPISODE, "draw"), **options)
    out = nulls.compared(observed, draws, _EPISODE, ("rr", "det", "lam"), "shuffle")
    sinks.write_result(out, c.out_dir, "catrqa_episode_results", f"/K={c.hmm_k}")
    sinks.record(spark, f"{c.out_dir}/run_info/recurrence_K={c.hmm_k}", n_null=c.n_null, n_min=c.n_min, seed=c.seed, **options)
    return out


def run_motifs(spark: SparkSession, c: Analysis) -> DataFrame:
    out = None
    for k in c.ks:
        d = _episodes(spark, c, max(c.n_min, k))
        found = motifs.motif_metrics(motifs.motif_ids(d, k, _EPISODE), k, _EPISODE, c.top_n)
        long = d.where((F.col("duration") - (k - 1) >= c.min_null_windows) & (F.col("duration") >= c.min_null_duration))
        by = (*_EPISODE, "draw")
        for suffix, draws in (("shuffle", nulls.shuffled(long, _EPISODE, c.n_null, seed=c.seed)), ("markov", nulls.markov_surrogates(long, _EPISODE, c.n_null, seed=c.seed))):
            found = nulls.compared(found, motifs.motif_metrics(motifs.motif_ids(draws, k, by), k, by, c.top_n), _EPISODE, motifs.METRICS, suffix)
        found = found.withColumn("k", F.lit(k))
        out = found if out is None else out.unionByName(found)
    sinks.write_result(out, c.out_dir, "grammar_episode_results", f"/K={c.hmm_k}")
    sinks.record(spark, f"{c.out_dir}/run_info/motifs_K={c.hmm_k}", ks=c.ks, n_null=c.n_null, top_n=c.top_n, seed=c.seed, min_null_windows=c.min_null_windows, min_null_duration=c.min_null_duration)
    return out


def class_tests(d: DataFrame, metrics: Sequence[str], group: str) -> tuple[DataFrame, DataFrame]:
    """Kruskal-Wallis of each metric over the classes, and Dunn's pairs."""
    kw = pairs = None
    for m in metrics:
        one = stats.kruskal_wallis(d, m, group).withColumn("metric", F.lit(m))
        two = stats.dunn(d, m, group).withColumn("metric", F.lit(m))
        kw, pairs = (one, two) if kw is None else (kw.unionByName(one), pairs.unionByName(two))
    return kw, pairs


def run_tables(spark: SparkSession, c: Analysis) -> list[str]:
    """The supplementary tables from the stored results, as CSV under out_dir/tables: S1 the model's regimes, S2 recurrence, S3
    motifs, S4 sessions' geometry. Results that aren't there leave theirs out; returns the names of those written."""
    k, folder = c.hmm_k, f"{c.out_dir}/tables"
    read = lambda name: spark.read.parquet(f"{c.out_dir}/{name}/K={k}") if sinks.exists(spark, f"{c.out_dir}/{name}/K={k}") else None
    out: dict[str, DataFrame | None] = {}
    best, decoded = read("best_model"), read("decoded_sessions")
    if best is not None:
        matrix = best.select(F.posexplode("a").alias("i", "row")).select("i", F.posexplode("row").alias("j", "p"))
        emissions = best.select(F.posexplode(F.arrays_zip("pt", "pc")).alias("state", "e")).select("state", F.col("e.pt").alias("pt"), F.col("e.pc").alias("pc")).withColumn("base", valence_label(F.col("pt"), F.col("pc")))
        places = [F.col(e)[v].alias(f"{n}_{v}") for e, n in (("pt", "therapist"), ("pc", "client")) for v in range(N_VALENCE)]
        out["S1_regime_emissions"] = emissions.select("state", unlike("base", ["state"]).alias("label"), *places)
        out["S1_transitions"] = matrix
        out["S1_regime_dynamics"] = rollup.regime_dynamics(matrix)
    if decoded is not None:
        e = S.episodes(hmm.paths_long(decoded, "session_id"), 1)
        out["S1_dwell_summary"] = e.groupBy("regime").agg(F.count("*").alias("n_episodes"), F.avg("duration").alias("mean"), F.median("duration").alias("median"), F.stddev_samp("duration").alias("sd"))
        out["S1_dwell_kruskal"], out["S1_dwell_dunn"] = class_tests(e, ["duration"], "regime")
        path = hmm.paths_long(decoded, "session_id")
        f = rollup.session_features(path, "regime", k, ("session_id",))
        out["S4_session_features"] = f
        out["S4_session_pca"] = pca.scores(f, pca.fit(f, GEOMETRY, 2)).select("session_id", "pc1", "pc2") if f.count() >= 3 else None
    for name, prefix, metrics, group in (("catrqa_episode_results", "S2_catrqa", ("rr_z_shuffle", "det_z_shuffle", "lam_z_shuffle"), ["regime"]), ("grammar_episode_results", "S3_grammar", tuple(f"{m}_z_shuffle" for m in motifs.METRICS), ["regime", "k"])):
        d = read(name)
        if d is None:
            continue
        gone = F.lit(False)
        for m in metrics:
            gone = gone | F.coalesce(F.abs(F.col(m)) > c.outlier_z, F.lit(False))
        out[f"{prefix}_outlier_rows"] = d.where(gone)
        clean = rollup.without_outliers(d, metrics, c.outlier_z).na.drop(how="all", subset=list(metrics))
        dyads = analysis.class_rollup(clean, metrics, group).persist()
        out[f"{prefix}_by_dyad"] = dyads
        out[f"{prefix}_regime_means"] = dyads.groupBy(*group).agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("n_dyads"))
        out[f"{prefix}_kruskal"], out[f"{prefix}_dunn"] = class_tests(dyads, metrics, "regime")
        if prefix == "S2_catrqa" and "S4_session_features" in out:
            out["S4_features_and_recurrence"] = out["S4_session_features"].join(analysis.by_session(clean, metrics), "session_id")
    return sinks.write_tables(out, folder)


#: What the sessions' geometry is made of.
GEOMETRY = ("switching_rate", "mean_dwell", "cv_dwell", "trans_entropy", "occ_entropy")


def run_survey(spark: SparkSession, c: Analysis) -> list[str]:
    """The session table and the models of the survey's measures on it, as CSV under out_dir/survey."""
    s = analysis.survey_rows(tables.survey(spark, c.survey), c.survey_code, [*c.survey_primary, *c.survey_subscales], c.survey_client or None, c.survey_therapist or None)
    decoded = spark.read.parquet(f"{c.out_dir}/decoded_sessions/K={c.hmm_k}")
    f = rollup.session_features(hmm.paths_long(decoded, "session_id"), "regime", c.hmm_k, ("session_id",)).select("session_id", *GEOMETRY)
    wide = hmm.occupancy_wide(decoded, c.hmm_k, "session_id", "dyad_id")
    read = lambda name: spark.read.parquet(f"{c.out_dir}/{name}")
    d = analysis.session_table(read("coupling_results"), read("directionality_results"), wide, f, s, F.upper(F.col("session_id")))
    d = cut(pca.scores(d, pca.fit(d, GEOMETRY, 2)))
    outcomes = {"coupling": ["delta_ll", "delta_t", "delta_c"], "volatility": ["pc1", "pc2", *GEOMETRY], "occupancy": analysis.numbered(d.columns, "p_")}
    primary = [*c.survey_primary, *(["difference"] if "difference" in d.columns else [])]
    blocks = analysis.model_blocks(outcomes, primary, c.survey_subscales, {"coupling": ["n_transitions"], "volatility": ["n_steps"], "occupancy": ["n_steps"]})
    out: dict[str, DataFrame | None] = {"session_table": d}
    for b in blocks:
        out[f"models_{b['block']}"] = analysis.run_blocks(d, [b], "dyad_id")
    every = analysis.run_blocks(d, [b for b in blocks if b["block"].endswith("primary")], "dyad_id")
    if every is not None:
        out["summary_primary"] = analysis.focus_summary(every, ("delta_ll", "pc1", "pc2"), primary)
    out["models_coefficients"] = analysis.coefficient_models(d, primary, ("pc1", "pc2"), "dyad_id")
    out["correlations"] = analysis.correlation_matrix(d, primary, ["delta_ll", "pc1", "pc2", *GEOMETRY])
    return sinks.write_tables(out, f"{c.out_dir}/survey")


def run_all(spark: SparkSession, c: Analysis, before: Ingest | None = None, resume: bool = True, clean: bool = False) -> None:
    """Every step that the settings leave on, in order."""
    if before is not None:
        ingest(spark, before, clean)
    if c.run_coupling or c.run_directionality:
        coupling(spark, c)
    if c.run_hmm:
        fit_hmm(spark, c, resume)
    if c.run_recurrence:
        run_recurrence(spark, c)
    if c.run_motifs:
        run_motifs(spark, c)
    run_tables(spark, c)
    if c.survey:
        run_survey(spark, c)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("step", choices=["ingest", "coupling", "hmm", "recurrence", "motifs", "tables", "survey", "all"])
    p.add_argument("--config")
    p.add_argument("--ingest_config")
    p.add_argument("--set", action="append", default=[], metavar="name=value")
    p.add_argument("--clean_output", action="store_true")
    p.add_argument("--no-resume", action="store_true")
    p.add_argument("--refit_only_k", type=int)
    a = p.parse_args(argv)

    def value(text: str):
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError):
            return text

    given = {k: value(v) for k, v in (s.split("=", 1) for s in a.set)}
    spark = SparkSession.builder.appName(f"dyadflow-{a.step}").getOrCreate()
    if a.step == "ingest":
        ingest(spark, load(Ingest, a.config, **given), a.clean_output)
        return
    c = load(Analysis, a.config, **given)
    if a.step == "all":
        run_all(spark, c, load(Ingest, a.ingest_config) if a.ingest_config else None, not a.no_resume, a.clean_output)
    elif a.step == "hmm":
        fit_hmm(spark, c, not a.no_resume, a.refit_only_k)
    else:
        {"coupling": coupling, "recurrence": run_recurrence, "motifs": run_motifs, "tables": run_tables, "survey": run_survey}[a.step](spark, c)


if __name__ == "__main__":
    main()
