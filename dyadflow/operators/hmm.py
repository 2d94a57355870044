"""A hidden Markov model of one latent chain with two categorical emissions that are independent given the state.

Sequences are scored, decoded and counted in blocks of sessions at once. Fitting has two forms with the same result up to
the order of sums: many small fits in parallel, one a row, over sessions broadcast behind a check of their size; and, for
sessions beyond that, one fit whose expectation step is a Spark job of task partials.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_STEPS = 1 << 17
MAX_BROADCAST_STEPS = 50_000_000


@dataclass
class Hmm:
    pi: np.ndarray
    a: np.ndarray
    pt: np.ndarray
    pc: np.ndarray
    n_iter: int = 0

    @classmethod
    def random(cls, k: int, seed: int, n_obs: int = 3) -> Hmm:
        r = np.random.default_rng(seed)
        draw = [r.random(k), r.random((k, k)), r.random((k, n_obs)), r.random((k, n_obs))]
        return cls(*(x / x.sum(-1, keepdims=True) for x in draw))

    @property
    def k(self) -> int:
        return len(self.pi)

    def as_row(self) -> dict:
        return {"k": self.k, "pi": self.pi.tolist(), "a": self.a.tolist(), "pt": self.pt.tolist(), "pc": self.pc.tolist(), "n_iter": self.n_iter}

    @classmethod
    def from_row(cls, row) -> Hmm:
        arr = lambda x: np.array([list(v) if hasattr(v, "__len__") else v for v in x], float)
        return cls(arr(row["pi"]), arr(row["a"]), arr(row["pt"]), arr(row["pc"]), int(row["n_iter"]))


Sequences = Sequence[tuple[np.ndarray, np.ndarray]]
FIELDS = "k int, pi array<double>, a array<array<double>>, pt array<array<double>>, pc array<array<double>>, n_iter int"


class _Block:
    """Sessions, longest first, as padded arrays; at step t the first active[t] of them go on."""

    def __init__(self, seqs: Sequences):
        self.order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i][0]))
        self.n = np.array([len(seqs[i][0]) for i in self.order])
        self.t = np.zeros((len(seqs), self.n[0]), np.int64)
        self.c = np.zeros_like(self.t)
        for j, i in enumerate(self.order):
            self.t[j, : self.n[j]], self.c[j, : self.n[j]] = seqs[i]
        self.there = np.arange(self.n[0]) < self.n[:, None]
        self.active = self.there.sum(0)


def _blocks(seqs: Sequences) -> Iterator[tuple[np.ndarray, _Block]]:
    order = sorted((i for i in range(len(seqs)) if len(seqs[i][0])), key=lambda i: -len(seqs[i][0]))
    at = 0
    while at < len(order):
        take = max(1, BLOCK_STEPS // len(seqs[order[at]][0]))
        ids = order[at : at + take]
        yield np.array(ids), _Block([seqs[i] for i in ids])
        at += take


def _forward(m: Hmm, b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled state probabilities, their scales (1 beyond a session's end), and emission probabilities."""
    e = m.pt.T[b.t] * m.pc.T[b.c]
    alpha, scale = np.zeros_like(e), np.ones(b.t.shape)
    x = m.pi * e[:, 0]
    for t in range(b.t.shape[1]):
        k = b.active[t]
        if t:
            x = (alpha[:k, t - 1] @ m.a) * e[:k, t]
        scale[:k, t] = x.sum(1)
        alpha[:k, t] = x / scale[:k, t, None]
    return alpha, scale, e


def log_likelihoods(m: Hmm, seqs: Sequences) -> np.ndarray:
    out = np.zeros(len(seqs))
    for ids, b in _blocks(seqs):
        _, scale, _ = _forward(m, b)
        out[ids[b.order]] = np.log(scale).sum(1)
    return out


def _posterior(m: Hmm, b: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    alpha, scale, e = _forward(m, b)
    beta = np.ones_like(e)
    for t in range(b.t.shape[1] - 2, -1, -1):
        k = b.active[t + 1]
        beta[:k, t] = (e[:k, t + 1] * beta[:k, t + 1]) @ m.a.T / scale[:k, t + 1, None]
    gamma = alpha * beta * b.there[:, :, None]
    gamma /= np.where(b.there, gamma.sum(2), 1)[:, :, None]
    return gamma, alpha, beta, scale, e


def posteriors(m: Hmm, seqs: Sequences) -> list[np.ndarray]:
    """State probabilities at each step of each session."""
    out: list[np.ndarray] = [np.zeros((0, m.k))] * len(seqs)
    for ids, b in _blocks(seqs):
        gamma = _posterior(m, b)[0]
        for j, i in enumerate(ids[b.order]):
            out[i] = gamma[j, : b.n[j]]
    return out


def expected(m: Hmm, seqs: Sequences) -> np.ndarray:
    """One vector: log-likelihood, then expected counts of starts, transitions and both emissions. Sessions of fewer than two
    steps aren't counted."""
    k, n_obs = m.pt.shape
    total = np.zeros(1 + k + k * k + 2 * k * n_obs)
    for _, b in _blocks([s for s in seqs if len(s[0]) >= 2]):
        gamma, alpha, beta, scale, e = _posterior(m, b)
        on = b.there[:, 1:]
        after = (e[:, 1:] * beta[:, 1:] / scale[:, 1:, None])[on]
        moves = m.a * (alpha[:, :-1][on].T @ after)
        seen = [np.stack([gamma[(x == v) & b.there].sum(0) for v in range(n_obs)], axis=1) for x in (b.t, b.c)]
        total += np.concatenate([[np.log(scale).sum()], gamma[:, 0].sum(0), moves.ravel(), seen[0].ravel(), seen[1].ravel()])
    return total


def updated(m: Hmm, counts: np.ndarray, alpha_trans: float, alpha_emit: float) -> Hmm:
    k, n_obs = m.pt.shape
    at = np.cumsum([1, k, k * k, k * n_obs])
    pi, a, pt, pc = counts[1 : at[1]] + alpha_trans, counts[at[1] : at[2]].reshape(k, k) + alpha_trans, counts[at[2] : at[3]].reshape(k, n_obs) + alpha_emit, counts[at[3] :].reshape(k, n_obs) + alpha_emit
    return Hmm(*(x / x.sum(-1, keepdims=True) for x in (pi, a, pt, pc)), m.n_iter + 1)


def em(m: Hmm, count, n_iter: int, tol: float, alpha_trans: float, alpha_emit: float) -> tuple[Hmm, float]:
    """Fits by count(model) -> expected counts. The log-likelihood is that of the model before each update; a change under
    tol from one iteration to the next ends it."""
    last = None
    for i in range(n_iter):
        counts = count(m)
        m = updated(m, counts, alpha_trans, alpha_emit)
        if i and abs(counts[0] - last) < tol:
            return m, float(counts[0])
        last = counts[0]
    return m, float(last if last is not None else 0.0)


def fit(seqs: Sequences, k: int, seed: int, n_iter: int = 100, tol: float = 1e-4, alpha_trans: float = 1.0, alpha_emit: float = 1.0, n_obs: int = 3) -> tuple[Hmm, float]:
    return em(Hmm.random(k, seed, n_obs), lambda m: expected(m, seqs), n_iter, tol, alpha_trans, alpha_emit)


def viterbi(m: Hmm, seqs: Sequences) -> list[np.ndarray]:
    """The likeliest states; ties go to the lower state."""
    pi, a, pt, pc = (np.log(np.clip(p, 1e-300, 1.0)) for p in (m.pi, m.a, m.pt, m.pc))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
    for ids, b in _blocks(seqs):
        e = pt.T[b.t] + pc.T[b.c]
        back = np.zeros(e.shape, np.int64)
        delta = pi + e[:, 0]
        for t in range(1, b.t.shape[1]):
            k = b.active[t]
            s = delta[:k, :, None] + a
            back[:k, t] = s.argmax(1)
            delta[:k] = np.take_along_axis(s, back[:k, t][:, None, :], 1)[:, 0] + e[:k, t]
        best = delta.argmax(1)
        for j, i in enumerate(ids[b.order]):
            path = np.empty(b.n[j], np.int64)
            state = best[j]
            for t in range(b.n[j] - 1, -1, -1):
                path[t] = state
                state = back[j, t, state]
            out[i] = path
    return out


# On Spark.


def sessions(steps: DataFrame, *keys: str) -> DataFrame:
    """keys with T and C, each session's codes in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "th", "cl")))
    d = steps.groupBy(*keys).agg(ordered.alias("s"))
    return d.select(*keys, F.transform("s", lambda x: x["th"]).alias("T"), F.transform("s", lambda x: x["cl"]).alias("C"))


def _seqs(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.asarray(t, np.int64), np.asarray(c, np.int64)) for t, c in zip(frame["T"], frame["C"], strict=True)]


def _fields(df: DataFrame, *skip: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in skip)


def decoded(df: DataFrame, model: Hmm) -> DataFrame:
    """The sessions with n_steps, ll, occ (mean posterior of each state) and path."""
    keys = [c for c in df.columns if c not in ("T", "C")]
    held = df.sparkSession.sparkContext.broadcast(model)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = _seqs(f)
            g = posteriors(held.value, s)
            yield f[keys].assign(n_steps=[len(t) for t, _ in s], ll=log_likelihoods(held.value, s), occ=[x.mean(0).tolist() if len(x) else [] for x in g], path=[p.tolist() for p in viterbi(held.value, s)])

    return df.mapInPandas(each, f"{_fields(df, 'T', 'C')}, n_steps long, ll double, occ array<double>, path array<int>")


def paths_long(decoded_sessions: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, regime."""
    return decoded_sessions.select(*keys, F.posexplode("path").alias("p", "regime")).select(*keys, F.col("p").cast("long").alias("pos"), "regime")


def occupancy_wide(decoded_sessions: DataFrame, k: int, *keys: str) -> DataFrame:
    return decoded_sessions.select(*keys, "n_steps", *(F.col("occ")[i].alias(f"occ_{i}") for i in range(k)))


def fit_distributed(df: DataFrame, k: int, seed: int, n_iter: int = 100, tol: float = 1e-4, alpha_trans: float = 1.0, alpha_emit: float = 1.0, n_obs: int = 3) -> tuple[Hmm, float]:
    """One fit over sessions of any number: each expectation step is a job whose tasks return one vector."""
    sc = df.sparkSession.sparkContext
    df = df.select("T", "C").persist()

    def count(m: Hmm) -> np.ndarray:
        held = sc.broadcast(m)

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for f in frames:
                v = expected(held.value, _seqs(f))
                total = v if total is None else total + v
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        out = np.zeros(1 + k + k * k + 2 * k * n_obs)
        for r in df.mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r.i] = r.v
        held.unpersist()
        return out

    try:
        return em(Hmm.random(k, seed, n_obs), count, n_iter, tol, alpha_trans, alpha_emit)
    finally:
        df.unpersist()


TASK_KEYS = ("stage", "k", "alpha_trans", "alpha_emit", "fold", "restart")
TASKS = "stage string, k int, alpha_trans double, alpha_emit double, fold int, restart int, seed long"


def cv_tasks(ks: Iterable[int], alphas: Iterable[tuple[float, float]], folds: int, restarts: int) -> list[tuple]:
    return [("cv", k, at, ae, f, r, 1000 * k + 97 * f + 7 * r) for k in ks for at, ae in alphas for f in range(folds) for r in range(restarts)]


def refit_tasks(k: int, alpha_trans: float, alpha_emit: float, restarts: int) -> list[tuple]:
    return [("refit", k, alpha_trans, alpha_emit, -1, r, 900_000 + 1000 * k + 7 * r) for r in range(restarts)]


def fit_tasks(df: DataFrame, tasks: list[tuple], done: DataFrame | None = None, n_iter: int = 150, tol: float = 1e-4) -> DataFrame:
    """A row for each task (stage, k, priors, fold, restart, seed): the model, train_ll and train_steps, test_ll and test_steps
    (of the held out fold, null for a refit). df(fold, T, C). Tasks that `done` has already aren't fitted again. Sessions up to
    MAX_BROADCAST_STEPS steps are broadcast and tasks run in parallel; beyond that the tasks follow each other, each
    distributed."""
    spark = df.sparkSession
    todo = spark.createDataFrame(tasks, TASKS)
    keys = list(TASK_KEYS)
    if done is not None:
        todo = todo.join(done.select(*keys), keys, "left_anti")
    schema = f"{TASKS}, train_ll double, train_steps long, test_ll double, test_steps long, {FIELDS.replace('k int, ', '')}"
    steps = df.agg(F.sum(F.size("T")).alias("n")).first().n or 0
    if steps > MAX_BROADCAST_STEPS:
        rows = []
        for t in todo.collect():
            train, test = df.where(F.col("fold") != t.fold), df.where(F.col("fold") == t.fold)
            m, ll = fit_distributed(train, t.k, t.seed, n_iter, tol, t.alpha_trans, t.alpha_emit)
            out = decoded(test, m).agg(F.sum("ll").alias("ll"), F.sum("n_steps").alias("n")).first() if t.fold >= 0 else None
            seen = train.where(F.size("T") >= 2).agg(F.sum(F.size("T")).alias("n")).first().n
            rows.append((*t, ll, seen, out and out.ll, out and out.n, m.pi.tolist(), m.a.tolist(), m.pt.tolist(), m.pc.tolist(), m.n_iter))
        return spark.createDataFrame(rows, schema)
    local = df.select("fold", "T", "C").toPandas()  # MAX_BROADCAST_STEPS steps at most
    held = spark.sparkContext.broadcast((local["fold"].to_numpy(), [(np.asarray(t, np.int8), np.asarray(c, np.int8)) for t, c in zip(local["T"], local["C"], strict=True)]))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds, seqs = held.value
        for f in frames:
            out = []
            for t in f.to_dict("records"):
                train = [s for s, g in zip(seqs, folds, strict=True) if g != t["fold"]]
                test = [s for s, g in zip(seqs, folds, strict=True) if g == t["fold"]]
                m, ll = fit(train, t["k"], t["seed"], n_iter, tol, t["alpha_trans"], t["alpha_emit"])
                cv = t["fold"] >= 0
                out.append({**t, "train_ll": ll, "train_steps": sum(len(s[0]) for s in train if len(s[0]) >= 2), "test_ll": float(log_likelihoods(m, test).sum()) if cv else None, "test_steps": sum(len(s[0]) for s in test) if cv else None, **{k: v for k, v in m.as_row().items() if k != "k"}})
            if out:
                yield pd.DataFrame(out)

    return todo.repartition(max(1, len(tasks)), *keys).mapInPandas(each, schema)


def best_restarts(fits: DataFrame) -> DataFrame:
    """The restart with the best training log-likelihood of each (stage, k, priors, fold); the lower restart if equal."""
    keys = ["stage", "k", "alpha_trans", "alpha_emit", "fold"]
    whole = F.struct(*(c for c in fits.columns if c not in keys))
    best = fits.groupBy(*keys).agg(F.max_by(whole, F.struct("train_ll", -F.col("restart"))).alias("b"))
    return best.select(*keys, "b.*")


def selection(fits: DataFrame) -> DataFrame:
    """k, priors and the mean over folds of held-out log-likelihood per step, its standard error and the folds; best first
    by rank, ties to the smaller k and priors."""
    from pyspark.sql import Window

    v = F.col("test_ll") / F.nullif(F.col("test_steps"), F.lit(0))  # a fold without test steps has none
    d = best_restarts(fits.where("stage = 'cv'")).groupBy("k", "alpha_trans", "alpha_emit").agg(F.avg(v).alias("mean_ll_per_step"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"), F.count(v).alias("folds"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_ll_per_step"), "k", "alpha_trans", "alpha_emit")))


# In expressions, for models given as numbers.


def forward_expression(model: Hmm, t: Column, c: Column) -> Column:
    """The log-likelihood of two arrays of codes as one fold: no Python on the executors."""
    k = model.k
    emit = lambda i, x: F.array(*(F.lit(float(a)) for a in model.pt[i]))[x["t"]] * F.array(*(F.lit(float(a)) for a in model.pc[i]))[x["c"]]

    def step(acc, x):
        new = [sum((acc[f"s{i}"] * F.lit(float(model.a[i, j])) for i in range(k)), F.lit(0.0)) * emit(j, x) for j in range(k)]
        first = [F.lit(float(model.pi[j])) * emit(j, x) for j in range(k)]
        raw = [F.when(acc["n"] == 0, f).otherwise(s) for f, s in zip(first, new, strict=True)]
        total = sum(raw[1:], raw[0])
        return F.struct((acc["n"] + 1).alias("n"), (acc["ll"] + F.log(total)).alias("ll"), *((r / total).alias(f"s{j}") for j, r in enumerate(raw)))

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("ll"), *(F.lit(0.0).alias(f"s{j}") for j in range(k)))
    pairs = F.zip_with(t, c, lambda a, b: F.struct(a.alias("t"), b.alias("c")))
    return F.aggregate(pairs, start, step)["ll"]
