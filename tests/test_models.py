"""Markov models, hidden Markov models, tests, components and mixed models."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadflow.functions import tails
from dyadflow.operators import hmm, lmm, markov, pca, stats
from dyadflow.operators.folds import balanced_folds, fold_of
from dyadflow.session import cut

T = [2, 0, 0, 1, 2, 2, 1, 0]
C = [0, 0, 1, 2, 2, 0, 1, 1]
FOUR = {"p1": ("p", [1, 1, 2, 0, 0, 1], [2, 1, 1, 0, 2, 2]), "p2": ("p", [0, 2, 2, 1, 0, 0], [0, 0, 1, 1, 2, 0]), "q1": ("q", [2, 1, 0, 0, 1, 2], [1, 2, 2, 0, 0, 1]), "q2": ("q", [1, 0, 1, 2, 2, 0], [0, 1, 2, 1, 0, 2])}


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame([(s, d, i, a, b) for s, (d, t, c) in FOUR.items() for i, (a, b) in enumerate(zip(t, c))] + [("z1", "z", 0, 1, 1)], "session_id string, dyad_id string, pos long, th int, cl int")


def test_cross_validated_coupling(steps):
    folds = {"p": 0, "q": 1, "z": 1}
    fold = F.when(F.col("dyad_id") == "p", 0).otherwise(1)
    got = {r.session_id: r for r in markov.coupling(markov.cross_validated(steps, fold)).collect()}
    assert set(got) == set(FOUR)
    for s, (d, t, c) in FOUR.items():
        train = [(a, b) for d2, a, b in FOUR.values() if folds[d2] != folds[d]]
        p = lambda own, given, k: (sum(own(x, y, i) for x, y in train for i in range(1, len(x))) + 1) / (sum(given(x, y, i) for x, y in train for i in range(1, len(x))) + k)
        ll0 = ll1 = 0.0
        for i in range(1, len(t)):
            for u, v in ((0, 1), (1, 0)):
                me, other = (t, c)[u], (t, c)[v]
                ll0 += math.log(p(lambda x, y, j: (x, y)[u][j - 1] == me[i - 1] and (x, y)[u][j] == me[i], lambda x, y, j: (x, y)[u][j - 1] == me[i - 1], 3))
                ll1 += math.log(p(lambda x, y, j: (x, y)[u][j - 1] == me[i - 1] and (x, y)[v][j - 1] == other[i - 1] and (x, y)[u][j] == me[i], lambda x, y, j: (x, y)[u][j - 1] == me[i - 1] and (x, y)[v][j - 1] == other[i - 1], 3))
        assert got[s].n_transitions == 10
        assert (got[s].ll0_total, got[s].ll1_total) == pytest.approx((ll0, ll1))
        assert got[s].gain_per_trans == pytest.approx((ll1 - ll0) / 10)


def test_much_smoothing_leaves_no_gain(steps):
    r = markov.coupling(markov.cross_validated(steps, fold_of(F.col("session_id"), 3), alpha=1e9)).collect()
    assert all(abs(x.gain_per_trans) < 1e-6 for x in r)


def test_markov_guards(steps):
    with pytest.raises(ValueError):
        markov.cross_validated(steps, F.lit(0), alpha=0.0)
    with pytest.raises(Exception, match="a code outside"):
        markov.cross_validated(steps.withColumn("th", F.lit(7)), F.lit(0)).collect()


def test_balanced_folds(spark):
    d = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 3), ("c", 3), ("d", 1)) for _ in range(n)], "g string")
    assert {r.g: r.fold for r in balanced_folds(d, "g", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}
    with pytest.raises(ValueError):
        balanced_folds(d, "g", 9)


def plain_forward(m, t, c):
    """In log space, without scaling."""
    e = np.log(m.pt[:, t].T) + np.log(m.pc[:, c].T)
    x = np.log(m.pi) + e[0]
    for i in range(1, len(t)):
        x = np.logaddexp.reduce(x[:, None] + np.log(m.a), axis=0) + e[i]
    return float(np.logaddexp.reduce(x))


def brute_posterior(m, t, c):
    from itertools import product

    g, best, total = np.zeros((len(t), m.k)), (-1.0, None), 0.0
    for path in product(range(m.k), repeat=len(t)):
        p = m.pi[path[0]]
        for i, s in enumerate(path):
            p *= (m.a[path[i - 1], s] if i else 1) * m.pt[s, t[i]] * m.pc[s, c[i]]
        total += p
        for i, s in enumerate(path):
            g[i, s] += p
        best = max(best, (p, path), key=lambda b: b[0])
    return g / total, best[1], math.log(total)


def test_hmm_against_all_paths():
    m = hmm.Hmm.random(3, 4)
    seqs = [(np.array(T), np.array(C)), (np.array(T[:3]), np.array(C[:3])), (np.array([1]), np.array([2])), (np.array([], int), np.array([], int))]
    for (t, c), ll, g, path in zip(seqs, hmm.log_likelihoods(m, seqs), hmm.posteriors(m, seqs), hmm.viterbi(m, seqs), strict=True):
        if not len(t):
            assert ll == 0 and len(g) == len(path) == 0
            continue
        want, best, total = brute_posterior(m, t, c)
        assert ll == pytest.approx(total) == pytest.approx(plain_forward(m, t, c))
        assert np.allclose(g, want, atol=1e-12) and np.allclose(g.sum(1), 1)
        assert tuple(path) == best


def test_expected_counts():
    m = hmm.Hmm.random(3, 4)
    t, c = np.array(T), np.array(C)
    v = hmm.expected(m, [(t, c), (np.array([0]), np.array([0]))])  # one step doesn't count
    g, _, ll = brute_posterior(m, t, c)
    assert v[0] == pytest.approx(ll) and np.allclose(v[1:4], g[0])
    moves = v[4:13].reshape(3, 3)
    assert np.allclose(moves.sum(1), g[:-1].sum(0)) and np.allclose(moves.sum(0), g[1:].sum(0))
    seen = v[13:22].reshape(3, 3)
    assert np.allclose(seen, np.stack([g[t == k].sum(0) for k in range(3)], axis=1))


def test_em_climbs_and_both_fits_agree(spark, steps):
    seqs = [(np.array(t), np.array(c)) for _, t, c in FOUR.values()]
    lls = [hmm.fit(seqs, 2, 5, n_iter=n, alpha_trans=1e-9, alpha_emit=1e-9)[1] for n in (1, 3, 6, 12)]
    assert all(b >= a - 1e-9 for a, b in zip(lls, lls[1:]))
    d = hmm.sessions(steps, "session_id", "dyad_id")
    m, ll = hmm.fit_distributed(d, 2, 5, n_iter=4)
    n, ll2 = hmm.fit(seqs, 2, 5, n_iter=4)
    assert ll == pytest.approx(ll2) and np.allclose(m.a, n.a) and np.allclose(m.pt, n.pt)


def test_fit_tasks_resume_and_select(spark, steps):
    d = hmm.sessions(steps, "session_id", "dyad_id").withColumn("fold", (F.col("dyad_id") == "p").cast("int"))
    tasks = hmm.cv_tasks((2,), ((1.0, 1.0),), 2, 2)
    fits = cut(hmm.fit_tasks(d, tasks[:3], n_iter=3))
    rest = hmm.fit_tasks(d, tasks, fits, n_iter=3).collect()
    assert [(r.fold, r.restart) for r in rest] == [(1, 1)]
    whole = hmm.fit_tasks(d, tasks, n_iter=3)
    s = hmm.selection(whole).first()
    best = {r.fold: r.test_ll / r.test_steps for r in hmm.best_restarts(whole).collect()}
    assert s.mean_ll_per_step == pytest.approx(np.mean(list(best.values()))) and s.folds == 2
    assert {r.restart for r in hmm.fit_tasks(d, hmm.refit_tasks(2, 1.0, 1.0, 2), n_iter=2).collect()} == {0, 1}


def test_distributed_tasks_match(spark, steps, monkeypatch):
    d = hmm.sessions(steps, "session_id", "dyad_id").withColumn("fold", (F.col("dyad_id") == "p").cast("int"))
    tasks = hmm.cv_tasks((2,), ((1.0, 1.0),), 1, 1)
    a = hmm.fit_tasks(d, tasks, n_iter=3).first()
    monkeypatch.setattr(hmm, "MAX_BROADCAST_STEPS", 0)
    b = hmm.fit_tasks(d, tasks, n_iter=3).first()
    assert a.train_ll == pytest.approx(b.train_ll) and a.test_ll == pytest.approx(b.test_ll) and np.allclose(a.a, b.a)


def test_tails():
    assert tails.normal_sf(1.96) == pytest.approx(0.024997895, abs=1e-8)
    assert tails.chi2_sf(12, 7) == pytest.approx(0.1005588, abs=1e-6) and tails.chi2_sf(2, 2) == pytest.approx(math.exp(-1))
    assert tails.t_two_sided(2.0, 1) == pytest.approx(2 * (0.5 - math.atan(2.0) / math.pi))
    assert tails.f_sf(4.0, 2, 2) == pytest.approx(1 / 5)
    assert tails.binomial_sf(3, 5) == pytest.approx(0.5) and tails.binomial_sf(0, 5) == 1.0
    assert tails.signed_rank_sf(6, 3) == pytest.approx(1 / 8) and tails.signed_rank_sf(0, 3) == 1.0
    assert tails.benjamini_hochberg([0.01, 0.04, 0.03, 0.5]) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_rank_tests(spark):
    r = np.random.default_rng(0)
    rows = [(g, float(np.round(r.normal(k * 0.8, 1), 1))) for k, g in enumerate("abc") for _ in range(30)] + [(None, 1.0), ("a", None)]
    d = spark.createDataFrame(rows, "g string, x double")
    xs = [(g, x) for g, x in rows if g and x is not None]
    v = np.array([x for _, x in xs])
    ranks = np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    n = len(v)
    ties = sum(t**3 - t for t in np.unique(v, return_counts=True)[1])
    of = {g: ranks[[h == g for h, _ in xs]] for g in "abc"}
    h = (12 / (n * (n + 1)) * sum(q.sum() ** 2 / len(q) for q in of.values()) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    got = stats.kruskal_wallis(d, "x", "g").first()
    assert got.h == pytest.approx(h) and got.p == pytest.approx(tails.chi2_sf(h, 2)) and got.n_groups == 3
    dunn = {(q.a, q.b): q for q in stats.dunn(d, "x", "g").collect()}
    z = (of["a"].mean() - of["c"].mean()) / math.sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / 30 + 1 / 30))
    assert dunn["a", "c"].z == pytest.approx(z) and dunn["a", "c"].p == pytest.approx(min(1, 6 * tails.normal_sf(abs(z))))
    u = stats.mann_whitney(d.where("g in ('a', 'b') and x is not null"), "x", F.col("g") == "a").first()
    a, b = ([x for g, x in xs if g == k] for k in "ab")
    assert u.u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and u.p_less < 0.05
    w = stats.wilcoxon(spark.createDataFrame([(x,) for x in (1.5, -0.5, 2.0, 0.0, 3.0)], "x double"), "x").first()
    assert (w.w, w.n) == (9.0, 4) and w.p_greater == pytest.approx(2 / 16)
    s = stats.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 9.0), (4.0, 8.0)], "x double, y double"), "x", "y").first()
    assert s.rho == pytest.approx(0.6) and s.n == 4
    assert stats.spearman(spark.createDataFrame([(1.0, 2.0)] * 4, "x double, y double"), "x", "y", 8).first().rho is None


def test_components(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 3)) @ np.array([[2, 1, 0], [0, 1, 0.3], [0, 0, 0.2]]) + 5
    d = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    m = pca.fit(d, ["a", "b", "c"], 2)
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(np.cov(z.T, bias=True))[::-1]
    assert m["explained"] == pytest.approx((values / values.sum())[:2].tolist())
    got = np.array([(q.pc1, q.pc2) for q in pca.scores(d, m).collect()])
    assert np.allclose(got.var(0), values[:2]) and abs(np.corrcoef(got.T)[0, 1]) < 1e-9
    assert all(row[np.abs(row).argmax()] > 0 for row in m["loadings"])


def simulated(spark, slope_sd=0.0, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(60):
        b, s = r.normal(0, 1.5), r.normal(0, slope_sd)
        for _ in range(int(r.integers(3, 9))):
            x = r.normal(2, 3)
            rows.append((f"g{g}", 1 + b + (0.5 + s) * x + r.normal(0, 0.7), x, 1.0))
    return spark.createDataFrame([*rows, ("g0", None, 1.0, 1.0)], "g string, y double, x double, flat double"), rows


def test_random_intercept_is_the_maximum(spark):
    d, rows = simulated(spark)
    fit = lmm.random_intercept(d, "y", ["x", "flat"], "g")
    assert fit.terms == ["Intercept", "x"] and fit.n == len(rows) and fit.n_groups == 60
    x = np.array([r[2] for r in rows])
    z = np.stack([np.ones(len(rows)), (x - x.mean()) / x.std()], axis=1)
    y, g = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    same = (g[:, None] == g[None, :]).astype(float)

    def ll(beta, s2, sb):
        v = s2 * np.eye(len(y)) + sb * same
        e = y - z @ beta
        return -0.5 * (len(y) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + e @ np.linalg.solve(v, e))

    sb = fit.random_cov[0, 0]
    assert fit.llf == pytest.approx(ll(fit.beta, fit.sigma2, sb), rel=1e-6)
    for k in (0.9, 1.1):
        assert ll(fit.beta, fit.sigma2 * k, sb) < fit.llf and ll(fit.beta, fit.sigma2, sb * k) < fit.llf and ll(fit.beta * k, fit.sigma2, sb) < fit.llf
    assert fit.table()[1]["p_value"] < 1e-6 and abs(fit.beta[1] / x.std() - 0.5) < 0.1
    assert lmm.random_intercept(d.where("g = 'g1'"), "y", ["x"], "g") is None and lmm.random_intercept(d, "y", ["flat"], "g") is None


def test_random_slope(spark):
    d, _ = simulated(spark, 0.8)
    fit = lmm.random_slope(d, "y", "x", [], "g")
    plain = lmm.random_intercept(d, "y", ["x"], "g")
    assert fit.llf > plain.llf + 10
    sd = math.sqrt(fit.random_cov[1, 1]) / d.agg(F.stddev_pop("x")).first()[0]
    assert 0.5 < sd < 1.2 and fit.sigma2 == pytest.approx(0.49, rel=0.4)


def test_within_between(spark):
    d, _ = simulated(spark)
    t = {r["term"]: r for r in lmm.within_between(d, "y", "x", [], "g").table()}
    assert set(t) == {"Intercept", "x_within", "x_between"} and t["x_within"]["p_value"] < 1e-6
