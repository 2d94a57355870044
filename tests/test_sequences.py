"""Sequence operators, motifs, recurrence and nulls against plain loops."""

import math
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dyadflow.operators import motifs, nulls, recurrence
from dyadflow.operators import sequence as S

CASES = {1: [], 2: [0], 3: [1, 1, 1, 1], 4: [0, 1, 0, 0, 2, 2, 2, 1], 5: [2, 0, 0, 1, 0, 0, 0, 2, 1, 1, 0, 1], 6: [0, 0, 1, 1], 7: [0, 1, 2, 0, 1, 2, 2]}


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame([(s, i, x) for s, xs in CASES.items() for i, x in enumerate(xs)], "session_id long, pos long, x int").repartition(3)


def runs_of(xs):
    out, at = [], 0
    for v, g in groupby(xs):
        n = len(list(g))
        out.append((v, at, at + n))
        at += n
    return out


def test_runs_and_episodes(steps):
    got = {(r.session_id, r.x, r.start, r.end) for r in S.runs(steps, "x").collect()}
    assert got == {(s, *r) for s, xs in CASES.items() for r in runs_of(xs)}
    got = {(r.session_id, r.x, r.start, r.end, r.duration) for r in S.episodes(steps, 2, "x").collect()}
    assert got == {(s, v, a, b, b - a) for s, xs in CASES.items() for v, a, b in runs_of(xs) if b - a >= 2}
    inside = {(r.session_id, r.pos, r["at"]) for r in S.in_episodes(steps, 2, "x").collect()}
    assert inside == {(s, i, i - a) for s, xs in CASES.items() for _, a, b in runs_of(xs) if b - a >= 2 for i in range(a, b)}


def debounce(xs, k):
    rs, out = runs_of(xs), []
    for i, (v, a, b) in enumerate(rs):
        left, right = (rs[i - 1] if i else None), (rs[i + 1] if i + 1 < len(rs) else None)
        if k > 0 and b - a <= k and (left or right):
            v = right[0] if not left else left[0] if not right or left[2] - left[1] >= right[2] - right[1] or left[0] == right[0] else right[0]
        out += [v] * (b - a)
    return out


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_debounce(steps, k):
    got = {(r.session_id, r.pos): r.x for r in S.debounced(steps, "x", k).collect()}
    assert got == {(s, i): x for s, xs in CASES.items() for i, x in enumerate(debounce(xs, k))}


@pytest.mark.parametrize(("win", "step"), [(3, 2), (4, 4), (2, 5), (100, 1)])
def test_windows(steps, win, step):
    got = {(r.session_id, r.w_start, r.w_end, r.pos) for r in S.windowed(steps, win, step).collect()}
    want = set()
    for s, xs in CASES.items():
        n = len(xs)
        w = min(win, n)
        want |= {(s, a, a + w, i) for a in range(0, n - w + 1, step) if n for i in range(a, a + w)}
    assert got == want
    with pytest.raises(ValueError):
        S.windowed(steps, 0, 1)


def test_window_sizes_round_halves_to_even(spark):
    d = spark.createDataFrame([(1, 10.0), (2, 2.0)], "session_id long, dt double")
    assert [(r.win, r.step) for r in S.window_sizes(d, 25, 0.5).orderBy("session_id").collect()] == [(2, 1), (12, 6)]
    with pytest.raises(ValueError):
        S.window_sizes(d, 25, 1.0)


def test_switching_and_dwell(steps):
    got = {r.session_id: r.switching_rate for r in S.switching(steps, "x").collect()}
    for s, xs in CASES.items():
        if xs:
            assert got[s] == pytest.approx(np.mean(np.diff(xs) != 0) if len(xs) > 1 else 0.0)
    got = {r.session_id: (r.mean_dwell, r.cv_dwell) for r in S.dwell(steps, "x").collect()}
    for s, xs in CASES.items():
        if xs:
            n = np.array([b - a for _, a, b in runs_of(xs)])
            assert got[s] == pytest.approx((n.mean(), n.std() / n.mean()))


def entropy(c):
    p = np.array(list(c.values())) / sum(c.values())
    return float(-(p * np.log(p)).sum())


@pytest.mark.parametrize("k", [1, 2, 3])
def test_motif_metrics(steps, k):
    d = steps.withColumnRenamed("pos", "at")
    got = {r.session_id: r for r in motifs.motif_metrics(motifs.motif_ids(d, k, ("session_id",)), k, ("session_id",), 2).collect()}
    for s, xs in CASES.items():
        ids = [sum(9 ** (k - 1 - j) * xs[i + j] for j in range(k)) for i in range(len(xs) - k + 1)]
        if not ids:
            assert s not in got
            continue
        c, pairs = Counter(ids), Counter(zip(ids, ids[1:]))
        r = got[s]
        top = sorted(c.items(), key=lambda t: (-t[1], t[0]))
        assert (r.n_windows, r.n_unique) == (len(ids), len(c))
        assert r.motif_entropy == pytest.approx(entropy(c), abs=1e-12) and r.effective_motif_count == pytest.approx(math.exp(entropy(c)))
        assert r.top_mass == pytest.approx(sum(n for _, n in top[:2]) / len(ids))
        assert r.repeat_rate == pytest.approx(sum(n for (a, b), n in pairs.items() if a == b) / (len(ids) - 1) if len(ids) > 1 else 0)
        div = entropy(pairs) / math.log(len(pairs)) if len(pairs) > 1 else 0
        assert r.motif_transition_diversity == pytest.approx(div, abs=1e-12)


def rqa(x, w, l_min, v_min):
    n = len(x)
    r = [[int(x[i] == x[j] and abs(i - j) > w) for j in range(n)] for i in range(n)]
    eligible = sum(abs(i - j) > w for i in range(n) for j in range(n))
    rec = sum(map(sum, r))

    def points(lines, least):
        return sum(len(list(g)) for line in lines for v, g in ((v, list(g)) for v, g in groupby(line)) if v and len(g) >= least)

    diagonals = [[r[i][i + d] for i in range(n) if 0 <= i + d < n] for d in range(-n + 1, n)]
    columns = [[r[i][j] for i in range(n)] for j in range(n)]
    return (rec / eligible if eligible else 0, points(diagonals, l_min) / rec if rec else 0, points(columns, v_min) / rec if rec else 0)


@pytest.mark.parametrize(("w", "l_min", "v_min"), [(1, 2, 2), (0, 3, 2), (2, 2, 3), (-1, 2, 2), (50, 2, 2)])
def test_recurrence(steps, w, l_min, v_min):
    d = steps.withColumnRenamed("pos", "at")
    for f in (recurrence.recurrence, recurrence.recurrence_by_sequence):
        got = {r.session_id: (r.rr, r.det, r.lam) for r in f(d, ("session_id",), theiler=w, l_min=l_min, v_min=v_min).collect()}
        for s, xs in CASES.items():
            if xs:
                assert got[s] == pytest.approx(rqa(xs, w, l_min, v_min)), (f.__name__, s)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.integers(0, 3), max_size=25), st.integers(-1, 3), st.permutations(range(4)))
def test_recurrence_of_any_sequence(xs, w, renamed):
    x = np.array(xs, int)
    assert recurrence.rr_det_lam(x, w) == pytest.approx(rqa(xs, w, 2, 2))
    assert recurrence.rr_det_lam(np.array(renamed)[x] if xs else x, w) == pytest.approx(recurrence.rr_det_lam(x, w))


def test_nulls_keep_what_they_should(steps):
    d = steps.withColumnRenamed("pos", "at")
    s = nulls.shuffled(d, ("session_id",), 3, seed=1)
    assert {(r.session_id, r.draw): r.n for r in s.groupBy("session_id", "draw").agg(F.sort_array(F.collect_list("x")).alias("n")).collect()} == {(k, j): sorted(v) for k, v in CASES.items() if v for j in range(3)}
    again = nulls.shuffled(d.repartition(5), ("session_id",), 3, seed=1)
    assert s.exceptAll(again).count() == 0
    m = nulls.markov_surrogates(d, ("session_id",), 4, seed=2).groupBy("session_id", "draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("xs")).collect()
    for r in m:
        xs = CASES[r.session_id]
        assert len(r.xs) == len(xs) and set(r.xs) <= set(xs)
        sinks = {xs[-1]} - set(xs[:-1])
        assert all((a, b) in set(zip(xs, xs[1:])) or a in sinks for a, b in zip(r.xs, r.xs[1:]))


def test_against_nulls(spark):
    d = spark.createDataFrame([(2.0, float(x)) for x in (1, 2, 3, 4)], "v double, n double")
    r = d.agg(*(c.alias(k) for k, c in nulls.against_nulls(F.col("v"), F.col("n")).items())).first()
    assert (r.z, r.p_hi, r.p_lo, r.p_two) == pytest.approx(((2 - 2.5) / np.std([1, 2, 3, 4]), 4 / 5, 3 / 5, 1.0))
    same = d.withColumn("n", F.lit(2.0)).agg(nulls.against_nulls(F.col("v"), F.col("n"))["z"].alias("z")).first()
    assert same.z == 0.0
