"""motif_shuffle_null and its operator: draws stay where their group is, and orders, metrics and comparisons are those of plain loops."""

import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadflow.operators import motifs, nulls
from dyadflow.plans import registry

DATA = Path("/root/testdata/sf0.001")
RNG = np.random.default_rng(5)
#: Symbols by group: none twice, one only, missing ones, too short for a window, long ones, no window but in some draws, none at all.
GROUPS = {
    "a": [0, 1, 0, 0, 2, 8, 2, 1, 0, 1, 0, 0],
    "b": [3] * 15,
    "c": [4, None, 4, 5, None, 5, 5, 4, 4],
    "d": [1],
    "e": RNG.integers(0, 2, 150).tolist(),
    "f": [None, 1, None, 2, None],
    "g": [None, 1, None],
    "h": [1, 2, 3, 4],
    "a group with a name that leaves no room for its draws in one block": [0, 1, 0, 0, 2, 2, 2, 1],
}


def plain(xs, k, top_n=5, base=9):
    ids = [sum(x * base ** (k - 1 - j) for j, x in enumerate(xs[i : i + k])) for i in range(len(xs) - k + 1) if None not in xs[i : i + k]]
    if not ids:
        return None
    c, pairs = Counter(ids), Counter(zip(ids, ids[1:]))
    entropy = lambda c: -sum(n / c.total() * math.log(n / c.total()) for n in c.values())
    e = entropy(c)
    diversity = entropy(pairs) / math.log(len(pairs)) if len(pairs) > 1 else 0.0
    return [e, math.exp(e), sum(sorted(c.values())[-top_n:]) / len(ids), sum(n for (a, b), n in pairs.items() if a == b) / max(len(ids) - 1, 1), diversity]


def wanted(name, xs, k, draws, seed):
    own = plain(xs, k)
    if own is None:
        return None
    null = [v for j in range(draws) if (v := plain([xs[i] for i in sorted(range(len(xs)), key=lambda i: hashlib.md5(f"{seed}|{name}|{j}|{i}".encode()).hexdigest())], k))]
    out = list(own)
    for m in range(5):
        u, v = np.array([round(x[m], 9) for x in null]), round(own[m], 9)
        up, down = (1 + (u >= v).sum()) / (len(u) + 1), (1 + (u <= v).sum()) / (len(u) + 1)
        out += [(v - u.mean()) / u.std() if u.std() > 1e-12 else 0.0, up, down, min(1, 2 * min(up, down))] if null else [None] * 4
    return out


@pytest.fixture(scope="module")
def steps(spark):
    return spark.createDataFrame([(g, i, x) for g, xs in GROUPS.items() for i, x in enumerate(xs)], "g string, at long, x int").repartition(3)


def check(steps, k, draws, seed):
    got = {r.g: [*r][1:] for r in nulls.motifs_against_shuffles(steps, ("g",), k, draws, seed=seed).collect()}
    want = {g: w for g, xs in GROUPS.items() if (w := wanted(g, xs, k, draws, seed))}
    assert got.keys() == want.keys()
    for g, row in want.items():
        assert [x is None for x in got[g]] == [x is None for x in row], g
        assert [x for x in got[g] if x is not None] == pytest.approx([x for x in row if x is not None], abs=1e-6), g


@pytest.mark.parametrize(("k", "draws"), [(1, 7), (2, 30), (3, 11), (12, 3)])
def test_like_plain_loops(steps, k, draws):
    check(steps, k, draws, 7)


def test_draws_in_parts_and_equal_beginnings(monkeypatch):
    """Few cells at once, and digests whose first bytes are all alike."""
    names = [b"7|x%d" % i for i in range(5)]
    want = [[sorted(range(12), key=lambda i: hashlib.md5(h + b"|%d|%d" % (j, i)).digest()) for j in range(3, 9)] for h in names]
    orders = nulls.Md5Orders(4, range(3, 9), np.arange(12))
    assert orders.of(names).tolist() == want
    first = nulls._first_words
    for fewer in (0, 0xF0000000):
        monkeypatch.setattr(nulls, "_first_words", lambda w, fewer=fewer: first(w) & np.uint32(fewer))
        assert orders.of(names).tolist() == want


def test_metrics_are_those_of_the_windows(spark, steps):
    """As motif_metrics() has them, which stays the general way."""
    d = steps.where("x is not null")
    d = d.withColumn("at", F.expr("row_number() over (partition by g order by at) - 1").cast("long"))
    for k in (1, 2):
        got = {r.g: [*r][1:6] for r in nulls.motifs_against_shuffles(d, ("g",), k, 2).collect()}
        want = {r.g: [r[m] for m in motifs.METRICS] for r in motifs.motif_metrics(motifs.motif_ids(d, k, ("g",)), k, ("g",)).collect()}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-9) for g in want)


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
def test_no_drawn_row_is_moved(spark):
    """Before, 200 rows a step went through sorts and joins, which filled the disk."""
    plan = registry.QUERIES["motif_shuffle_null"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Aggregate") == 1


def test_few_bytes_are_not_put_into_one_task(spark, steps):
    """A task's work is its steps times the draws, so their size says little."""
    few = nulls.motifs_against_shuffles(steps, ("g",), 2, 3)
    assert few.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
