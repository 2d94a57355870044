"""Raking against its goals, contradictory goals, and odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadflow.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CELL = "source string, lang string, topic string, total long"


def cells(spark, seed=0):
    r = np.random.default_rng(seed)
    rows = [(f"s{s}", f"l{k}", f"t{t}", int(r.integers(0, 2000) * 10 ** r.integers(0, 3))) for s in range(4) for k in range(3) for t in range(4) if r.random() < 0.8]
    return spark.createDataFrame(rows, CELL)


@pytest.mark.parametrize("bound", [100_000, 0])
def test_every_margin_meets_its_goal(spark, monkeypatch, bound):
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", bound)
    c = cells(spark)
    total = c.agg(F.sum("total")).first()[0]
    for targets in ({}, {"source": {"s0": 1, "s1": 1, "s2": 1, "s3": 1}}):
        got = mixing.rake(c, targets, 0.4, sweeps=40, tolerance=1e-4).collect()
        assert all(0 <= r.prob <= 1 and r.residual <= 1e-4 for r in got)
        for m in mixing.MARGINS:
            mass, goal, has = Counter(), {}, Counter()
            for r in got:
                mass[r[m]] += r.prob * r.total
                has[r[m]] += r.total
                goal[r[m]] = r[f"goal_{m}"]
            assert sum(goal.values()) == pytest.approx(0.4 * total)
            assert all(goal[v] <= has[v] * (1 + 1e-9) and mass[v] == pytest.approx(goal[v], rel=0.01) for v in goal)
            if m in targets:  # equal, but for those that give all they have
                rest = [g for v, g in goal.items() if g < has[v] * (1 - 1e-9)]
                assert max(rest) == pytest.approx(min(rest)) and all(g <= min(rest) * (1 + 1e-9) for g in goal.values())


def test_goals_that_contradict_each_other_leave_a_residual(spark):
    c = spark.createDataFrame([("a", "en", "t", 100), ("b", "de", "t", 100)], CELL)
    got = mixing.rake(c, {"source": {"a": 3, "b": 1}, "lang": {"en": 1, "de": 3}}, 0.5, sweeps=20).collect()
    assert all(r.residual > 0.1 and 0 <= r.prob <= 1 for r in got)


def test_budgets_shrink_to_what_named_values_have(spark):
    c = spark.createDataFrame([("a", "en", "t", 100), ("b", "en", "t", 900)], CELL)
    got = {r.source: r.prob for r in mixing.rake(c, {"source": {"a": 1}}, 0.8).collect()}
    assert got == {"a": pytest.approx(1), "b": 0}
    assert mixing.rake(c.limit(0)).count() == 0


def brute_topics(texts):
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in texts]
    terms = [Counter(w[:5] for w in ws if len(w) > 5) for ws in words]
    df = Counter(t for c in terms for t in c)
    chosen = sorted((t for t in df if df[t] * mixing.RARE <= len(texts)), key=lambda t: (-df[t], t))[: mixing.TOPICS]
    out = []
    for ws, c in zip(words, terms, strict=True):
        best = max(chosen, key=lambda t: (c[t], -chosen.index(t)), default=None)
        out.append(("empty" if not ws else best if best and c[best] else "other", len(ws)))
    return chosen, out


def test_topics_are_those_of_a_plain_count(spark):
    r = np.random.default_rng(1)
    texts = [" ".join(f"q{x:02d}zzé" for x in r.integers(0, 90, 6)) for _ in range(120)]
    texts += [None, "", " \t", " lead", "trail\n", " ", "x" * 300_000 + " yyyyyyy " * 40_000]
    d = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS).repartition(3)
    chosen, want = brute_topics(texts)
    assert mixing.topics(d) == chosen and len(chosen) == mixing.TOPICS
    got = {x.doc_id: (x["__topic"], x["__tokens"]) for x in mixing.mix(d).collect()}
    assert got == dict(enumerate(want))


def test_clashing_names_repeated_rows_and_nulls(spark):
    rows = [(k % 40, "some words of text here" * (k % 5), ("en", None)[k % 2], "s", 0) for k in range(80)] + [(None, None, None, None, None), (7, "", "en", "s", 0)] * 2
    d = spark.createDataFrame(rows, DOCS).withColumns({"__source": F.lit("mine"), "__PROB": F.lit(7), "words": F.lit("w"), "total": F.array(F.lit(1)), "q": F.lit(0)})
    assert mixing.free_prefix(d.columns) == "___"
    out = mixing.mix(d).collect()
    assert len(out) == len(rows) and all(r["__source"] == "mine" and r["__PROB"] == 7 and 0 <= r["___prob"] <= 1 for r in out)
    fate = defaultdict(set)
    for r in out:
        fate[r.doc_id, r.text, r.lang].add(r["___kept"])
    assert all(len(v) == 1 for v in fate.values())
    kept = mixing.mixed_documents(d)
    assert kept.columns == d.columns and {r["__source"] for r in kept.collect()} == {"mine"}
    assert mixing.mixed_documents(d.limit(0)).count() == 0
