"""Null ids, repeated rows, clashing names, and texts longer than a block, for each operator that reads documents."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dyadflow.llm import chat, decontaminate, lines, near, phrases, quality, shards, toxicity

DOCS = "doc_id long, text string"


def clashing(d):
    """Columns more, of names that the operators use inside."""
    return d.withColumns({c: F.lit(k) for k, c in enumerate(("h1", "h2", "n", "pos", "key", "mark", "drop", "row", "lines", "words", "size", "shard", "rank", "part", "comp", "node", "bucket", "peek", "x", "y", "score", "label", "url2"))})


def test_lines_count_documents_by_id(spark):
    line = "the same line"
    rows = [(7, f"{line}\nrow {k}") for k in range(10)] + [(None, line)] * 12 + [(100 + k, "other\n" + " x" * 200_000) for k in range(8)] + [(200, "OTHER "), (201, None), (201, None)]
    got = lines.drop_frequent_lines(clashing(spark.createDataFrame(rows, DOCS).repartition(4))).collect()
    assert len(got) == len(rows)
    assert all(r.n_dropped == 0 for r in got if r.doc_id == 7 or r.doc_id is None or r.doc_id >= 200), "two ids have the line, nine ids have the other"
    rows.append((300, "other\nlast"))
    got = lines.drop_frequent_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got if r.n_dropped) == [(100 + k, 1) for k in range(8)] + [(200, 1), (300, 1)]
    assert {r.kept for r in got if r.doc_id == 300} == {"last"} and all(len(r.kept) == 400_000 for r in got if r.doc_id in range(100, 108))


def test_fingerprints_of_hot_and_large_ids(spark, monkeypatch):
    """An id with a third of all rows, equal rows, null ids, and ids that doubles can't hold, over many ranges."""
    monkeypatch.setattr(phrases, "RANGE_BYTES", 1 << 12)
    rows = [(7, f"hot {k} " + "ab c" * (k % 50)) for k in range(60)] + [(2**62 + k, f"text {k}") for k in range(60)] + [(None, "nothing"), (None, None), (3, "x y " * 90_000)]
    rows += [(2**62 + 5, "text 5")] * 20
    d = spark.createDataFrame(rows, DOCS).repartition(5)
    marks = {r.text: r.m for r in d.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("m")).distinct().collect()}
    want = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, marks[r[1]]))
    follow = {}
    for k, (i, t) in enumerate(want):
        follow.setdefault((i, t), []).append(want[(k + 1) % len(want)][1])
    expected = Counter()
    for (i, t), nexts in follow.items():
        for n in nexts:
            m = len(t) // 2
            expected[i, len(t), hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest()] += 1
    got = phrases.fingerprint_rows(clashing(d)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected


LONG = "alpha beta gamma " * 40_000  # more than two blocks
ODD = [(None, "null id text here now"), (None, None), (5, LONG), (5, LONG), (6, LONG + "delta"), (7, ""), (7, ""), (8, " \t\n"), (9, "one two three four five six seven"), (10, "one two three four five six seven"), (10, "another text of the same id"), (11, "é" * 300_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(ODD, DOCS).repartition(3))


def test_near_duplicates_of_odd_rows(spark, odd):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in ((t or "").split() for _, t in ODD)]
    comp = list(range(len(ODD)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {c: min((ODD[k][0] for k in range(len(ODD)) if comp[k] == c and ODD[k][0] is not None), default=None) for c in comp}
    want = Counter((i, len(s), least[comp[k]] if s else i) for k, ((i, _), s) in enumerate(zip(ODD, sets, strict=True)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(odd).collect()) == want


def test_decontamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "three FOUR five"), (1, "another text"), (None, "delta"), (2, None)], "item_id long, text string")
    for size in (1 << 20, 10):
        got = decontaminate.contamination(odd, bench, pass_bytes=size, keep_text=True).collect()
        assert Counter((r.doc_id, r.n_hit) for r in got) == Counter((i, 3 * (t or "").count("three four five") + 2 * (t or "").count("another text") + (t or "").count("delta")) for i, t in ODD)
        assert {r.cleaned for r in got if r.doc_id == 9} == {"one two  six seven"} and max(len(r.cleaned or "") for r in got) == len(LONG)


def test_sharding_of_odd_rows(odd):
    got = shards.shard_bytes(odd, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def plain_statistics(t):
    """The same numbers by regular expressions and counters."""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    low = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in w]
    if not w:
        return [0.0] * len(quality.STATISTICS)
    n = len(w)
    visible = len(re.findall(rb"[A-Za-z0-9\x80-\xff#$%&*@^~<>{}\[\]\\/+=_|!.,;:?]", t.encode()))
    kind = lambda p: len(re.findall(p, t.encode()))
    share = lambda x, y: math.asin(math.sqrt(min(max(x / y, 0), 1)))
    tri = [tuple(low[k : k + 3]) for k in range(n - 2)]
    letters = max(1, kind(rb"[A-Za-z]"))
    v = max(visible, 1)
    return [
        math.log1p(n), math.log1p(v / n), share(kind(rb"[A-Z]"), letters), share(kind(rb"[#$%&*@^~<>{}\[\]\\/+=_]"), v), share(kind(rb"\|"), n), share(kind(rb"!"), n), share(kind(rb"[0-9]"), v),
        share(kind(rb"[.,;:?]"), n), share(kind(rb"[\x80-\xff]"), v), math.log1p(len(set(low))) / math.log(n + 1), share(max(Counter(low).values()), n), share(sum(a == b for a, b in zip(low, low[1:])), max(n - 1, 1)),
        share(len(tri) - len(set(tri)), max(len(tri), 1)), share(kind(rb"\n"), n),
    ]


def test_statistics_are_those_of_a_plain_count():
    texts = [t for _, t in ODD] + ["A b\nA b c! | 12 #x,", "the the the", "É é. (x)\r\n\n", "x" * 300_000, "A B C D A B C D a b c d"]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_statistics(t or "") for t in texts], atol=1e-9)


def test_classifiers_of_odd_rows(spark, odd):
    """Repeated and contradictory labels of an id, labels without a row, and rows without one."""
    labels = clashing(spark.createDataFrame([(5, 1, 0), (5, 0, 1), (6, 1, 0), (7, 0, 1), (9, 1, 0), (10, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        got = scores(odd, labels, folds=1, held=1).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert len({r.score for r in got if r.doc_id in (5, 7) and r.doc_id == 5}) == 1


def test_toxicity_is_that_of_dense_cosines(spark):
    """Scores end to end against matrices of all terms."""
    r = np.random.default_rng(7)
    word = lambda: f"w{r.integers(40)}" + "long" * int(r.integers(2))
    rows = [(k, " ".join(word() for _ in range(int(r.integers(0, 12)))) + (" nasty" if k % 4 == 0 else "")) for k in range(120)]
    labels = [(k, int(k % 4 == 0)) for k in range(80)]
    got = {x.doc_id: x.score for x in toxicity.toxicity_scores(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"), folds=1, held=1, neighbours=5).collect()}
    bag = [Counter(w for x in t.split() for w in ([x, "<" + x[:5]] if len(x) > 5 else [x])) for _, t in rows]
    known = sorted(set().union(*bag[:80]))
    df = np.array([sum(t in b for b in bag) for t in known])
    y = np.array([c for _, c in labels])
    has = np.array([[t in b for t in known] for b in bag[:80]], float)
    p = has.mean(0)
    z = (has[y == 1].mean(0) - has[y == 0].mean(0)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / (y == 1).sum() + 1 / (y == 0).sum()))
    z[p >= 1] = 0
    weight = (np.log((1 + len(rows)) / (1 + df)) + 1) * (1 + np.abs(z))
    m = np.array([[1 + math.log(b[t]) if b[t] else 0 for t in known] for b in bag]) * weight
    norm = np.linalg.norm(m, axis=1)
    m = m / np.where(norm > 0, norm, 1)[:, None]
    bare = y[norm[:80] == 0]
    base = (bare.sum() + 0.5) / (len(bare) + 2)
    for k in range(len(rows)):
        cosines = np.where(norm[:80] > 0, m[:80] @ m[k], 0)
        order = np.argsort(-np.round(cosines, 9), kind="stable")
        fifth = np.round(cosines[order[4]], 9)
        if (np.round(cosines, 9) == fifth).sum() > (np.round(cosines[order[:5]], 9) == fifth).sum():
            continue  # a tie at the border
        votes = cosines[order[:5]] / (1.05 - np.minimum(cosines[order[:5]], 1))
        want = (votes @ y[order[:5]] + 0.5 * base) / (votes.sum() + 0.5) if votes.sum() else base
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "user", LONG), (1, 0, "user", LONG), (1, 1, "assistant", "é" * 300_000), (2, 0, None, None), (None, None, "assistant", "x")]
    d = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(d)).collect()}
    assert {c: r.n_turns for c, r in got.items()} == {1: 3, 2: 1, None: 1} and got[1].loss_chars == 300_000 and got[None].loss_chars == 1
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{LONG}\nuser\n{LONG}\nassistant\n{'é' * 300_000}\n".encode()).hexdigest()
