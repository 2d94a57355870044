"""The ten operators and the pipeline against brute force, on small fixtures with the odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadflow.llm import bytetext, chat, decontaminate, html, html_blocks, html_model, lines, mixing, near, phrases, quality, rtree, shards, toxicity
from dyadflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 5000, n)]


def corpus():
    base = words(60, 1)
    rows = [None, "", "   \n\t", "one", "One", "a b c d", "a b c d e", "Ä Ö ü ß É Ñ", "x" * 3000, "\n\n\n"]
    rows += [" ".join(base)] * 3 + [" ".join(base).upper()]
    for k in range(12):  # near copies of near copies
        w = list(base)
        for j in range(k % 4):
            w[(7 * k + 13 * j) % 60] = f"edit{k}{j}"
        rows.append(" ".join(w))
    rows += [" ".join(words(n, n)) for n in (5, 9, 10, 11, 200, 3000)]
    rows += [f"Shared line\n{' '.join(words(20, 100 + k))}\n  shared LINE \t" for k in range(11)]
    return [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, 0) for k, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    # a clashing and a nested column more, which must not matter
    return spark.createDataFrame(corpus(), DOCS).repartition(3).withColumns({"key": F.lit("x"), "n": F.lit(1), "row": F.lit(2), "rank": F.array(F.lit(1)), "comp": F.lit(0), "bucket": F.lit(1), "part": F.lit(5)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def test_words_match_a_regular_expression():
    texts = ["", "A bÉ  c-d", " x ", "é", "0a\x0bZ"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for lut, pattern in ((bytetext.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (bytetext.NOT_SPACE, r"[^\x20\x09-\x0D]+")):
        w = bytetext.Words(np.frombuffer(raw, np.uint8), offsets, lut)
        want = [split(t, pattern) for t in texts]
        assert w.counts().tolist() == [len(x) for x in want]
        assert [w.text(i, i + 1).decode() for i in range(len(w))] == [x for ws in want for x in ws]
        by = defaultdict(set)
        for h, x in zip(w.hashes.tolist(), [x for ws in want for x in ws], strict=True):
            by[h].add(x)
        assert all(len(v) == 1 for v in by.values())


def test_line_dedup(docs, empty):
    got = {r.doc_id: r for r in lines.drop_frequent_lines(docs).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for _, t, *_ in corpus() for k in {key(x) for x in (t or "").split("\n")})
    for i, t, *_ in corpus():
        ls = (t or "").split("\n")
        stay = [x for x in ls if not (len(key(x)) >= 1 and seen[key(x)] >= 10)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(ls), len(ls) - len(stay), "\n".join(stay))
    assert sum(r.n_dropped for r in got.values()) == 22
    assert lines.drop_frequent_lines(empty).count() == 0


def jaccard_components(rows, width=5):
    sets = {}
    for i, t, *_ in rows:
        w = split(t, r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for x in range(len(ids)):
        for y in ids[x + 1 :]:
            a, b = sets[ids[x]], sets[y]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                lo, hi = sorted((comp[ids[x]], comp[y]))
                comp = {k: lo if v == hi else v for k, v in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def test_near_duplicates(docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs).collect()}
    assert got == jaccard_components(corpus())
    assert near.near_duplicates(empty).count() == 0


def test_near_duplicates_of_many_copies_and_common_passages(spark, monkeypatch):
    """Common elements, chunks and the tree's search all come in."""
    for name, value in (("COMMON", 6), ("COMMON_HERE", 2), ("CHUNK", 8), ("CROWD", 4)):
        monkeypatch.setattr(near, name, value)
    r = np.random.default_rng(3)
    shared, rows = " ".join(words(50, 7)), []
    for k in range(50):  # a passage that unlike documents share
        rows.append(f"{shared} {' '.join(words(int(r.integers(0, 90)), 1000 + k))}")
    for g in range(4):
        base = words(40, 50 + g)
        for _ in range(25):
            w = list(base)
            for j in r.integers(0, 40, r.integers(0, 4)):
                w[j] = f"e{r.integers(1 << 30)}"
            rows.append(" ".join(w))
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(rows)]
    got = near.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(2)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == jaccard_components(rows)


def test_count_tree_loses_no_pair():
    r = np.random.default_rng(0)
    sets = [set(r.integers(0, 400, r.integers(1, 80)).tolist()) for _ in range(150)]
    sets += [set(list(s)[: max(1, int(len(s) * 0.9))]) for s in sets]
    points = np.stack([np.bincount([x % 16 for x in s], minlength=16) for s in sets])
    tree = rtree.CountTree(points.astype(np.uint8), 80)
    found = {(i, int(j)) for i, q in enumerate(points) for j in tree.search(q)[0]}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b)}
    assert want <= found and len(found) < len(sets) ** 2 / 4


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in components(e).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90}
    assert components(e.limit(0)).count() == 0


def brute_contamination(rows, items, size=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = {}
    item_words = {str(i): split(t, pattern) for i, t in items}
    for i, t, *_ in rows:
        w = split(t, pattern)
        hit, found = set(), set()
        for item, b in item_words.items():
            n = min(size, len(b))
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(item)
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("pass_bytes", [1 << 20, 200])
def test_decontamination(spark, docs, empty, pass_bytes):
    w = words(3000, 3000)
    items = [(1, " ".join(w[100:125]).upper()), (2, " ".join(w[110:119])), (10, "One"), (3, None), (4, "..."), (5, " ".join(w[2990:3000])), (6, "nothing of this occurs here at all is it so or not")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in decontaminate.contamination(docs, bench, pass_bytes=pass_bytes).collect()}
    assert got == brute_contamination(corpus(), items)
    kept = {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}
    assert kept == {i for i, v in got.items() if not v[1]}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_removes_spans(spark):
    d = spark.createDataFrame([(1, "Start: a B, c! end")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert decontaminate.contamination(d, b, keep_text=True).first().cleaned == "Start: a ! end"


def test_sharding(docs, empty):
    got = sorted(shards.shard_bytes(docs, 5).collect(), key=lambda r: r.doc_id)
    text = {i: (t or "").encode() for i, t, *_ in corpus()}
    total = sum(len(t) + 1 for t in text.values())
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "bytes", None)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert [r.shard for r in got] == sorted(r.shard for r in got)
    assert all(s == list(range(len(s))) for s in slots.values())
    assert all(abs(s - total / 5) <= max(map(len, text.values())) + 1 for s in sizes.values())
    assert shards.shard_bytes(empty).count() == 0


def test_mixing_meets_its_targets(spark, empty):
    rows = [(k, " ".join(["w"] * (5 + k % 7)), ("en", "de")[k % 2], "big" if k % 3 else "small", 0) for k in range(600)] + [(-1, None, None, None, 0)]
    d = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(d, {"source": {"big": 1, "small": 1}, "lang": {"en": 1, "de": 1}}, rate=0.4, sweeps=30).collect()
    mass = defaultdict(float)
    for r in got:
        mass[r.source] += r.__getitem__("__prob") * r["__tokens"]
        mass[r.lang] += r["__prob"] * r["__tokens"]
        assert 0 <= r["__prob"] <= 1
    total = 0.4 * sum(r["__tokens"] for r in got)
    assert all(abs(mass[m] - total / 2) < 0.02 * total for m in ("big", "small", "en", "de"))
    assert next(r for r in got if r.doc_id == -1)["__kept"]
    kept = sum(r["__tokens"] for r in got if r["__kept"])
    assert abs(kept - total) < 0.2 * total
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(d).columns == d.columns


def lz78(text):
    seen, out, at = set(), [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end] in seen:
            end += 1
        out.append(end)
        seen.add(text[at:end])
        at = end
    return out


def test_phrases_match_a_plain_parse():
    for t in ("", "a", "aaaaaaaa", "abababab", "Ünïcödé Ünïcödé", " ".join(words(300, 2))):
        codes, cuts = phrases._codes(t), []
        if phrases._parse(codes.tolist(), 0, {}, 0, cuts):
            cuts.append(len(codes))
        assert cuts == lz78(t)


def test_fingerprints(spark, docs, empty):
    got = {r.doc_id: r for r in phrases.fingerprint_rows(docs).collect()}
    text = {i: t or "" for i, t, *_ in corpus()}
    ids = sorted(text)
    prints = dict(zip(ids, phrases.fingerprints([text[i] for i in ids]), strict=True))
    for k, i in enumerate(ids):
        after = ids[(k + 1) % len(ids)]
        m = len(text[i]) // 2
        edited = text[i][: len(text[i]) - m] + text[after][:m]
        e = phrases.fingerprints([edited])[0]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == prints[i].astype(">u2").tobytes().hex() and r.edited_fingerprint == e.astype(">u2").tobytes().hex()
        assert r.near_edited == (prints[i] == e).mean() and r.near_next == (prints[i] == prints[after]).mean()
    assert phrases.fingerprint_rows(empty).count() == 0
    one = phrases.fingerprint_rows(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())


def test_likeness_follows_shared_phrases():
    a, b = " ".join(words(3000, 5)), " ".join(words(3000, 6))
    f = phrases.fingerprints([a, a, a[: len(a) // 2] + b[: len(b) // 2], b])
    near_, far = (phrases.likeness(f[:1], f[k : k + 1])[0] for k in (2, 3))
    assert phrases.likeness(f[:1], f[1:2])[0] == 1 and near_ > far


TEXTS = [chat.FORGED, "", None, "\\", "a\\b [\\INST]", "<</s>", "<<SYS>>\\\\<s>", "plain é \U0001f600", "x " * 500]


def test_escape_is_reversible():
    for t in TEXTS:
        e = chat.escape(t or "")
        assert chat.unescape(e) == (t or "")
        assert not any(c in e for c in chat.CONTROLS)


def test_chat_round_trip(spark):
    rows = [(1, k, ("user", "assistant", "system", "tool", None)[k % 5], t) for k, t in enumerate(TEXTS)]
    rows += [(2, 0, "assistant", "only"), (3, None, "user", "x"), (3, None, "user", "x"), (None, 1, "assistant", "y")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for size in (1 << 16, 7):  # parts that end anywhere
        got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(d, part_tokens=size)).collect()}
        for c in (1, 2, 3, None):
            own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
            turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
            loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
            assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
            assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(d.limit(0))).count() == 0


def test_blocks_of_odd_markup():
    text = lambda p: [b.text for b in html_blocks.blocks_of(p)]
    assert text("") == [] and text("plain &amp; <3 more") == ["plain & <3 more"]
    assert text("<p>a<p><b>b<br>c<p>d</div></p>") == ["a", "b c", "d"]
    assert text("<script>x='<p>no</p>'</script>y<style>z") == ["y"]
    assert text("<ul><li>a<li>b<ul><li>c</ul>d</ul>e<!-- <p>f --><td>g") == ["a", "b", "c", "d", "e", "g"]
    assert text("<a href='x>y'>t</a><img alt=q>\n  u &#233;&nbsp;v") == ["t u é v"]
    assert text("<div " + "<div>" * 2000 + "deep") == ["deep"]


def test_block_labeller_on_pages_it_has_not_seen():
    model, made = html_model.trained(), html_model.Generator(1234)
    pages = [made.page() for _ in range(200)]
    p = np.concatenate(model.label([html_model.features(b) for b, _ in pages]))
    y = np.concatenate([y for _, y in pages])
    assert ((p >= 0.5) == (y > 0.5)).mean() > 0.95


def test_gradients_match_differences():
    made = html_model.Generator(2)
    pages = [(html_model.features(b), y) for b, y in (made.page() for _ in range(3))]
    x, mask = html_model.padded([f for f, _ in pages])
    y = np.zeros(mask.shape, np.float32)
    for k, (_, own) in enumerate(pages):
        y[: len(own), k] = own
    model = html_model.BlockLabeller(3, 4)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}

    def loss():
        z = model.logits(x, mask)[0]
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    g = model.gradients(x, mask, y)
    for name in ("fx", "bh", "f0", "o", "c"):
        flat = model.w[name].reshape(-1)
        k = int(np.argmax(np.abs(g[name].reshape(-1))))
        at, e = flat[k], 1e-3
        flat[k] = at + e
        up = loss()
        flat[k] = at - e
        down = loss()
        flat[k] = at
        assert abs((up - down) / (2 * e) - g[name].reshape(-1)[k]) < 2e-3


def test_html_extraction(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=/a>menu</a></ul></nav><div class=ad>buy this now</div><article><h1>Title here</h1><p>First  paragraph\nof the text, with words.</p><p>Second &amp; last paragraph of it.</article><footer>&copy; us 2024</footer></body>"
    d = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (3, "v", "")], "page_id long, url string, html string")
    got = html.extract(d).collect()
    assert [r.text for r in got if r.page_id == 1] == ["Title here\nFirst paragraph of the text, with words.\nSecond & last paragraph of it."] * 2
    assert [r.text for r in got if r.page_id != 1] == ["", ""]
    assert html.extract(d.limit(0)).count() == 0


def labelled(kind):
    r, rows, labels = np.random.default_rng(9), [], []
    for k in range(240):
        w = words(int(r.integers(5, 120)), 7000 + k)
        bad = k % 3 == 0
        if kind == "quality":
            text = " ".join(f"{x}$$$ {x}###" if bad else x for x in w)
        else:
            text = " ".join([*w, *(["vileword", "nastyword"] if bad else [])])
        rows.append((k, text))
        labels.append((k, int(not bad), int(bad)))
    return rows + [(900, None), (901, ""), (None, "x")], labels


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    rows, labels = labelled("quality" if kind == "quality" else "toxic")
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, None, None)], "doc_id long, quality int, toxic int")
    score, folds, held = (quality.quality_scores, 3, 1) if kind == "quality" else (toxicity.toxicity_scores, 5, 0)
    got = score(d, y).collect()
    assert len(got) == len(rows)
    truth = {i: q if kind == "quality" else t for i, q, t in labels}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.95
    flipped = y.withColumn(kind, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, 1 - F.col(kind)).otherwise(F.col(kind)))
    assert {r.doc_id: r.score for r in score(d, flipped).collect()} == pytest.approx({r.doc_id: r.score for r in got}), "held-out labels aren't looked at"
    assert score(d, y.limit(0)).count() == len(rows) and score(d.limit(0), y).count() == 0


def test_block_max_index_is_exact():
    r = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        t = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        w = r.random(len(t))
        vectors.append((t, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(vectors, np.zeros(500, np.int64), 40)
    dense = np.zeros((500, 40))
    order = sorted(range(500), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))
    for k, i in enumerate(order):
        dense[k, vectors[i][0]] = vectors[i][1]
    for t, w in vectors[:60]:
        ids, cosines = index.nearest(t, w, 10)
        q = np.zeros(40)
        q[t] = w
        assert np.allclose(np.sort(cosines)[::-1], np.sort(dense @ q)[::-1][:10])
        assert np.allclose(dense[ids] @ q, cosines)


def test_discriminant_matches_a_direct_density():
    r = np.random.default_rng(5)
    x = [r.normal(0, 1, (300, 3)), r.normal(1, 2, (200, 3))]
    sums = [np.array([len(a) for a in x]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x])]
    m = quality.Discriminant.fit(*sums, to_pooled=0, to_diagonal=0)
    p = r.normal(0.5, 1, (20, 3))

    def density(a):
        c, d = np.cov(a.T, bias=True), p - a.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]

    want = 1 / (1 + np.exp(-(density(x[1]) - density(x[0]) + np.log(m.prior / (1 - m.prior))) / m.temperature))
    assert np.allclose(m.score(p), want)
