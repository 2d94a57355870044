"""The pipeline's stages on a small table, each against brute force on its own input."""

import corpus_pipeline
import numpy as np
from test_ops import brute_contamination, jaccard_components, words

from dyadflow.llm import mixing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    r, rows, labels = np.random.default_rng(2), [], []
    for k in range(150):
        w = words(int(r.integers(12, 80)), 300 + k)
        bad = k % 5 == 0
        rows.append((k, " ".join(f"{x}$$$ {x}***" if bad else x for x in w), "en", f"s{k % 3}", 0))
        labels.append((k, int(not bad), 0))
    rows += [(1000 + k, rows[k][1], "en", "s9", 0) for k in range(1, 30)]
    rows += [(2000, None, None, None, None), (2001, "", "de", "s0", 0)]
    items = [(1, " ".join(words(40, 300 + 7)[2:14])), (2, "x y")]
    for name, data, schema in (("documents", rows, DOCS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = ({x.doc_id: x for x in before.collect()}, {x.doc_id: x for x in docs.collect()})
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = seen["quality"]
    scores = {x.doc_id: x.predicted for x in quality.quality_scores(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert set(after) == {i for i, p in scores.items() if p}
    assert np.mean([i in after for i, q, _ in labels if q]) > 0.95 and not any(i in after for i, q, _ in labels if not q)
    before, after = seen["near_duplicates"]
    assert set(after) == {i for i, (_, c) in jaccard_components([(x.doc_id, x.text) for x in before.values()]).items() if c == i}
    before, after = seen["decontamination"]
    assert set(after) == {i for i, (_, n, _) in brute_contamination([(x.doc_id, x.text) for x in before.values()], items).items() if not n}
    assert 7 not in after
    before, after = seen["mixing"]
    drawn = {x.doc_id for x in mixing.mix(spark.createDataFrame(list(before.values()), DOCS)).where("__kept").collect()}
    assert set(after) == drawn and 0.5 < len(after) / len(before) <= 1
    before, after = seen["sharding"]
    assert set(after) == set(before) and {x.shard for x in after.values()} == set(range(16))
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(after)
