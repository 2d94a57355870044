"""Operators where a cap, a prefix or a shortcut once left part of the job out."""

import numpy as np

from dyadflow.llm import decontaminate, html_blocks, near, toxicity


def test_toxicity_finds_an_example_of_rare_words(spark):
    """Words of one labelled example, and of no other, are terms, and a document that is like none of the toxic ones has neighbours."""
    common = [f"word{k}" for k in range(30)]
    r = np.random.default_rng(1)
    rows = [(k, " ".join(r.choice(common, 12)) + f" own{k} more{k} rest{k}") for k in range(60)]
    labels = [(k, int(k in (3, 8))) for k in range(60)]
    copies = [(1000 + k, t) for k, t in rows] + [(2000, rows[3][1]), (2001, "zzz qqq"), (2002, None)]
    d = spark.createDataFrame(rows + copies, "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.toxicity_scores(d, spark.createDataFrame(labels, "doc_id long, toxic int"), folds=1, held=1).collect()}
    assert len(got) == len(rows) + len(copies)
    for k, _ in rows:
        assert got[1000 + k].predicted == int(k in (3, 8)) and got[1000 + k].score == got[k].score
        assert got[1000 + k].evidence[0].cosine > 1 - 1e-9 and got[1000 + k].evidence[0].label == int(k in (3, 8))
    assert got[2000].predicted == 1 and not got[2001].evidence and not got[2002].evidence


def test_near_duplicates_whose_copies_lie_in_two_partitions(spark):
    """All shingles are common, as they are documents too, and each set comes from both partitions."""
    half = []
    for g in range(6):
        w = [f"g{g}x{k}" for k in range(9)]
        half += [" ".join(w), " ".join(w[:8]), *(" ".join(w[k : k + 5]) for k in range(5)), *(" ".join(w[k : k + 5]) for k in range(5))]
    rows = list(enumerate(half * 2))
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    want = lambda i: 0 if i % 12 < 2 else 2 + (i % 12 - 2) % 5
    assert {r.doc_id: r.component_id for r in near.near_duplicates(d).collect()} == {i: i % 72 // 12 * 12 + want(i) for i, _ in rows}


def test_html_matches_end_tags_beyond_many_open_elements():
    of = lambda page: {b.text: [t for t, _ in b.path] for b in html_blocks.blocks_of(page)}
    assert of("<nav>menu" + "<b>" * 300 + "</nav><p>main")["main"] == ["p"]
    assert of("<b>" * 300 + "<nav>menu</nav><p>main")["menu"][-1] == "nav"
    assert of("<ul><li>one" + "<i>" * 100 + "<li>two")["two"] == ["ul", "li"]
    assert of("<main>" + "<div>" * 400 + "deep" + "</div>" * 400 + "end")["end"] == ["main"]
    assert html_blocks.blocks_of('<div class="' + "mt4 " * 20 + '" id=comments>x')[0].path[0][1][-1] == "comments"
    assert list(of("\u0130<SCRIPT>no</SCRIPT><p>main")) == ["\u0130", "main"]


def test_decontamination_in_many_passes_is_that_of_one(spark):
    w = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(w[5:17])), (2, " ".join(w[12:25])), (3, "tiny item")], "item_id long, text string")
    hit = "\u00e9, " + "; ".join(w) + " a Tiny  item!"
    rows = [(1, hit), (1, hit), (1, "clean"), (None, hit), (None, None), (None, None), (4, ""), (5, "tiny item")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, many = (decontaminate.contamination(d, bench, pass_bytes=b, keep_text=True).collect() for b in (1 << 20, 60))
    assert sorted(map(repr, many)) == sorted(map(repr, one)) and len(many) == len(rows)
    assert sum(r.cleaned is not None for r in many) == 4
    assert len(decontaminate.contamination(d, bench, pass_bytes=60).collect()) == len(rows)
