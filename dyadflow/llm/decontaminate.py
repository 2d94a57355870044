"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned for in all texts (operator 4)."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm.bytetext import ALNUM, Words, blocks
from dyadflow.llm.rows import without
from dyadflow.session import table

WINDOW = 10
#: Bytes of benchmark text in one broadcast, some six times as many in memory; a larger benchmark is scanned for in several passes.
PASS_BYTES = 32 << 20
_BITS = 22


class Windows:
    """The windows of some benchmark items: for each length sorted hashes with a bit table before them, each hash with its first
    word's number; and the items' lowered texts with the words' places, to verify hits. Numbers and texts are arrays: 28
    bytes a word beside the texts."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.items = [i for i, _ in items]
        low, starts, ends, counts, base, words = [], [], [], [], 0, 0
        hashes: dict[int, list[np.ndarray]] = defaultdict(list)
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        for _, _, data, offsets in blocks(pa.array([t for _, t in items], pa.large_string())):
            w = Words(data, offsets, ALNUM)
            n = w.counts()
            for length in np.unique(np.minimum(n, size)[n > 0]).tolist():
                if length == size:
                    at = np.flatnonzero(w.whole(size))
                else:
                    at = w.first[:-1][n == length]
                hashes[length].append(w.windows(length)[at])
                places[length].append(at + words)
            low.append(w.low)
            starts.append(w.starts + base)
            ends.append(w.ends + base)
            counts.append(n)
            base, words = base + len(data), words + len(w)
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        self.low, self.starts, self.ends = (join(low).astype(np.uint8), join(starts), join(ends))
        self.first = np.concatenate([[0], np.cumsum(join(counts))])
        self.hashes, self.places, self.bits, self.shift = {}, {}, {}, {}
        for length in hashes:
            h, at = np.concatenate(hashes[length]), np.concatenate(places[length])
            order = np.argsort(h, kind="stable")
            self.hashes[length], self.places[length] = h[order], at[order].astype(np.int32)
            bits = min(_BITS, max(10, len(h).bit_length() + 5))
            self.shift[length] = np.uint64(64 - bits)
            self.bits[length] = np.zeros(1 << bits, bool)
            self.bits[length][h >> self.shift[length]] = True

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1 with a blank between."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True))

    def hits(self, w: Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) for each occurrence, verified word by word."""
        for n, known in self.hashes.items():
            got = w.windows(n)
            here = np.flatnonzero(self.bits[n][got >> self.shift[n]])
            if not len(here):
                continue
            lo = np.searchsorted(known, got[here])
            here, lo = here[lo < len(known)], lo[lo < len(known)]
            same = known[lo] == got[here]
            here, lo = here[same], lo[same]
            inside = w.whole(n)[here]
            here, lo = here[inside], lo[inside]
            hi = np.searchsorted(known, got[here], "right")
            verified: dict[tuple[int, bytes], set[str]] = {}
            for i, a, b in zip(here.tolist(), lo.tolist(), hi.tolist(), strict=True):
                text = w.text(i, i + n)
                if (a, text) not in verified:
                    at = [p for p in self.places[n][a:b].tolist() if self.text(p, p + n) == text]
                    verified[a, text] = {self.items[k] for k in (np.searchsorted(self.first, at, "right") - 1).tolist()}
                if items := verified[a, text]:
                    yield i, n, items


def _without(runs: list[tuple[int, int]], w: Words, k: int, data: np.ndarray, offsets: np.ndarray) -> str:
    """Row k's text without these half-open runs of its words."""
    raw, kept, at = data[offsets[k] : offsets[k + 1]].tobytes(), [], 0
    for x, y in runs:
        s, e = int(w.starts[w.first[k] + x] - offsets[k]), int(w.ends[w.first[k] + y - 1] - offsets[k])
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]]).decode()


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over merged rows with text: the text without the spans, null where there are none."""
    for batch in batches:
        cleaned, spans = [], batch["spans"].to_pylist()
        for a, b, data, offsets in blocks(batch["text"]):
            w = Words(data, offsets, ALNUM)
            for k in range(b - a):
                cleaned.append(_without([(x["a"], x["b"]) for x in spans[a + k]], w, k, data, offsets) if spans[a + k] else None)
        columns = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(cleaned, pa.string())], [*columns, "cleaned"])


def _scan(known, keep_text: bool):
    """For mapInArrow over (doc_id, text): spans of hit words and the items found; with keep_text the text without them too."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = known.value
        for batch in batches:
            n_words, n_hit, found, spans, cleaned = [], [], [], [], []
            for a, b, data, offsets in blocks(batch["text"]):
                w = Words(data, offsets, ALNUM)
                change = np.zeros(len(w) + 1, np.int64)
                items = [set() for _ in range(b - a)]
                for i, n, which in windows.hits(w):
                    change[i] += 1
                    change[i + n] -= 1
                    items[int(np.searchsorted(w.first, i, "right")) - 1] |= which
                hit = np.cumsum(change[:-1]) > 0
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_words += w.counts().tolist()
                per_row = sums[w.first[1:]] - sums[w.first[:-1]]
                n_hit += per_row.tolist()
                found += [sorted(x) for x in items]
                for k in range(b - a):
                    if not per_row[k]:
                        spans.append([])
                        cleaned.append(None)
                        continue
                    lo, hi = w.first[k], w.first[k + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype(np.int8)))
                    runs = edge.reshape(-1, 2)
                    spans.append([{"a": int(x), "b": int(y)} for x, y in runs])
                    if keep_text:
                        cleaned.append(_without(runs.tolist(), w, k, data, offsets))
                    else:
                        cleaned.append(None)
            columns = [batch["doc_id"], batch["row"], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(cleaned, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_words", "n_hit", "items", "spans", "cleaned"])

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES, keep_text: bool = False) -> DataFrame:
    """Every row of docs(doc_id, text) with n_words, n_hit, items (array of item ids as strings, sorted), spans (half-open runs of
    hit words) and, with keep_text, `cleaned`: the text without its hit spans (null where nothing was hit).

    Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z is lowered; null or empty texts have none. Items with
    fewer than `window` words, but not none, count as one window. Repeated items and rows each count. Columns of other names
    aren't read. The benchmark's size is measured first: up to pass_bytes it is one broadcast and one pass that shuffles
    nothing; a larger one is cut by a hash of the item, scanned for in as many passes, the passes' spans are merged by id and
    text, joined to all rows and, with keep_text, cut from the texts. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_bytes))
    rows = docs.select("doc_id", F.lit(0).cast("long").alias("row") if passes == 1 else F.xxhash64("text").alias("row"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, n_words long, n_hit long, items array<string>, spans array<struct<a:long,b:long>>, cleaned string"
    out = []
    for k in range(passes):
        part = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
        part = part if passes == 1 else part.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        known = spark.sparkContext.broadcast(Windows([(r.item_id or "", r.text) for r in part.collect()], window))  # pass_bytes bounds it
        out.append(rows.mapInArrow(_scan(known, keep_text and passes == 1), schema))
    if passes == 1:
        return out[0].drop("row")
    merged = out[0]
    for x in out[1:]:
        merged = merged.unionByName(x)
    merged = merged.groupBy("doc_id", "row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))
    union = F.aggregate(
        "s",
        F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.withColumn("spans", union).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"]))
    merged = merged.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), "n_words", "n_hit", "items", "spans")
    every = rows if keep_text else rows.drop("text")
    every = every.join(merged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")))
    if not keep_text:
        return every.select("doc_id", "n_words", "n_hit", "items", "spans", F.lit(None).cast("string").alias("cleaned"))
    return every.select("doc_id", "n_words", "n_hit", "items", "spans", "text").mapInArrow(_cut_spans, schema.replace(" row long,", ""))


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, without those in which any window of the benchmark occurs."""
    return without(docs, contamination(docs, benchmark, window).where("n_hit > 0"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_CHARS = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_CHARS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_CHARS}') AS w FROM benchmark),
bw AS (SELECT DISTINCT cast(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM d, (SELECT DISTINCT n FROM bw) AS ns, unnest(range(1, greatest(1, len(w) - n + 2))) AS t(i)),
hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
