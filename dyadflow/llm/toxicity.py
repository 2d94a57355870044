"""Toxicity: nearest labelled examples by exact TF-IDF cosine, from a block-max inverted index (operator 8).

The examples are a bounded sample of the labelled rows (MAX_EXAMPLES a class; the bound is a parameter). The terms are
all words of those examples and the beginnings of longer ones; a document's other words, which no example has, aren't in
its vector. Document frequencies come from all documents. One pass over the texts counts them; the index over the
examples, bounded by their sample, is broadcast, and a second pass finds each document's neighbours exactly. Examples
reach the driver as term counts, never as texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm.bytetext import ALNUM, Words, blocks, mix, powers
from dyadflow.session import table

MAX_EXAMPLES, NEIGHBOURS, BLOCK = 4000, 15, 64
#: Terms of the index that are a matrix, and documents that are multiplied by it at once.
DENSE, TOGETHER = 1024, 64
#: What a cosine by single-precision products may be off by.
SLACK = 1e-4
#: Document frequencies that move as one value.
SLICE = 1 << 14
#: A word longer than this many bytes has its beginning, to the end of the code point there, as a term beside it.
PREFIX = 5


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) arrays: one for the words, one for the beginnings of longer words."""
    w = Words(data, offsets, ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), w.counts())
    yield row, w.hashes
    long = np.flatnonzero(w.ends - w.starts > PREFIX)
    start, end = w.starts[long], w.starts[long] + PREFIX
    for _ in range(3):
        end += (data[np.minimum(end, len(data) - 1)] & 0xC0 == 0x80) & (end < w.ends[long])
    p, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((w.low.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    yield row[long], mix((sums[end] - sums[start]) * inverse[start] + np.uint64(PREFIX))


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, y, text): the hashes of each row's terms, sorted, and their occurrences."""
    for batch in batches:
        hashes, times = [], []
        for a, b, data, offsets in blocks(batch["text"]):
            found = list(term_hashes(data, offsets))
            row, h = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            for k in range(b - a):
                e, n = np.unique(h[row == k], return_counts=True)
                hashes.append(e.tobytes())
                times.append(n.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(hashes, pa.binary()), pa.array(times, pa.binary())], ["doc_id", "y", "terms", "n"])


class Vocabulary:
    """Sorted hashes of terms. As they are hashes, their leading bits lead to within a few places of each."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        bits = max(8, len(terms).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(terms, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(terms)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms, and the terms' numbers."""
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        number = np.full(len(h), -1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            same = self.terms[here] == h[left]
            number[left[same]] = here[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        known = np.flatnonzero(number >= 0)
        return known, number[known].astype(np.int64)

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, occurrences), by row and term, of rows that have any term."""
        keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        width = max(1, len(self.terms))
        for a, _, data, offsets in blocks(texts):
            own = [np.zeros(0, np.int64)]
            for row, h in term_hashes(data, offsets):
                known, number = self.find(h)
                own.append((row[known] + a) * width + number)
            key, n = np.unique(np.concatenate(own), return_counts=True)
            keys.append(key)
            times.append(n)
        key = np.concatenate(keys)
        return key // width, key % width, np.concatenate(times)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


class BlockMaxIndex:
    """Vectors of the examples, in single precision, and their norms. The DENSE commonest terms are a matrix, multiplied by many
    documents at once; the others are postings by term. The products are off by less than SLACK. The blocks' largest ones
    bound the k-th cosine from below, and the few examples that can reach it get exact cosines in double precision."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_terms: int, block: int = BLOCK):
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), i))  # like with like
        self.block, self.labels = block, labels[order]
        self.n_blocks = -(-len(order) // block)
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)]).astype(np.float32)
        example = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        self.norm = np.sqrt(np.bincount(example, weight.astype(np.float64) ** 2, len(order)))
        often = np.sort(np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:DENSE])
        self.place = np.full(n_terms, -1, np.int32)
        self.place[often] = np.arange(len(often))
        at = self.place[term]
        d = at >= 0
        self.common = np.zeros((len(often), self.n_blocks * block), np.float32)
        self.common[at[d], example[d]] = weight[d]
        term, weight, example = term[~d], weight[~d], example[~d]
        by = np.lexsort((example, term))
        self.example, self.weight = example[by], weight[by]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])

    def all_nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of the queries (terms, weights), (examples, cosines) of the k nearest with a cosine over 0, ties by example
        number; exact, to 12 decimals."""
        for i in range(0, len(queries), TOGETHER):
            some = queries[i : i + TOGETHER]
            dense = np.zeros((len(some), len(self.common)), np.float32)
            for j, (t, w) in enumerate(some):
                at = self.place[t]
                dense[j, at[at >= 0]] = w[at >= 0]
            for (t, w), products in zip(some, dense @ self.common, strict=True):
                at = self.place[t]
                rare = at < 0
                lo, hi = self.start[t[rare]], self.start[t[rare] + 1]
                here = _ranges(lo, hi)
                scores = np.bincount(self.example[here], np.repeat(w[rare], hi - lo) * self.weight[here], len(products))
                about = scores + products
                ids = np.arange(len(self.labels))
                if self.n_blocks >= k:
                    most = np.partition(about.reshape(self.n_blocks, self.block).max(1), -k)[-k]
                    ids = np.flatnonzero(about[: len(ids)] >= most - SLACK)
                if len(ids) > k:
                    ids = ids[about[ids] >= np.partition(about[ids], -k)[-k] - SLACK]
                products = w[~rare] @ self.common[at[~rare][:, None], ids].astype(np.float64)
                got = np.round((scores[ids] + products) / self.norm[ids], 12)
                ids, got = ids[got > 0], got[got > 0]
                keep = np.lexsort((ids, -got))[:k]
                yield ids[keep], got[keep]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return next(self.all_nearest([(terms, weights)], k))


class Votes:
    """The index, with the terms' weights and the share of label 1 among examples without any term. A term's weight is its
    inverse document frequency times 1 + |z|, z being the two-proportion statistic of its examples of either label: no term
    is left out, and those that go with a label count for more."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, neighbours: int):
        """examples: (terms, occurrences, label)."""
        self.k = neighbours
        y = np.array([e[2] for e in examples], np.int64)
        term = np.concatenate([e[0] for e in examples] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(examples)), [len(e[0]) for e in examples])
        n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
        c1 = np.bincount(term, weights=y[row], minlength=len(idf))
        c0 = np.bincount(term, minlength=len(idf)) - c1
        p = (c1 + c0) / (n1 + n0)
        z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        z[p >= 1] = 0
        self.weights = idf * (1 + np.abs(z))
        vectors, labels, bare = [], [], []
        for t, n, label in examples:
            if len(t):
                vectors.append(self.vector(t, n))
                labels.append(label)
            else:
                bare.append(label)
        self.index = BlockMaxIndex(vectors, np.array(labels, np.int64), len(idf))
        self.base = (sum(bare) + 0.5) / (len(bare) + 2)

    def vector(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weights[terms] if len(terms) else np.zeros(0)
        return terms, w / np.linalg.norm(w) if len(w) else w

    def scores(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[tuple[int, float]]]]:
        """For each (terms, occurrences), the share of label 1 in votes weighted by cosine over distance, and (label, cosine) of
        the neighbours."""
        found = self.index.all_nearest([self.vector(*c) for c in counts if len(c[0])], self.k)
        for terms, _ in counts:
            ids, cosines = next(found) if len(terms) else ((), np.zeros(0))
            if not len(ids):
                yield self.base, []
                continue
            votes = cosines / (1.05 - np.minimum(cosines, 1))
            y = self.index.labels[ids]
            yield float((votes @ y + 0.5 * self.base) / (votes.sum() + 0.5)), list(zip(y.tolist(), cosines.tolist(), strict=True))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, label: str = "toxic", max_examples: int = MAX_EXAMPLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidence (label and cosine of the neighbours) for every row of docs(doc_id, text).

    Labels of rows whose crc32(doc_id as text) mod `folds` is `held` aren't looked at; of the others, at most
    max_examples of each class, the first in order of a hash of the id, are the examples. An id with several labels has
    the largest, and of several texts of an example's id one counts. Texts without any term (null,
    empty) and tables without usable labels get the share of label 1 among examples without terms, 1/4 with no
    examples. Repeated rows get the same score; a null id is in no fold; columns of other names aren't read; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    usable = labels.where((remainder != held) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sample = None
    for c in (0, 1):
        part = usable.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
        sample = part if sample is None else sample.unionByName(part)
    chosen = spark.createDataFrame([(r.doc_id, r.y) for r in sample.collect()], sample.schema)  # 2 * max_examples rows at most
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(_example_terms, f"doc_id {kind}, y int, terms binary, n binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("terms", "n", "y")).alias("e")).orderBy("doc_id")  # of repeated ids one text
    own = [(np.frombuffer(r.e.terms, np.uint64), np.frombuffer(r.e.n, np.int32), r.e.y) for r in found.toLocalIterator()]
    vocabulary = Vocabulary(np.unique(np.concatenate([e[0] for e in own] or [np.zeros(0, np.uint64)])))
    examples = [(vocabulary.find(h)[1], n, y) for h, n, y in own]
    known = sc.broadcast(vocabulary)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, df = 0, np.zeros(len(known.value.terms), np.int64)
        for batch in batches:
            rows += batch.num_rows
            df += np.bincount(known.value.counts(batch["text"])[1], minlength=len(df))
        if rows:
            parts = [np.array([rows]), *(df[i : i + SLICE] for i in range(0, len(df), SLICE))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch["slice"].to_pylist(), batch["n"].to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "n"])

    tallies = rows.select("text").mapInArrow(tally, "slice int, n binary").repartition("slice").mapInArrow(add, "slice int, n binary")
    df = np.concatenate([np.frombuffer(r.n, np.int64) for r in sorted(tallies.toLocalIterator(), key=lambda r: r.slice)] or [np.zeros(1, np.int64)])  # a number for each of the examples' terms
    total, df = df[0], df[1:] if len(df) > 1 else np.zeros(len(vocabulary.terms), np.int64)
    votes = sc.broadcast(Votes(examples, np.log((1 + total) / (1 + df)) + 1, neighbours))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, n = known.value.counts(batch["text"])
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            got = list(votes.value.scores([(term[a:b], n[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]))
            evidence = pa.array([[{"label": y, "cosine": c} for y, c in e] for _, e in got], pa.list_(pa.struct([("label", pa.int32()), ("cosine", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s for s, _ in got], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    scored = rows.mapInArrow(vote, f"doc_id {kind}, score double, evidence array<struct<label:int,cosine:double>>")
    return scored.select("doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")
