"""Quality classifier: regularised quadratic discriminant over transformed document statistics (operator 7).

One pass over the texts makes a dozen statistics a document; they are written once, and all else is narrow. Class
counts, sums and cross products are sums of task partials, so fitting takes every labelled row outside the held-out
fold and sends two small matrices to the driver, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm.bytetext import NOT_SPACE, Words, blocks
from dyadflow.llm.rows import without
from dyadflow.session import cut, table

STATISTICS = ("words", "word_length", "upper", "symbols", "bars", "shouts", "digits", "stops", "beyond_ascii", "distinct", "top_word", "twice", "trigrams_again", "lines")
TO_POOLED, TO_DIAGONAL, TEMPERATURE = 0.1, 0.02, 3.0

_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _c in b"#$%&*@^~<>{}[]\\/+=_":
    _CLASS[_c] = 5
_CLASS[ord("|")], _CLASS[ord("!")], _CLASS[10] = 6, 7, 8
for _c in b".,;:?":
    _CLASS[_c] = 9


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text, transformed: logarithms of sizes, arc sines of the roots of shares. A null or
    empty text, and one of white space only, has zeros."""
    out = []
    for a, b, data, offsets in blocks(texts):
        k = b - a
        lengths = np.diff(offsets)
        row = np.repeat(np.arange(k), lengths)
        chars = np.bincount(row * 10 + _CLASS[data], minlength=k * 10).reshape(k, 10)
        w = Words(data, offsets, NOT_SPACE)
        n = w.counts()
        of = np.repeat(np.arange(k), n)

        def kinds(hashes: np.ndarray, rows: np.ndarray, k: int = k) -> tuple[np.ndarray, np.ndarray]:
            """Distinct hashes of each row, and how often its commonest occurs."""
            order = np.lexsort((hashes, rows))
            h, r = hashes[order], rows[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, int)
            most = np.zeros(k, np.int64)
            np.maximum.at(most, r[first], np.diff(np.append(first, len(h))))
            return np.bincount(r[first], minlength=k), most

        distinct, most = kinds(w.hashes, of)
        again = w.whole(2)
        twice = np.bincount(of[: len(again)][again & (w.hashes[:-1] == w.hashes[1:])], minlength=k) if len(w) > 1 else np.zeros(k)
        three = w.whole(3)
        tri, _ = kinds(w.windows(3)[three], of[: len(three)][three])
        all_tri = np.maximum(n - 2, 0)
        visible = np.maximum(chars[:, 1:8].sum(1) + chars[:, 9], 1)
        letters = np.maximum(chars[:, 1] + chars[:, 2], 1)
        per_word = np.maximum(n, 1)
        share = lambda x, y: np.arcsin(np.sqrt(np.clip(x / y, 0, 1)))
        stats = np.stack(
            [
                np.log1p(n),
                np.log1p(visible / per_word),
                share(chars[:, 2], letters),
                share(chars[:, 5], visible),
                share(chars[:, 6], per_word),
                share(chars[:, 7], per_word),
                share(chars[:, 3], visible),
                share(chars[:, 9], per_word),
                share(chars[:, 4], visible),
                np.log1p(distinct) / np.log(per_word + 1.0),
                share(most, per_word) * (n > 0),
                share(twice, np.maximum(n - 1, 1)),
                share(all_tri - tri, np.maximum(all_tri, 1)),
                share(chars[:, 8], per_word),
            ],
            axis=1,
        )
        stats[n == 0] = 0
        out.append(stats)
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of each row's whole text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch["text"])
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], values], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Discriminant:
    """Two Gaussians by the Cholesky factors of their inverse-free form; with too few labels, `prior` is every score."""

    prior: float
    scale: tuple[np.ndarray, np.ndarray] | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None
    temperature: float = TEMPERATURE

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
        """From each class's count, sum and cross products. Covariances are drawn towards the pooled one, then towards a
        multiple of the identity, on standardised statistics."""
        prior = (counts[1] + 1) / (counts.sum() + 2)
        if counts.min() < 2:
            return cls(float(prior))
        n = counts.sum()
        centre = sums.sum(0) / n
        spread = np.sqrt(np.maximum(np.diag(products.sum(0)) / n - centre**2, 1e-12))
        spread[spread < 1e-6] = 1.0
        means = (sums / counts[:, None] - centre) / spread
        within = np.stack([products[c] / counts[c] - np.outer(sums[c], sums[c]) / counts[c] ** 2 for c in (0, 1)]) / np.outer(spread, spread)
        pooled = (within * counts[:, None, None]).sum(0) / n
        d = len(centre)
        factors = []
        for c in (0, 1):
            s = (1 - to_pooled) * within[c] + to_pooled * pooled
            factors.append(np.linalg.cholesky((1 - to_diagonal) * s + to_diagonal * (np.trace(s) / d + 1e-9) * np.eye(d)))
        factors = np.stack(factors)
        return cls(float(prior), (centre, spread), means, np.linalg.inv(factors), 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        z = (x - self.scale[0]) / self.scale[1]
        far = [((z - self.means[c]) @ self.factors[c].T) ** 2 for c in (0, 1)]
        margin = 0.5 * (far[0].sum(1) - far[1].sum(1) + self.log_dets[0] - self.log_dets[1]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin / self.temperature, -40, 40)))


def fit(stats: DataFrame, labelled: DataFrame, label: str) -> Discriminant:
    """stats(doc_id, x) and labelled(doc_id, label 0/1; others and null are left out)."""
    width = len(STATISTICS)
    rows = stats.join(labelled.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")), "doc_id")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for batch in batches:
            y, x = batch["y"].to_numpy(zero_copy_only=False), _matrix(batch["x"], width)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        k = total.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * k, dtype=np.int32)), pa.array(total.ravel())], ["k", "v"])

    got = np.zeros(2 * (1 + width + width * width))
    for r in rows.select("y", "x").mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        got[r.k] = r.v
    got = got.reshape(2, -1)
    return Discriminant.fit(got[:, 0], got[:, 1 : 1 + width], got[:, 1 + width :].reshape(2, width, width))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs(doc_id, text).

    Labels of rows whose crc32(doc_id as text) mod `folds` is `held` aren't looked at. Null and empty texts are scored
    as texts with all statistics zero. Repeated rows get the same score; a null id is in no fold. Labels for unknown ids
    and null labels don't count; with fewer than two labelled rows of either class each score is the smoothed share of
    label 1. A row counts once in the fit for each label of its id, so repeated or contradictory labels weigh so often. Texts
    of any length count whole. Columns of other names aren't read, and an empty table gives no rows.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    stats = cut(with_statistics(docs))
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels.where(remainder != held), label))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(_matrix(batch["x"], len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s)], ["doc_id", "score"])

    scored = stats.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject."""
    return without(docs, quality_scores(docs, labels).where("predicted = 0"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
