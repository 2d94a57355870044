"""Document fingerprints from Lempel-Ziv phrases (operator 9).

A text is parsed into phrases, each a known phrase and one more code point (LZ78). The set of phrases is hashed, and
the smallest hash in each of BINS ranges makes the signature; empty ranges borrow from the next one that isn't. Equal
positions of two signatures estimate how much of their phrases two texts share, which is how well either's dictionary
would compress the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm.bytetext import mix, powers
from dyadflow.session import table

BINS = 64
#: Bytes of texts in one range, how many ranges there are at most, and parts that a range is made of.
RANGE_BYTES, MAX_RANGES, FINE = 64 << 20, 20_000, 16
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_BLOCK_CHARS = 1 << 18
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _parse(codes: list[int], at: int, trie: dict[int, int], node: int, cuts: list[int]) -> int:
    """Goes on with a parse from code point `at` in state (trie, node, cuts); returns the node it ends in."""
    get, size = trie.get, len(trie)
    for i, c in enumerate(codes, at + 1):
        key = (node << 21) | c
        node = get(key)
        if node is None:
            size += 1
            trie[key] = size
            cuts.append(i)
            node = 0
    return node


def signatures(texts: list[np.ndarray], ends: list[list[int]]) -> np.ndarray:
    """A row of BINS 16-bit numbers for each text (code points) with its phrases' ends. Texts without phrases have zeros."""
    k = len(texts)
    low = np.full((k, BINS), _NONE)
    lengths = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(lengths)])
    codes = np.concatenate(texts) if k else np.zeros(0, np.uint32)
    p, inverse = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[: len(codes)], out=sums[1:])
    n = np.array([len(e) for e in ends], np.int64)
    of = np.repeat(np.arange(k), n)
    end = np.concatenate([np.asarray(e, np.int64) for e in ends] or [np.zeros(0, np.int64)])
    start = np.zeros_like(end)
    start[1:] = end[:-1]
    start[(np.cumsum(n) - n)[n > 0]] = 0
    start, end = start + base[of], end + base[of]
    h = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    np.minimum.at(low.reshape(-1), of * BINS + (h >> np.uint64(58)).astype(np.int64), h)
    full = low != _NONE
    some = full.any(1)
    out = np.zeros((k, BINS), np.uint16)
    if some.any():
        low, full = low[some], full[some]
        ahead = np.tile(full, 2)  # for each range, how far the next that isn't empty is
        place = np.where(ahead, np.arange(2 * BINS), 4 * BINS)
        nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        step = nearest - np.arange(BINS)
        borrowed = np.take_along_axis(low, nearest % BINS, axis=1)
        out[some] = np.maximum(1, (mix(borrowed + step.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def fingerprints(texts: list[str]) -> np.ndarray:
    """Signatures of whole texts."""
    codes, ends = [_codes(t) for t in texts], []
    for c in codes:
        cuts: list[int] = []
        if _parse(c.tolist(), 0, {}, 0, cuts):
            cuts.append(len(c))
        ends.append(cuts)
    return signatures(codes, ends)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _with_edits(texts: list[str], nexts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Signatures of the texts and of their edited texts. What both share is parsed once."""
    codes, ends, edited_codes, edited_ends, edited = [], [], [], [], []
    for t, following in zip(texts, nexts, strict=True):
        m = len(t) // 2
        keep = len(t) - m
        new = following[:m]
        c = _codes(t)
        trie: dict[int, int] = {}
        cuts: list[int] = []
        node = _parse(c[:keep].tolist(), 0, trie, 0, cuts)
        other, other_cuts = trie.copy(), cuts.copy()
        if _parse(c[keep:].tolist(), keep, trie, node, cuts):
            cuts.append(len(c))
        d = np.concatenate([c[:keep], _codes(new)])
        if _parse(d[keep:].tolist(), keep, other, node, other_cuts):
            other_cuts.append(len(d))
        codes.append(c)
        ends.append(cuts)
        edited_codes.append(d)
        edited_ends.append(other_cuts)
        edited.append(t[:keep] + new)
    return signatures(codes, ends), signatures(edited_codes, edited_ends), edited


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (bucket, peek, doc_id, text) in order: each row with its fingerprint and how it stands to the row after it.
    A bucket's last row, marked peek, is the first of the next one and isn't returned."""
    hex_of = lambda s: [x.astype(">u2").tobytes().hex() for x in s]
    held: list[tuple] = []
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        """All rows but the last, or but peeks."""
        own = [i for i, r in enumerate(rows[:-1]) if not r[1]]
        if not own:
            return None
        texts = [r[3] for r in rows]
        pairs = {p: k for k, p in enumerate(dict.fromkeys((texts[i], texts[i + 1]) for i in own))}  # equal ones once
        of = [pairs[texts[i], texts[i + 1]] for i in own]
        first, edited, new = _with_edits([t for t, _ in pairs], [t for _, t in pairs])
        first, edited, new = first[of], edited[of], [new[k] for k in of]
        after = [i + 1 for i in own]
        place = {i: k for k, i in enumerate(own)}
        missing = [i for i in after if i not in place]
        place |= {i: len(own) + k for k, i in enumerate(missing)}
        every = np.concatenate([first, fingerprints([texts[i] for i in missing])]) if missing else first
        following = every[[place[i] for i in after]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in own], pa.int64()),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                pa.array(hex_of(first)),
                pa.array(hex_of(edited)),
                pa.array(likeness(first, edited)),
                pa.array(likeness(first, following)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    skip = None
    for batch in batches:
        for bucket, peek, doc_id, text in zip(*(batch[c].to_pylist() for c in ("bucket", "peek", "doc_id", "text")), strict=True):
            if peek and skip == bucket:
                continue  # the next bucket's first row is known
            if peek:
                skip = bucket
            held.append((bucket, peek, doc_id, text))
            size += len(text)
            if peek or size >= _BLOCK_CHARS:
                if (out := flush(held)) is not None:
                    yield out
                held = [] if peek else held[-1:]
                size = 0 if peek else len(text)


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """Each row of docs(doc_id long, text): n_chars, fingerprint, and how near it is to its edited text and to the next row.

    The next row is the one with the next larger doc_id, after the last the first; rows with equal ids follow each other in
    order of a hash of the text; a null id comes first. The edited text has the last floor(n/2) code points replaced by the
    next text's first as many (or all it has). A null text is empty; two texts without phrases are alike (1.0), one with and
    one without aren't (0.0). One row alone is its own next. Columns of other names aren't read; an empty table gives no rows.

    Rows are dealt by ranges of (doc_id, hash of the text) whose bounds are rows that occur; the row at a bound also goes, as a
    peek, to the range before it. So texts move once, and a task holds a block of rows. There are as many ranges as the
    texts' bytes need, MAX_RANGES at most, a partition each; an id with more rows than a range should have is cut by the
    hash, so only rows that are equal in both must share a range, and equal rows in a row are parsed once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key, mark = F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")
    total = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text") + 1).alias("bytes")).first()
    if not total.rows:
        return spark.createDataFrame([], SCHEMA)
    n = min(MAX_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total.bytes // RANGE_BYTES)))
    bounds = _bounds(rows.select(key.alias("key"), mark.alias("mark"), (F.octet_length("text") + 1).alias("bytes")), n, total)
    numbers = _lone_numbers(spark, len(bounds))
    dealt = _in_ranges(rows.withColumns({"key": key, "mark": mark}), bounds)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("peek"))
    before = F.struct(F.when(F.col("bucket") == 0, F.lit(len(bounds) - 1)).otherwise(F.col("bucket") - 1).alias("bucket"), F.lit(1).alias("peek"))
    bound = F.col("bounds")[F.col("bucket")]
    copies = F.when((bound["key"] == F.col("key")) & (bound["mark"] == F.col("mark")), F.array(own, before)).otherwise(F.array(own))
    dealt = dealt.select(F.explode(copies).alias("c"), "doc_id", "mark", "text").select("c.bucket", "c.peek", "doc_id", "mark", "text")
    dealt = dealt.withColumn("to", F.array(*map(F.lit, numbers))[F.col("bucket")])
    dealt = dealt.repartition(len(bounds), "to").sortWithinPartitions("bucket", "peek", "doc_id", "mark")
    return dealt.select("bucket", "peek", "doc_id", "text").mapInArrow(_neighbours, SCHEMA)


_LEAST = -(2**63)


def _in_ranges(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """rows(key, mark, ...) with bounds, an array of them, and bucket: the number of the last bound that isn't above the row."""
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))

    def narrow(s, _):  # the bound lies in [lo, hi)
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        b = F.col("bounds")[mid]
        below = (b["key"] < F.col("key")) | ((b["key"] == F.col("key")) & (b["mark"] <= F.col("mark")))
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    search = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), narrow)["lo"]
    at = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(m).alias("mark")) for k, m in bounds))
    return rows.withColumn("bounds", at).withColumn("bucket", search)


def _bounds(rows: DataFrame, n: int, total) -> list[tuple[int, int]]:
    """The first (key, mark) of each of at most n ranges of about as many bytes, in order, from rows(key, mark, bytes); the first
    of all is one. The ranges are made of FINE times as many parts. Percentiles are doubles, so they only part the rows; bounds
    are least rows of parts."""
    m = n * FINE
    cuts = [k / m for k in range(m)]
    parts = {(k, _LEAST) for k in (_LEAST, *rows.agg(F.percentile_approx("key", cuts, 100 * m)).first()[0])}
    hot = rows.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") * n > 2 * total.rows)  # n / 2 at most
    within = rows.join(F.broadcast(hot.select("key")), "key").groupBy("key").agg(F.percentile_approx("mark", cuts, 100 * m).alias("p"))
    parts |= {(r["key"], r["mark"]) for r in within.select("key", F.explode("p").alias("mark")).collect()}
    firsts = _in_ranges(rows, sorted(parts)).groupBy("bucket").agg(F.min(F.struct("key", "mark")).alias("x"), F.sum("bytes").alias("bytes"))
    out, held = [], 0
    for r in sorted(firsts.collect(), key=lambda r: r.bucket):  # a row for each part
        if not out or held + r["bytes"] / 2 > total.bytes / n:
            out.append((r.x["key"], r.x["mark"]))
            held = 0
        held += r["bytes"]
    return out


def _lone_numbers(spark: SparkSession, n: int) -> list[int]:
    """n numbers whose hashes deal them to n partitions, one each."""
    tried = spark.range(64 * n + 64).select("id", F.pmod(F.hash(F.col("id")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id"))
    return [r.id for r in tried.orderBy("p").collect()]


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_rows(table(spark, sf_dir, "documents"))
