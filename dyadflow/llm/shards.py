"""Sharding: contiguous shards of nearly equal bytes, from prefix sums over partition totals (operator 5).

Only doc_id, size and checksum move: rows are range-partitioned by doc_id and written once (a reliable checkpoint),
so that both passes see the same partitions. Partition totals (a row each) go to the driver and become offsets; each
task then adds its own running sum. No step holds more than a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.session import cut, table

N_SHARDS = 16


def shard_bytes(docs: DataFrame, n_shards: int = N_SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Puts every row into one of n_shards by law `bytes`: rows in order of doc_id, cut where the bytes before a row's
    middle pass a multiple of total / n_shards. Sizes differ from equal by one row's size at most.

    A row's size is its text's UTF-8 bytes plus 1 (null text: 1). Null ids come first; rows with equal ids lie in order
    of checksum and size. An empty table gives no rows. Other columns of `docs`, whatever their names, aren't read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    order = ("doc_id", "text_crc32", "size")
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # a row for each partition
    parts = max((r.part for r in totals), default=-1) + 1
    sizes, counts = np.zeros(parts + 1, np.int64), np.zeros(parts + 1, np.int64)
    for r in totals:
        sizes[r.part + 1], counts[r.part + 1] = r.b, r.n
    sizes, counts = np.cumsum(sizes), np.cumsum(counts)
    offsets = docs.sparkSession.sparkContext.broadcast((sizes, counts))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ranked, total = *offsets.value, int(offsets.value[0][-1])
        at = done = None
        for x in batches:
            if not x.num_rows:
                continue
            size = x["size"].to_numpy()
            if at is None:
                part = x["part"][0].as_py()
                at, done = int(before[part]), int(ranked[part])
            ends = at + np.cumsum(size)
            middle = 2 * ends - size  # twice the bytes before the row's middle
            shard = np.fromiter((min(n_shards - 1, m * n_shards // (2 * total)) for m in middle.tolist()), np.int32, len(middle)) if total > 2**62 // (2 * n_shards) else np.minimum(n_shards - 1, middle * n_shards // (2 * total)).astype(np.int32)
            rank = np.arange(done, done + len(size), dtype=np.int64)
            at, done = int(ends[-1]), done + len(size)
            yield pa.RecordBatch.from_arrays([x["doc_id"], x["size"], x["text_crc32"], pa.array(shard), pa.array(rank)], ["doc_id", "size", "text_crc32", "shard", "rank"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, shard int, rank long"
    out = rows.mapInArrow(assign, schema)
    first = {r.shard: r.first for r in out.groupBy("shard").agg(F.min("rank").alias("first")).collect()}  # a row for each shard
    starts = F.array(*(F.lit(first.get(s, 0)).cast("long") for s in range(n_shards)))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - starts[F.col("shard")]).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_bytes(table(spark, sf_dir, "documents"))


_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
#: DuckDB has no crc32: a table of 256 steps, and a fold over each text's bytes.
OP5_SQL = f"""
WITH RECURSIVE t0(i, k, c) AS (SELECT i, 0, i FROM unnest(range(256)) AS u(i) UNION ALL SELECT i, k + 1, {_CRC_STEP} FROM t0 WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM t0 WHERE k = 8),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 + 1 AS size, list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS bytes FROM d),
r AS MATERIALIZED (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
s AS (SELECT *, 2 * sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS middle, sum(size) OVER () AS total FROM r),
p AS (SELECT *, cast(least({N_SHARDS - 1}, middle * {N_SHARDS} // (2 * total)) AS INT) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, cast(NULL AS INT) AS grown_shard FROM p
"""
