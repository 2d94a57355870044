"""Line dedup by document frequency, with DataFrame operations only (operator 2).

Two narrow passes over exploded lines: the first counts documents for each 128-bit line hash, the second meets the
frequent hashes and gathers, for each document, the positions to drop. Texts move once, in the last join. A document
counts once for a hash, so (hash, id) pairs are dealt first, by both, and counts of them combine before they move: a line
that every document has costs a row a task. The frequent hashes are counted; up to a million are broadcast, so the
exploded lines don't move, and beyond that Spark's skew handling splits the join's hot hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm.rows import BROADCAST_IDS
from dyadflow.session import cut, table

MIN_DOCS, MIN_CHARS = 10, 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lowered. Lines of ASCII take the quick way to the same result."""
    line = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(7), F.reverse("key"))}).drop("key")


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of docs(doc_id, text) with n_lines, n_dropped and kept (the text without its frequent lines).

    Lines end at \\n; a null or empty text is one empty line. Lines whose key has at least min_chars code points and
    occurs in at least min_docs documents go, in every document; the others stay as they are, in order, joined by \\n.
    Documents are told apart by doc_id, null being one: a line counts once for an id, however often its rows have it. Repeated
    rows stay as they are, each with its counts. Columns of other names aren't read. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    lines = F.split("text", "\n")
    keys = F.transform(lines, line_key)
    long_enough = F.char_length("key") >= min_chars
    every = _hashed(rows.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).where(long_enough))
    documents = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    frequent = cut(every.groupBy("h1", "h2").agg(documents.alias("n")).where(F.col("n") >= min_docs).drop("n"))
    few = frequent.count() <= BROADCAST_IDS
    found = _hashed(rows.select("doc_id", "mark", F.posexplode(keys).alias("pos", "key")).where(long_enough)).join(F.broadcast(frequent) if few else frequent, ["h1", "h2"])
    dropped = found.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("drop")).select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "drop")
    out = rows.join(dropped, rows["doc_id"].eqNullSafe(dropped["id"]) & (rows["mark"] == dropped["m"]), "left").withColumn("lines", lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_KEY = f"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}')"
OP2_SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM s, unnest(range(1, len(ls) + 1)) AS t(i)),
k AS (SELECT *, {_KEY} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""
