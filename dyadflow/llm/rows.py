"""Taking rows out of documents by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadflow.session import cut

#: So many ids at most are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id isn't in gone(doc_id); a null id there takes rows with a null id."""
    gone = cut(gone.select(F.col("doc_id").alias("__gone")).distinct())
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
