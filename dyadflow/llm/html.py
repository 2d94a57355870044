"""HTML extraction: each block of a page is labelled by a recurrent network that sees the whole page (operator 6)."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.llm import html_blocks, html_model
from dyadflow.llm.html_blocks import blocks_of
from dyadflow.llm.html_model import BlockLabeller, features, trained
from dyadflow.session import shared_dir, table

_GROUP_BLOCKS = 4096
_WEIGHTS = "name string, shape array<int>, weights array<float>"


def stored_model(spark: SparkSession) -> BlockLabeller:
    """The trained model, out of the shared folder if an earlier session trained it there with the same code, else trained and
    stored: a row for each of its matrices."""
    code = "".join(map(inspect.getsource, (html_model, html_blocks)))
    path = f"{shared_dir(spark)}/block-labeller-{hashlib.sha256(code.encode()).hexdigest()[:16]}"
    try:
        rows = spark.read.schema(_WEIGHTS).parquet(path).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    model = BlockLabeller()
    if {r.name for r in rows} == set(model.w):
        model.w = {r.name: np.array(r.weights, np.float32).reshape(r["shape"]) for r in rows}
        return model
    model = trained()
    spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in model.w.items()], _WEIGHTS).coalesce(1).write.mode("overwrite").parquet(path)
    return model


def main_texts(pages: list[str], model: BlockLabeller) -> list[str]:
    """The main text of each page: blocks with a probability of a half or more, joined by \\n."""
    out: list[str] = []
    held, size = [], 0

    def flush() -> None:
        nonlocal held, size
        for blocks, p in zip(held, model.label([features(b) for b in held]), strict=True):
            out.append("\n".join(b.text for b, x in zip(blocks, p, strict=True) if x >= 0.5))
        held, size = [], 0

    for page in pages:
        blocks = blocks_of(page)
        held.append(blocks)
        size += len(blocks)
        if size >= _GROUP_BLOCKS:
            flush()
    flush()
    return out


def extract(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """page_id, url and text (the main text, whole) for every row of pages(page_id, url, html).

    A null or empty page, and one without main text, has the text ''. The whole page is parsed; nothing is shuffled, so
    repeated rows and null ids are rows like others. Pages of any length and depth are one row of one task. Columns of other
    names aren't read. An empty table gives no rows. The model is trained on the driver once and stored (see stored_model)
    unless given, and its weights, about 100 kB, are broadcast.
    """
    weights = pages.sparkSession.sparkContext.broadcast(model or stored_model(pages.sparkSession))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch["html"].to_pylist(), weights.value)
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(each, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
