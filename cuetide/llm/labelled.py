"""A bounded sample of labelled documents for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are used to fit a model.
MAX_ROWS = 20_000


def sample(docs: DataFrame, labels: DataFrame, label_col: str, *, max_rows: int = MAX_ROWS, only: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of at most ``max_rows`` labelled documents, the first by a hash of their id.

    The chosen labels are bounded by ``max_rows``, so they are broadcast; documents aren't shuffled.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if only is not None:
        rows = rows.where(only)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(rows), "doc_id").select("doc_id", "text", "label")
