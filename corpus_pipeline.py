"""A training corpus from ``documents``: five stages, each written as Parquet and read again.

1. toxicity: documents scored 0.5 or more go;
2. n-gram join: of each component of similar documents the one with the smallest id stays;
3. personal data: every span becomes its kind's mark;
4. mixing: each source gives its target's words, whole documents repeated or left out, one cut;
5. packing: what is left as windows of 2048 token ids.

Edge cases: null and empty texts are not toxic, are similar to nothing, have no spans, no words to mix (the mix
takes none of them) and so reach no window; a null id stays till the mix; rows that repeat an id are one
document at stage 2; a document that the mix takes twice keeps its id on both rows; an empty table gives no
row; further columns of ``documents`` pass through to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetide.llm import mixing, ngram_join, packing, pii, toxicity
from cuetide.llm.common import named, new_folder, quoted, read_table, written
from cuetide.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redacted(docs, pii.fit(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time the mix takes a document; the last of a source may be cut after some word."""
    mixed = mixing.mix(docs, keep_rows=True).where(F.col("taken") > 0)
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    copies = mixed.select("row", whole.alias("whole"), rest.alias("rest"), F.explode(F.sequence(F.lit(1).cast("long"), whole + (rest > 0).cast("long"))).alias("copy"))
    out = copies.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c != "text"], F.when(F.col("copy") > F.col("whole"), mixing.first_words(F.col("row.text"), F.col("rest"))).otherwise(F.col("row.text")).alias("text"))
    return _counted(out.select(*named(docs.columns)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), length=2048)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_similar), ("pii", redact), ("mixing", mix_sources), ("packing", pack)]

#: SQL can express neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}") + "/t"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return written(STAGES[-1][1](spark, docs, sf_dir), "stage-packing")
