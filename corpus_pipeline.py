"""From documents to packed sequences, in five stages; each is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rftspark.llm.lines import dedup_lines
from rftspark.llm.packing import pack
from rftspark.llm.quality import learned, scored
from rftspark.llm.simhash import near_duplicates
from rftspark.llm.substrings import remove_repeats
from rftspark.runtime import pinned, shared_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rewritten(done: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents with their new text; those of which nothing is left go. ``n_chars`` follows a changed text."""
    left = done.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Rows that share an id go or stay by their own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learned(docs, labels, "coalesce(crc32(cast(doc_id as string)) % 5, 0) <> 0")
    return scored(docs, model, keep=True).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals."""
    return _rewritten(dedup_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints that differ in 2 or fewer bits, over 3-word shingles.

    The row with the smallest id stays, null ids last; of rows that share it any one. Null and
    empty texts have fingerprint 0 and are one component.
    """
    rows = pinned(docs.withColumn("_row", F.monotonically_increasing_id()))
    classes = near_duplicates(rows.select("_row", "text"), "_row").withColumnRenamed("_row", "_of")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    members = rows.select("_row", "doc_id").join(classes, F.col("_row") == F.col("_of"))
    first = members.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words and more that appeared earlier."""
    return _rewritten(remove_repeats(docs, joined=False), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_dedup),
    ("substring dedup", substrings), ("best-fit packing", packing),
]

#: No engine's SQL expresses the classifier, the fingerprints or the tokenizer; tests compare with a loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from documents on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    folder = f"{shared_root(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{i}")
    return docs
