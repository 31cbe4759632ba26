"""Registered queries of the operators: each over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .substrings import remove_repeats

    done = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .lines import dedup_lines

    done = dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op10_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf, "documents"))


@query()
def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encoded

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = encoded(table(spark, sf, "documents"), path, public_tokenizers.PATTERN, with_ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query()
def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from .bpe import token_counts

    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def remainder(n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``n``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n)), F.lit(-1))


@query()
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from .language import identify, profiles

    docs = table(spark, sf, "documents")
    learned = profiles(docs.filter(~remainder(4).isin(2, -1)), "text", "lang")
    done = identify(docs, learned)
    return done.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from .quality import learned, scored

    docs = table(spark, sf, "documents")
    model = learned(docs, table(spark, sf, "labels"), "coalesce(crc32(cast(doc_id as string)) % 5, 0) <> 0")
    return scored(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


@query()
def op7_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    from .imatch import fingerprints

    return fingerprints(table(spark, sf, "documents"))


@query()
def op5_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf, "embeddings"))


@query()
def op11_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from .alignment import aligned

    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned(table(spark, sf, "documents"), *paths, with_groups=False)


@query()
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    from .conversations import repaired

    return repaired(table(spark, sf, "conversations"), with_text=False)


@query("""
    with recursive v as (
        select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
        where label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
          and len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), l as (
        select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
        where list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.93
    ), reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
    c as (select a, min(b) as least from reach group by a),
    n as (select a, count(*) as n from l group by a)
    select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) as component_id,
           e.vec_id <= coalesce(c.least, e.vec_id) as kept
    from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id
""")
def op13_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from .tiles import near_vectors

    return near_vectors(table(spark, sf, "embeddings"))


@query()
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf)
