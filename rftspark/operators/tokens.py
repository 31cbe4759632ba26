"""Token ids, labels and masks as array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100
PAD_ID = 0
EOS = "</s>"
VOCAB = 32_000
TOKEN_PATTERN = r"\w+|[^\w\s]"


def hashed_ids(text: Column, vocab: int = VOCAB) -> Column:
    """Native default tokenizer: words and marks, each hashed to an id from 1 to ``vocab - 1``."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.transform(
        tokens,
        lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % (vocab - 1) + 1).cast("int"),
    )


def tokenize(
    df: DataFrame,
    columns: dict[str, str],
    max_len: int | None = None,
    make_encoder: Callable[[], Callable[[list[str]], list[list[int]]]] | None = None,
) -> DataFrame:
    """Add token ids: ``columns`` maps text to target columns; longer texts are cut, none padded.

    ``make_encoder`` builds a subword encoder once per Python worker; it gets whole Arrow
    batches of text. Only the text columns travel to Python.
    """
    if make_encoder is None:
        found = {target: hashed_ids(F.col(source)) for source, target in columns.items()}
    else:
        encode = _encoder_udf(make_encoder)
        found = {target: encode(F.col(source)) for source, target in columns.items()}
    if max_len:
        found = {target: F.slice(ids, 1, max_len) for target, ids in found.items()}
    return df.withColumns(found)


def _encoder_udf(make_encoder: Callable[[], Callable[[list[str]], list[list[int]]]]):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            yield pd.Series(encode(texts.tolist()))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")


def sources_and_targets(df: DataFrame, prompt: str = "prompt", response: str = "response", eos: str = EOS) -> DataFrame:
    """Training texts: the prompt, and the response with its end mark."""
    return df.withColumns({"source": F.col(prompt), "target": F.concat(F.col(response), F.lit(eos))})


def supervised(
    df: DataFrame,
    max_len: int | None = None,
    pad_id: int = PAD_ID,
    make_encoder: Callable | None = None,
) -> DataFrame:
    """Add ``input_ids``, ``labels`` and ``attention_mask`` from ``source`` and ``target``.

    Source and target are tokenized together; as many labels as the source alone has
    tokens are masked.
    """
    both = df.withColumn("_text", F.concat("source", "target"))
    both = tokenize(both, {"_text": "input_ids", "source": "_source_ids"}, max_len, make_encoder)
    return mask_labels(both, F.size("_source_ids"), pad_id).drop("_text", "_source_ids")


def mask_labels(df: DataFrame, source_len: Column, pad_id: int = PAD_ID) -> DataFrame:
    """Add ``labels`` with the first ``source_len`` masked, and ``attention_mask``."""
    n = F.size("input_ids")
    hidden = F.least(source_len, n)
    labels = F.concat(
        F.array_repeat(F.lit(IGNORE), hidden), F.slice("input_ids", hidden + 1, F.greatest(n - hidden, F.lit(0)))
    )
    mask = F.transform("input_ids", lambda x: (x != pad_id).cast("int"))
    return df.withColumns({"labels": labels, "attention_mask": mask})


def pad_right(df: DataFrame, pad_id: int = PAD_ID) -> DataFrame:
    """Pad all rows to the longest one; its length is a scalar subquery."""
    top = df.agg(F.max(F.size("input_ids"))).scalar()
    missing = F.col("_top") - F.size("input_ids")
    return df.withColumn("_top", top).withColumns(
        {
            name: F.concat(name, F.array_repeat(F.lit(fill), missing))
            for name, fill in (("input_ids", pad_id), ("labels", IGNORE), ("attention_mask", 0))
        }
    ).drop("_top")


def unpad(df: DataFrame, padding_side: str = "right", pad_id: int = PAD_ID) -> DataFrame:
    """Drop padding by the mask; labels that are missing come from the ids."""
    n = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x.cast("int"))
    df = df.withColumn("_len", n)

    def cut(name: str) -> Column:
        start = F.lit(1) if padding_side == "right" else F.size(name) - F.col("_len") + 1
        return F.slice(name, start, F.col("_len"))

    out = df.withColumn("input_ids", cut("input_ids"))
    if "labels" in df.columns:
        return out.withColumn("labels", cut("labels")).drop("_len")
    return out.withColumn(
        "labels", F.transform("input_ids", lambda x: F.when(x == pad_id, IGNORE).otherwise(x))
    ).drop("_len")
