"""Training set job: render, tokenize, combine, shuffle, then pad or pack."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packing import assemble_packs, assign_packs
from ..operators.prompts import render, template_table
from ..operators.ranking import shuffled
from ..operators.tokens import EOS, PAD_ID, pad_right, sources_and_targets, supervised
from ..runtime import pinned
from ..sources.files import kept_pieces


@dataclass(frozen=True)
class Source:
    """One dataset with its field names; ``key`` must be unique within it."""

    name: str
    rows: DataFrame
    key: str = "id"
    query: str = "query"
    response: str = "response"


def examples_of(
    source: Source,
    prompt_template: str = "alpaca",
    max_len: int | None = None,
    eos: str = EOS,
    pad_id: int = PAD_ID,
    make_encoder: Callable | None = None,
    tokenizer_name: str | None = None,
    cache_home: str | None = None,
) -> DataFrame:
    """Tokenized rows (id, input_ids, labels, attention_mask) of one dataset, cached on request.

    The cache name holds everything the ids depend on but the rows themselves; an encoder of
    one's own is told apart by ``tokenizer_name``, which it must have. Rows fall into pieces
    by their id: a piece whose rows have changed is tokenized again, the others are read.
    """
    rows = source.rows.select(
        F.concat(F.lit(f"{source.name}:"), F.col(source.key).cast("string")).alias("id"),
        F.col(source.query).alias("query"),
        F.col(source.response).alias("response"),
    )

    def build(some: DataFrame) -> DataFrame:
        named = some.withColumn("prompt_template", F.lit(prompt_template))
        rendered = sources_and_targets(render(named, template_table(rows.sparkSession)), eos=eos)
        return supervised(rendered, max_len, pad_id, make_encoder).select(
            "id", "input_ids", "labels", "attention_mask"
        )

    if not cache_home:
        return build(rows)
    if make_encoder is not None and tokenizer_name is None:
        raise ValueError("a cached table of one's own encoder needs a tokenizer_name")
    return kept_pieces(
        rows, build, cache_home, "id", source.name, tokenizer_name or "words", prompt_template, max_len, eos, pad_id,
    )


def build(
    sources: list[Source],
    pack_len: int | None = None,
    seed: int | None = 42,
    mode: str = "exact",
    stretches: int | None = None,
    pad_id: int = PAD_ID,
    **options: object,
) -> DataFrame:
    """All datasets as one training table: packed rows, or rows padded to the longest."""
    union = None
    for source in sources:
        part = examples_of(source, pad_id=pad_id, **options)
        union = part if union is None else union.unionByName(part)
    if pack_len is None or pack_len <= 0:
        padded = pad_right(union, pad_id)
        return padded if seed is None or seed < 0 else shuffled(padded, "id", seed)
    if not options.get("cache_home"):
        # Read twice, for lengths and for arrays: tokenized once.
        union = pinned(union)
    lengths = union.select("id", F.size("input_ids").alias("len"))
    return assemble_packs(union, assign_packs(lengths, pack_len, seed, mode, stretches), pack_len, pad_id)
