"""Next-fit packing of sequences into rows of a fixed length.

Next-fit is sequential: a sequence joins the current pack when it fits, else it opens a new
one. It still runs in parallel and gives the exact result. What a stretch of sequences does
to the packing depends only on the load it starts with, a number up to ``pack_len``.
So every stretch builds a table from start load to (end load, packs opened), the tables are
applied one after the other, and then each stretch packs its own sequences from its known
start. Only ids and lengths take part; the arrays are joined afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import pinned
from .ranking import order_hash
from .tokens import IGNORE, PAD_ID



def next_starts(lens: np.ndarray, pack_len: int) -> np.ndarray:
    """For each sequence the first one behind it that no longer fits a pack it opens."""
    ends = np.concatenate([[0], np.cumsum(lens)])
    return np.searchsorted(ends, ends[:-1] + pack_len, side="right") - 1


def load_table(lens: np.ndarray, pack_len: int) -> tuple[np.ndarray, np.ndarray]:
    """End load and packs opened for every start load from 0 to ``pack_len``."""
    n = len(lens)
    ends = np.concatenate([[0], np.cumsum(lens)])
    nxt = next_starts(lens, pack_len)
    # From a pack opened at i: the load at the end of the stretch and the packs opened, i's included.
    load = np.empty(n + 1, dtype=np.int64)
    opened = np.zeros(n + 1, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        j = nxt[i]
        load[i], opened[i] = (ends[n] - ends[i], 1) if j >= n else (load[j], opened[j] + 1)
    starts = np.arange(pack_len + 1)
    first = np.searchsorted(ends, pack_len - starts, side="right") - 1
    inside = first >= n
    end_load = np.where(inside, starts + ends[n], load[np.minimum(first, n)])
    return end_load, np.where(inside, 0, opened[np.minimum(first, n)])


def _packs(lens: np.ndarray, pack_len: int, load: int, pack: int) -> tuple[np.ndarray, np.ndarray]:
    """Pack number and offset of each sequence of one stretch."""
    n = len(lens)
    ends = np.concatenate([[0], np.cumsum(lens)])
    nxt = next_starts(lens, pack_len)
    numbers = np.empty(n, dtype=np.int64)
    offsets = np.empty(n, dtype=np.int64)
    i = int(np.searchsorted(ends, pack_len - load, side="right") - 1)
    i = min(i, n)
    numbers[:i], offsets[:i] = pack, load + ends[:i]
    while i < n:
        pack += 1
        j = min(int(nxt[i]), n)
        numbers[i:j], offsets[i:j] = pack, ends[i:j] - ends[i]
        i = j
    return numbers, offsets


#: Tables that are composed into one at a time.
STRETCHES_PER_BLOCK = 64


def checked_lengths(lengths: DataFrame, pack_len: int) -> DataFrame:
    """``lengths`` that fail the job on a sequence no pack can hold."""
    bad = (F.col("len") > pack_len) | (F.col("len") < 1)
    message = F.concat(F.lit("no pack can hold the length "), F.col("len").cast("string"))
    checked = F.when(bad, F.raise_error(message).cast("int")).otherwise(F.col("len"))
    return lengths.withColumn("len", checked)


def assign_packs(
    lengths: DataFrame,
    pack_len: int,
    seed: int | None = 42,
    mode: str = "exact",
    stretches: int | None = None,
    rows_per_stretch: int = 500_000,
) -> DataFrame:
    """(``id``, ``len``) → ``pack_id``, ``pos``, ``offset``: next-fit in seeded order (by id without seed).

    ``exact`` equals one sequential pass, whatever the number of stretches. ``sharded`` packs every
    stretch on its own, which saves one step and costs at most one extra pack per stretch; its
    result depends on ``stretches``, which must be given. Sequences longer than ``pack_len`` or
    empty are an error.
    """
    if mode == "sharded" and stretches is None:
        raise ValueError("sharded packing needs the number of stretches")
    spark = lengths.sparkSession
    narrow = checked_lengths(lengths.select(F.col("id").cast("string"), F.col("len").cast("int")), pack_len)
    order = order_hash(F.col("id"), seed) if seed is not None and seed >= 0 else F.col("id")
    if stretches is None:
        # Row count only: stretches stay small enough for one task whatever the table size.
        rows = narrow.count()
        stretches = max(1, -(-rows // rows_per_stretch))
    cut = narrow.withColumn("_order", order).repartitionByRange(stretches, "_order", "id")
    cut = pinned(cut.withColumn("_part", F.spark_partition_id()))
    if mode == "sharded":
        starts = cut.groupBy("_part").agg(F.lit(0).alias("load"), F.count(F.lit(1)).alias("rows"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        # One row per stretch. Pack numbers keep room for one pack per sequence.
        starts = starts.withColumn("pack", F.coalesce(F.sum("rows").over(before), F.lit(0)) - 1)
        starts = starts.select("_part", F.lit(pack_len).cast("long").alias("load"), F.col("pack").cast("long"))
    else:
        starts = _start_states(cut, pack_len, stretches)
    ready = cut.join(starts, "_part")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "id"], kind="stable")
        lens = pdf["len"].to_numpy(np.int64)
        numbers, offsets = _packs(lens, pack_len, int(pdf["load"].iloc[0]), int(pdf["pack"].iloc[0]))
        return pd.DataFrame(
            {"id": pdf["id"], "len": pdf["len"], "pack_id": numbers, "offset": offsets, "_order": pdf["_order"]}
        )

    placed = ready.groupBy("_part").applyInPandas(
        place, "id string, len int, pack_id long, offset long, _order string"
    )
    in_pack = Window.partitionBy("pack_id").orderBy("offset")
    return placed.select(
        "id", "len", "pack_id", "offset", (F.row_number().over(in_pack) - 1).cast("int").alias("pos")
    )


def _start_states(cut: DataFrame, pack_len: int, stretches: int) -> DataFrame:
    """(``_part``, ``load``, ``pack``): the state every stretch starts from.

    Following one table after another is again a table, so blocks of stretches become one
    table each, blocks of those again, until one block is left. On the way back every block
    hands its start to its members. A task never holds more than a block of tables.
    """

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "id"], kind="stable")
        end_load, opened = load_table(pdf["len"].to_numpy(np.int64), pack_len)
        return pd.DataFrame(
            {"_part": [pdf["_part"].iloc[0]], "end_load": [end_load.tolist()], "opened": [opened.tolist()]}
        )

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        end, opened = np.arange(pack_len + 1), np.zeros(pack_len + 1, np.int64)
        for next_end, next_opened in zip(pdf["end_load"], pdf["opened"]):
            opened, end = opened + np.asarray(next_opened)[end], np.asarray(next_end)[end]
        return pd.DataFrame(
            {"_part": [pdf["_block"].iloc[0]], "end_load": [end.tolist()], "opened": [opened.tolist()]}
        )

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_part")
        load, pack = int(pdf["load"].iloc[0]), int(pdf["pack"].iloc[0])
        rows = []
        for part, end_load, opened in zip(pdf["_part"], pdf["end_load"], pdf["opened"]):
            rows.append((part, load, pack))
            load, pack = int(end_load[load]), pack + int(opened[load])
        return pd.DataFrame(rows, columns=["_part", "load", "pack"])

    def in_blocks(tables: DataFrame) -> DataFrame:
        block = F.floor(F.col("_part") / STRETCHES_PER_BLOCK).cast("int")
        return pinned(tables.withColumn("_block", block))

    table = "_part int, end_load array<long>, opened array<long>"
    levels = [in_blocks(cut.groupBy("_part").applyInPandas(summarize, table))]
    while stretches > STRETCHES_PER_BLOCK:
        levels.append(in_blocks(levels[-1].groupBy("_block").applyInPandas(follow, table)))
        stretches = -(-stretches // STRETCHES_PER_BLOCK)
    # An unopened pack counts as full, so the first sequence opens pack 0.
    known = levels[-1].withColumns({"load": F.lit(pack_len).cast("long"), "pack": F.lit(-1).cast("long")})
    state = "_part int, load long, pack long"
    starts = known.groupBy("_block").applyInPandas(inside, state)
    for level in reversed(levels[:-1]):
        known = level.join(starts.withColumnRenamed("_part", "_block"), "_block")
        starts = known.groupBy("_block").applyInPandas(inside, state)
    return starts


def assemble_packs(
    examples: DataFrame, assigned: DataFrame, pack_len: int, pad_id: int = PAD_ID, padding_side: str = "right"
) -> DataFrame:
    """Join arrays to their packs: one row of ``pack_len`` ids, labels and segment numbers each.

    The first label of every sequence is masked; the mask holds the 1-based segment
    number, 0 for padding. A pack holds at most ``pack_len`` sequences, so it fits one row.
    """
    rows = examples.select(F.col("id").cast("string"), "input_ids", "labels").join(
        assigned.select("id", "pack_id", "pos"), "id"
    )
    first_masked = F.concat(
        F.array(F.lit(IGNORE)), F.slice("labels", F.lit(2), F.greatest(F.size("labels") - 1, F.lit(0)))
    )
    packed = rows.groupBy("pack_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "input_ids", first_masked.alias("labels")))).alias("_parts")
    )
    joined = {
        "input_ids": (F.flatten(F.transform("_parts", lambda p: p["input_ids"])), pad_id),
        "labels": (F.flatten(F.transform("_parts", lambda p: p["labels"])), IGNORE),
        "attention_mask": (
            F.flatten(
                F.transform("_parts", lambda p: F.array_repeat(p["pos"] + 1, F.size(p["input_ids"])))
            ),
            0,
        ),
    }

    def padded(values, fill: int):
        fillers = F.array_repeat(F.lit(fill), F.lit(pack_len) - F.size(values))
        return F.concat(values, fillers) if padding_side == "right" else F.concat(fillers, values)

    return packed.select("pack_id", *[padded(v, fill).alias(name) for name, (v, fill) in joined.items()])


def segment_offsets(assigned: DataFrame) -> DataFrame:
    """Cumulative segment lengths of every pack, from 0, and its longest segment."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "len")))
    return (
        assigned.groupBy("pack_id")
        .agg(ordered.alias("_segments"), F.max("len").alias("max_segment"))
        .select(
            "pack_id",
            F.aggregate(
                "_segments",
                F.array(F.lit(0)),
                lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s["len"])),
            ).alias("cu_seqlens"),
            "max_segment",
        )
    )


def pack_stats(assigned: DataFrame) -> DataFrame:
    """Number of sequences and packs, and their average lengths."""
    packs = assigned.groupBy("pack_id").agg(F.sum("len").alias("_len"), F.count(F.lit(1)).alias("_n"))
    return packs.agg(
        F.sum("_n").alias("n_sequences"),
        F.count(F.lit(1)).alias("n_packs"),
        (F.sum("_len") / F.sum("_n")).alias("avg_sequence_len"),
        F.avg("_len").alias("avg_pack_len"),
    )
