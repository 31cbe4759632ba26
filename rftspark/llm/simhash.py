"""SimHash fingerprints, links between those that differ in few bits, and their components.

Gray-order hierarchical index. At the top, masked bit patterns deal out the distinct
fingerprints: with ``max_bits`` + 1 blocks of bits, two fingerprints within ``max_bits``
agree on one whole block, so each (block, its bits) is an upper node of its own. Below,
the fingerprints of a node are sorted by Gray rank, so that neighbours share bits; every
run of eight becomes a node with the bits its members share (mask and pattern), and so on
upwards. A search carries the differences found so far down the tree and drops a whole
group as soon as they exceed the bound. A task passes on one edge per fingerprint to the
root of its component there, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
SEED = 42
FAN = 8
#: Members of an upper node beyond which it is divided by further blocks of its other bits.
HOT = 200_000
#: Fingerprints that descend the tree together, which bounds the memory of a search.
TOGETHER = 1 << 14


def fingerprint(text: str | None, size: int = 3) -> int:
    """Majority of each bit over the hashes of all word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return hashed(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    ends = (ends - 1).tolist()
    n = len(words) - size + 1
    h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)), U, count=n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 3) -> DataFrame:
    """(k, fp): the fingerprint as a signed 64-bit number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["k", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(work, "k long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the reflected Gray code."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> U(s)
    return x


def tree(group: np.ndarray, fps: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels from the leaves up; a node has its mask of shared bits, their pattern and its children."""
    n = len(fps)
    level = {"mask": np.full(n, ~U(0)), "pattern": fps, "last": np.arange(n), "group": group}
    both, either = fps, fps
    levels = [level]
    while True:
        of = level["group"]
        begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        sizes = np.diff(np.r_[begins, len(of)])
        if len(begins) == len(of):
            return levels
        rank = np.arange(len(of)) - np.repeat(begins, sizes)
        first = np.flatnonzero(rank % FAN == 0)
        both, either = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(either, first)
        end = np.r_[first[1:], len(of)]
        level = {
            "mask": ~(both ^ either), "pattern": both, "last": level["last"][end - 1], "group": of[first],
            "child": first, "n": end - first,
        }
        levels.append(level)


def links(group: np.ndarray, fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of members of a group within ``max_bits``; sorted by group and Gray rank."""
    levels = tree(group, fps)
    top = levels[-1]
    root = np.repeat(np.arange(len(top["last"])), np.diff(np.r_[-1, top["last"]]))
    for begin in range(0, len(fps), TOGETHER):
        q = np.arange(begin, min(begin + TOGETHER, len(fps)))
        node = root[q]
        differ = np.bitwise_count((fps[q] ^ top["pattern"][node]) & top["mask"][node])
        for upper, lower in zip(levels[:0:-1], levels[-2::-1], strict=True):
            n = upper["n"][node]
            child = np.repeat(upper["child"][node], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            q, parent, differ = np.repeat(q, n), np.repeat(node, n), np.repeat(differ, n)
            fresh = lower["mask"][child] & ~upper["mask"][parent]
            differ = differ + np.bitwise_count((fps[q] ^ lower["pattern"][child]) & fresh)
            keep = (differ <= max_bits) & (lower["last"][child] > q)
            q, node, differ = q[keep], child[keep], differ[keep]
        if len(levels) > 1:
            yield q, node


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            if not (x != y).any():
                break
            low = np.minimum(x, y)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while (root[root] != root).any():
                root = root[root]
    return root


def blocks(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` runs that divide the given bits."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def star_edges(fps: DataFrame, max_bits: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints ``fp`` within ``max_bits``."""
    masks = blocks(list(range(64)), max_bits + 1)
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(i) for i in range(len(masks))])).alias("block"))
    value = F.element_at(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks]), F.col("block") + 1)
    keyed = keyed.withColumn("bits", value)
    large = keyed.groupBy("block", "bits").count().filter(F.col("count") > hot).select("block", "bits", F.lit(True).alias("large"))
    inner = [blocks([b for b in range(64) if not m >> b & 1], max_bits + 1) for m in masks]
    tables = F.array(*[F.array(*[F.lit(signed(m)) for m in ms]) for ms in inner])
    further = F.transform(
        F.element_at(tables, F.col("block") + 1),
        lambda m, i: F.struct((i + 1).alias("part"), F.col("fp").bitwiseAND(m).alias("more")),
    )
    none = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("more")))
    keyed = (
        keyed.join(large, ["block", "bits"], "left")
        .select("block", "bits", "fp", F.explode(F.when(F.col("large"), further).otherwise(none)).alias("x"))
        .select("block", "bits", "x.part", "x.more", "fp")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "bits", "part", "more"]
        held: list[pa.Table] = []

        def edges(t: pa.Table) -> pa.RecordBatch:
            cols = [np.asarray(t[c]) for c in names]
            fp = np.asarray(t["fp"]).view(U)
            order = np.lexsort((gray_rank(fp), *cols[::-1]))
            fp, cols = fp[order], [c[order] for c in cols]
            new = np.zeros(len(fp), bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            root = roots(len(fp), links(np.cumsum(new), fp, max_bits))
            far = np.flatnonzero(root != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays(
                [pa.array(fp[far].view(np.int64)), pa.array(fp[root[far]].view(np.int64))], ["a", "b"]
            )

        def key(t, i: int) -> tuple:
            return tuple(t.column(c)[i].as_py() for c in names)

        rows = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held.append(t)
            rows += len(t)
            if rows >= HOT and key(held[0], 0) != key(t, len(t) - 1):
                every = pa.concat_tables(held).combine_chunks()
                last = key(every, len(every) - 1)
                whole = np.ones(len(every), bool)
                for c, x in zip(names, last, strict=True):
                    whole &= np.asarray(every[c]) == x
                cut = len(every) - int(whole.sum())
                yield edges(every.slice(0, cut))
                held, rows = [every.slice(cut)], len(every) - cut
        if rows:
            yield edges(pa.concat_tables(held).combine_chunks())

    names = ["block", "bits", "part", "more"]
    placed = keyed.repartition(*names).sortWithinPartitions(*names)
    return placed.mapInArrow(work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of an edge (a, b).

    Large-star and small-star rounds; each keeps its edges in the checkpoint folder.
    """

    def kept(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        e = e.checkpoint()
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return e, tuple(row)

    edges, state = kept(edges)
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        edges, now = kept(small)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def use_checkpoints(spark) -> None:
    """The session's shared folder as checkpoint folder."""
    from ..runtime import shared_root

    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``; other columns are left out.

    A fingerprint is over the 3-word shingles of the text with A-Z in lower case, repeats
    included; a text of one or two words is one shingle; null and empty texts have
    fingerprint 0, which links like any other. Fingerprints link at ``max_bits`` or fewer
    differing bits; ``component_id`` is the smallest id reachable (null if all are null).
    Rows that share an id each get a row. An empty table gives an empty table.
    """
    use_checkpoints(docs.sparkSession)
    fps = fingerprints(docs, id_col, text_col).checkpoint()
    nodes = fps.groupBy("fp").agg(F.min("k").alias("least"))
    joined = components(star_edges(nodes.select("fp"), max_bits))
    placed = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(classes, "fp").select(
        F.col("k").cast(docs.schema[id_col].dataType).alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )
