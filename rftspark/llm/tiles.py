"""Near-duplicate vectors of one label, by products of int8 tiles.

Every vector is scaled to length 1 and rounded to int8 with a step of its own; the length e of
what rounding took away is computed, not assumed. For two vectors a, b with rounded forms a', b':

    |a·b - a'·b'| = |(a-a')·b + a'·(b-b')| <= e_a + (1 + e_a) e_b

so a pair whose product of codes lies further below the threshold than that cannot reach it.
Tiles of codes are multiplied whole, exactly (sums of int8 products are small integers), and
only pairs that may reach the threshold are computed again, in double precision, from the
original vectors.

Equal vectors of a label are one node with a count. Nodes are dealt into blocks by content and
blocks into squares of bounded bytes, so a label of any size is a grid of tasks. A square gives
each node its number of links there and one edge to the root of its component there: never
all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import pinned
from .simhash import components, roots, use_checkpoints

#: Vectors in a block, bytes of vectors in one side of a square, and bytes in the work on candidates.
BLOCK, SIDE, WORK = 1_024, 16 << 20, 16 << 20
#: Dimensions whose int8 products are summed exactly in single precision.
EXACT = 1 << 10
#: More than rounding in double precision can add to a product of two vectors of length 1.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, steps, errors) of vectors of length 1."""
    step = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / step[:, None]).astype(np.int8)
    return codes, step, np.linalg.norm(x - codes * step[:, None], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 codes."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT):
        out += a[:, i : i + EXACT].astype(np.float32) @ b[:, i : i + EXACT].astype(np.float32).T
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    scale = [np.abs(v).max(axis=1, keepdims=True) for v in (x, y)]
    x, y = x / scale[0], y / scale[1]
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def linked(a: dict, b: dict, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of two blocks whose cosine reaches the threshold; i < j within one block."""
    rows = max(1, WORK // (64 * len(b["codes"])))
    few = max(1, WORK // (64 * a["vectors"].shape[1]))
    for begin in range(0, len(a["codes"]), rows):
        part = slice(begin, begin + rows)
        near = products(a["codes"][part], b["codes"]) * a["steps"][part, None] * b["steps"]
        error = a["errors"][part, None] + (1 + a["errors"][part, None]) * b["errors"]
        i, j = np.nonzero(near + error + SLACK >= threshold)
        i = i + begin
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), few):
            x, y = i[k : k + few], j[k : k + few]
            reach = cosines(a["vectors"][x], b["vectors"][y]) >= threshold
            yield x[reach], y[reach]


BLOCKS = (
    "label long, d int, block long, side long, nodes array<string>, times array<long>, "
    "vectors binary, codes binary, steps binary, errors binary"
)


def packed(nodes: DataFrame) -> DataFrame:
    """One row a block: its nodes with codes, steps and error bounds."""

    def work(group: pa.Table) -> pa.Table:
        d = group["d"][0].as_py()
        x = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        codes, steps, errors = quantised(unit(x))
        row = [
            *(group[n][0].as_py() for n in ("label", "d", "block", "side")), group["node"].to_pylist(),
            group["times"].to_pylist(), *(v.tobytes() for v in (x, codes, steps, errors)),
        ]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 4]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return nodes.groupBy("label", "d", "block").applyInArrow(work, BLOCKS)


def squares(blocks: DataFrame, threshold: float) -> DataFrame:
    """(node, n, root) for each square: links with other nodes, weighted by their count, and an edge to a root."""
    most = blocks.groupBy("label", "d").agg(F.max("side").alias("last"))
    keyed = blocks.join(most.withColumnsRenamed({"label": "l", "d": "e"}), (F.col("label") == F.col("l")) & (F.col("d") == F.col("e")))
    # Side s meets every side t: in the square (min, max), as its rows or its columns.
    met = F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("t")
    dealt = keyed.select(*blocks.columns, met).withColumns({"low": F.least("side", "t"), "high": F.greatest("side", "t")})

    def work(group: pa.Table) -> pa.Table:
        held = []
        for r in sorted(group.to_pylist(), key=lambda r: r["block"]):
            n = len(r["nodes"])
            held.append({
                "side": r["side"], "nodes": r["nodes"], "times": np.array(r["times"], np.int64),
                "vectors": np.frombuffer(r["vectors"]).reshape(n, -1), "codes": np.frombuffer(r["codes"], np.int8).reshape(n, -1),
                "steps": np.frombuffer(r["steps"]), "errors": np.frombuffer(r["errors"]),
            })
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        base = np.cumsum([0, *(len(h["nodes"]) for h in held)])
        times = np.concatenate([h["times"] for h in held])
        n = np.zeros(len(times), np.int64)
        root = np.arange(len(times))
        for p, a in enumerate(held):
            for q in range(p, len(held)):
                if {a["side"], held[q]["side"]} != {low, high}:
                    continue
                for x, y in linked(a, held[q], threshold, p == q):
                    x, y = x + base[p], y + base[q]
                    np.add.at(n, x, times[y])
                    np.add.at(n, y, times[x])
                    root = joined(root, x, y)
        names = [k for h in held for k in h["nodes"]]
        some = np.flatnonzero(n).tolist()
        cols = [[names[i] for i in some], n[some], [names[root[i]] for i in some]]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()), strict=True)], ["node", "n", "root"])

    return dealt.groupBy("label", "d", "low", "high").applyInArrow(work, "node string, n long, root string")


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Roots after more links between (x, y)."""
    return roots(len(root), iter([(np.arange(len(root)), root), (x, y)]))


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``.

    Two rows link when their labels are equal and not null, their vectors have one length and their
    cosine in double precision is ``threshold`` or more, which is above 0. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable, ``kept`` says that
    it is the row's own. Vectors that are null, zero, empty or hold null or non-finite components
    link with nothing, as do those without a label. Rows that share an id are rows of their own
    (ids may be null: they are passed over in ``component_id``, which is null if all are null;
    null is then its own). Other columns are left out, so their names cannot clash. An empty
    table gives an empty table.
    """
    use_checkpoints(vectors.sparkSession)
    label = F.col(label_col).cast("long")
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("k"), label.alias("label"), x.alias("vector"))
    fine = (
        F.col("label").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda v: v != 0)
        & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    )
    content = [F.col("label"), F.col("vector")]
    node = F.concat(F.hex(F.xxhash64(*content)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), *content)))
    known = pinned(rows.select("k", F.when(F.coalesce(fine, F.lit(False)), node).alias("node"), "label", "vector"))
    valid = known.filter("node is not null")
    nodes = valid.groupBy("node", "label", "vector").agg(F.count("*").alias("times"), F.min("k").alias("least"))
    nodes = pinned(nodes.withColumn("d", F.size("vector")))
    # Blocks by content, a count of them for each label and length; sides of a bounded number of blocks.
    total = nodes.groupBy("label", "d").agg(F.count("*").alias("total")).withColumnsRenamed({"label": "l", "d": "e"})
    n_blocks = F.ceil(F.col("total") / BLOCK)
    per_side = F.greatest(F.lit(1), F.floor(F.lit(SIDE) / (BLOCK * 9 * F.col("d"))))
    dealt = nodes.join(total, (F.col("label") == F.col("l")) & (F.col("d") == F.col("e"))).withColumn("block", F.pmod(F.xxhash64("node"), n_blocks))
    dealt = dealt.select("node", "label", "d", "vector", "times", "block", F.floor(F.col("block") / per_side).alias("side"))
    found = pinned(squares(packed(dealt), threshold))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined_up = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = nodes.select("node", "least", "times")
    placed = least.join(joined_up.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    placed = placed.select("node", "least", "times", F.coalesce("root", "node").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    classes = placed.join(named, F.col("root") == F.col("r")).join(links.withColumnsRenamed({"node": "o"}), F.col("node") == F.col("o"), "left")
    classes = classes.select(F.col("node").alias("c"), "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = known.select("k", "node").join(classes, F.col("node") == F.col("c"), "left")
    component = F.when(F.col("node").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return out.select(
        F.col("k").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("k")).alias("kept"),
    )
