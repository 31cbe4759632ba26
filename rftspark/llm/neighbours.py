"""Nearest vectors by largest inner product, by multiprobe p-stable hashing.

A vector of norm r gets one more component, sqrt(M**2 - r**2) with M the largest norm, and
a query gets 0 there: then nearest in distance is largest in inner product. A table hashes
a vector by several normal projections, each cut into slots of one width. A query visits
its own bucket and perturbed ones, slots next to its own, in the order of the estimated
chance of success: the smaller the summed squared distances to the slots' edges, the
sooner. Candidates of all tables are ranked by exact inner products.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample that the index is fitted on, and queries tried there.
SAMPLE, TRIED = 8_192, 128
TABLES, PROJECTIONS = 2, 6
#: Vectors in a block: groups of buckets, and parts of a hot bucket or of its queries, of about this size.
BLOCK = 32_768
#: Share of the true neighbours in the sample that the number of probes must find.
RECALL = 0.97


@dataclass(frozen=True)
class Index:
    normals: np.ndarray  # tables x projections x (dimensions + 1)
    offsets: np.ndarray  # tables x projections
    width: float
    norm: float
    probes: int

    def slots(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Place of each vector on each projection, in slots: tables x vectors x projections."""
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(axis=1)))
        x = np.concatenate([x, extra[:, None]], axis=1)
        return np.einsum("nd,tpd->tnp", x, self.normals) / self.width + self.offsets[:, None, :]

    def probed(self, place: np.ndarray) -> np.ndarray:
        """Buckets that each query visits in one table, in order: queries x probes x projections."""
        steps = np.array(list(itertools.product((0, -1, 1), repeat=place.shape[1])))
        slot = np.floor(place)
        low = place - slot
        cost = (steps == -1) @ (low**2).T + (steps == 1) @ ((1 - low) ** 2).T
        n = min(self.probes, len(steps))
        best = np.argpartition(cost, n - 1, axis=0)[:n] if n < len(steps) else np.argsort(cost, axis=0)
        return slot[:, None, :].astype(np.int64) + steps[best.T]


def code(slots: np.ndarray) -> np.ndarray:
    """One number for the slots of a bucket."""
    out = np.zeros(slots.shape[:-1], np.int64)
    for j in range(slots.shape[-1]):
        out = out * 1_000_003 + slots[..., j].astype(np.int64)
    return out


def fit(sample: np.ndarray, norm: float, wanted: int) -> Index:
    """Width and number of probes from a sample: as few probes as reach the wanted recall there."""
    rng = np.random.default_rng(11)
    d = sample.shape[1]
    normals = rng.normal(size=(TABLES, PROJECTIONS, d + 1))
    offsets = rng.uniform(size=(TABLES, PROJECTIONS))
    spread = Index(normals, offsets, 1.0, norm, 1).slots(sample, False).std() if len(sample) else 1.0
    whole = 3**PROJECTIONS
    index = Index(normals, offsets, max(1.8 * float(spread), 1e-9), norm, whole)
    tried = sample[: min(TRIED, len(sample))]
    if not len(tried):
        return index
    near = np.argsort(-(tried @ sample.T), axis=1, kind="stable")[:, :wanted]
    at = [code(np.floor(s)) for s in index.slots(sample, False)]
    rank = np.full(near.shape, whole)
    for table, place in enumerate(index.slots(tried, True)):
        steps = np.array(list(itertools.product((0, -1, 1), repeat=PROJECTIONS)))
        slot = np.floor(place)
        low = place - slot
        cost = ((steps == -1) @ (low**2).T + (steps == 1) @ ((1 - low) ** 2).T).T
        order = np.argsort(cost, axis=1, kind="stable")
        for q in range(len(tried)):
            visited = code(slot[q].astype(np.int64) + steps[order[q]])
            found = {c: i for i, c in reversed(list(enumerate(visited.tolist())))}
            rank[q] = np.minimum(rank[q], [found.get(c, whole) for c in at[table][near[q]].tolist()])
    need = int(np.sort(rank.ravel())[min(rank.size - 1, int(np.ceil(RECALL * rank.size)) - 1)]) + 1
    return Index(normals, offsets, index.width, norm, min(need, whole))


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(v, x) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = F.exists(x, lambda c: c != 0)
    return rows.select(F.col(id_col).cast("long").alias("v"), x.alias("x")).filter("v is not null and x is not null").filter(fine & some)


def nearest(
    rows: DataFrame, every: int = 20, wanted: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``wanted`` nearest found of each query.

    Queries: rows whose id is divisible by ``every``; candidates: every row but those with
    the query's own id. The score is the inner product in double precision; ties go to
    the smaller id. Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do those without an id; vectors of unlike length never meet. Rows
    that share an id are one candidate with its best score. Other columns are left out.
    """
    from .simhash import use_checkpoints

    use_checkpoints(rows.sparkSession)
    good = usable(rows, id_col, vector_col)
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    head = good.agg(F.count("*").alias("n"), F.max(square).alias("m")).first()
    parts = [
        _search(good.filter(F.size("x") == r["d"]), r["d"], r["n"], every, wanted, block, float(np.sqrt(head["m"])) * (1 + 1e-9))
        for r in (good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect() if head["n"] else [])
    ]
    found = functools.reduce(DataFrame.unionByName, parts) if parts else good.selectExpr("v as q", "v", "0D as s")
    best = found.groupBy("q", "v").agg(F.max("s").alias("s"))
    order = Window.partitionBy("q").orderBy(F.desc("s"), "v")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("v").alias("vec_id"), F.col("s").alias("score"))


def _search(good: DataFrame, d: int, n: int, every: int, wanted: int, block: int, norm: float) -> DataFrame:
    sample = good.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    index = fit(np.array([r["x"] for r in sample], np.float64).reshape(-1, d), norm, wanted)
    groups = max(1, -(-n // block))

    def group(c: np.ndarray) -> np.ndarray:
        h = c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for table, place in enumerate(index.slots(vectors(b.column(1)).reshape(-1, d), False)):
                c = code(np.floor(place))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(c), table, np.int32)), pa.array(group(c)), pa.array(c), b.column(0), b.column(1)],
                    ["t", "g", "c", "v", "x"],
                )

    def probed(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Table, buckets in order and their groups, for each query of a batch."""
        for table, place in enumerate(index.slots(vectors(b.column(1)).reshape(-1, d), True)):
            probes = np.sort(code(index.probed(place)), axis=1)
            yield table, probes, group(probes)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for table, probes, groups_of in probed(b):
                for i, (row, g) in enumerate(zip(probes, groups_of, strict=True)):
                    used = np.unique(g)
                    k = len(used)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, table, np.int32)), pa.array(used), pa.array([row[g == u].tobytes() for u in used]),
                         pa.array([b.column(0)[i].as_py()] * k, pa.int64()), pa.array([b.column(1)[i].as_py()] * k, pa.list_(pa.float64()))],
                        ["t", "g", "probes", "q", "x"],
                    )

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for table, _, groups_of in probed(b):
                used = np.concatenate([np.array([], np.int32), *map(np.unique, groups_of)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), table, np.int32)), pa.array(used)], ["t", "g"])

    # A group is a grid: its vectors in parts, the queries that visit it in turns, so that neither grows with the table.
    def shares(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("t", "g").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias(name))

    def each(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    table = good.mapInArrow(filed, "t int, g int, c long, v long, x array<double>")
    queries = good.filter(F.pmod("v", F.lit(every)) == 0)
    ask = queries.mapInArrow(asked, "t int, g int, probes binary, q long, x array<double>")
    grid = shares(table, "parts").join(shares(queries.mapInArrow(visits, "t int, g int"), "turns"), ["t", "g"])
    left = table.join(grid, ["t", "g"]).withColumn("part", F.pmod(F.xxhash64("v"), "parts").cast("int"))
    left = left.withColumn("turn", each("turns")).drop("parts", "turns")
    right = ask.join(grid, ["t", "g"]).withColumn("turn", F.pmod(F.xxhash64("q"), "turns").cast("int"))
    right = right.withColumn("part", each("parts")).drop("parts", "turns")

    def meet(filed: pa.Table, asking: pa.Table) -> pa.Table:
        out: tuple[list, ...] = [], [], []
        if len(filed) and len(asking):
            c, v, x = np.asarray(filed["c"]), np.asarray(filed["v"]), vectors(filed["x"]).reshape(-1, d)
            order = np.lexsort((v, c))
            c, v, x = c[order], v[order], x[order]
            keys, begin = np.unique(c, return_index=True)
            end = np.r_[begin[1:], len(c)]
            repeated = len(np.unique(v)) < len(v)
            for q, y, probes in zip(asking["q"].to_pylist(), vectors(asking["x"]), asking["probes"].to_pylist(), strict=True):
                hit = np.flatnonzero(np.isin(keys, np.frombuffer(probes, np.int64)))
                n = end[hit] - begin[hit]
                at = np.repeat(begin[hit] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                at = at[v[at] != q]
                s = np.einsum("nd,d->n", x[at], y)
                if repeated:  # one candidate per id, with its best score, before any is cut
                    best = np.lexsort((-s, v[at]))
                    best = best[np.unique(v[at][best], return_index=True)[1]]
                    at, s = at[best], s[best]
                if len(at) > wanted:
                    least = np.partition(s, len(s) - wanted)[len(s) - wanted]
                    keep = s >= least
                    at, s = at[keep], s[keep]
                top = np.lexsort((v[at], -s))[:wanted]
                out[0].append(np.full(len(top), q))
                out[1].append(v[at][top])
                out[2].append(s[top])
        kinds = np.int64, np.int64, np.float64
        cols = [pa.array(np.concatenate([np.array([], k), *o]).astype(k)) for o, k in zip(out, kinds, strict=True)]
        return pa.table(dict(zip(("q", "v", "s"), cols, strict=True)))

    keys = ["t", "g", "part", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "q long, v long, s double")
