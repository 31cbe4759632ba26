"""Quality of a text, learned from trusted positives and unlabelled text.

Non-negative positive-unlabelled learning. The risk of a scorer is written with the class
prior p, the positives P and the unlabelled texts X: p R(P, +) + max(0, R(X, -) - p R(P, -)).
The negative part cannot truly be below zero; where an estimate falls below, the step goes
against it instead, so that the scorer does not learn the positives by heart.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound of the texts of either kind that the scorer is fitted on, by order of a hash.
SAMPLE = 6_000
MARKS = string.punctuation
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def features(text: str | None) -> list[float]:
    """Shape of a text: its characters, words and lines."""
    text = text or ""
    data = text.encode()
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    words = data.split()
    w = max(1, len(words))
    kinds = set(words)
    lines = data.split(b"\n")
    line_kinds = set(lines)
    lengths = np.fromiter(map(len, words), np.int64, count=len(words)) if words else np.zeros(1, np.int64)
    marks = [counts[ord(c)] / n for c in MARKS]
    total = sum(marks)
    return [
        np.log1p(len(data)), upper / n, lower / n, digits / n, counts[128:].sum() / n, counts[32] / n, counts[10] / n,
        upper / max(1, upper + lower), total, max(marks), np.log1p(w), len(kinds) / w, len(kinds) / w**0.8,
        lengths.mean(), lengths.std(), float(lengths.max()) ** 0.5, (lengths == 1).mean(), (lengths > 15).mean(),
        len(line_kinds) / len(lines), np.log1p(len(lines)), np.log1p(len(data) / len(lines)),
        np.log1p(max(map(len, lines))), np.log1p(total * n / w), *(np.sqrt(x) for x in marks),
    ]


WIDTH = len(features(""))


def featured(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` of the rows and ``x``, the features of their text ``t``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "t").mapInArrow(work, f"{kinds}, x array<double>")


def expanded(x: np.ndarray, centre: np.ndarray, scale: np.ndarray, mix: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Standardised features, their bounded random combinations, and a constant."""
    z = np.clip((x - centre) / scale, -6, 6)
    return np.concatenate([z, np.tanh(z @ mix + shift), np.ones((len(z), 1))], axis=1)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, hidden: int = 96) -> tuple:
    """Weights of a scorer that minimise the non-negative risk with the logistic loss."""
    rng = np.random.default_rng(7)
    both = np.concatenate([positive, unlabelled])
    centre, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    mix, shift = rng.normal(0, 0.3, (both.shape[1], hidden)), rng.normal(0, 0.5, hidden)
    p, u = (expanded(x, centre, scale, mix, shift) for x in (positive, unlabelled))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -40, 40)))
    for step in range(1, steps + 1):
        i, j = rng.integers(0, len(p), 1024), rng.integers(0, len(u), 1024)
        sp, su = p[i] @ w, u[j] @ w
        plus = -prior * (p[i] * sigmoid(-sp)[:, None]).mean(axis=0)
        minus = (u[j] * sigmoid(su)[:, None]).mean(axis=0) - prior * (p[i] * sigmoid(sp)[:, None]).mean(axis=0)
        risk = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        grad = (plus + minus if risk >= 0 else -minus) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.02 * (1 - step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return centre, scale, mix, shift, w


def learned(
    docs: DataFrame, labels: DataFrame, usable: str, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample: int = SAMPLE,
) -> tuple | None:
    """Model from the documents for which the condition ``usable`` holds; None without positives.

    Positives: documents labelled 1. Unlabelled: all documents, whatever their label. The
    class prior is estimated as the share of 1 among all usable labels. Both samples are
    the ``sample`` rows first by a hash of id and text, labels of repeated ids count once
    (the smallest), null labels do not count.
    """
    marked = labels.filter(f"{label_col} is not null").groupBy(F.col(id_col).cast("long").alias("k")).agg(F.min(label_col).alias("y"))
    rows = docs.filter(usable).select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    order = F.xxhash64("k", "t")
    share = rows.select("k").join(marked, "k").agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    if not share:
        return None
    keyed = rows.select("k", order.alias("o"))  # texts stay where they are; the chosen keys, at most ``sample``, go to them
    plain = keyed.distinct().orderBy("o").limit(sample)
    good = keyed.distinct().join(marked.filter("y = 1").select("k"), "k", "left_semi").orderBy("o").limit(sample)
    x = []
    for chosen in (good, plain):
        texts = rows.withColumn("o", order).join(F.broadcast(chosen), ["k", "o"], "left_semi").dropDuplicates(["k", "o"])
        x.append(np.array([r["x"] for r in featured(texts.select("k", "t"), ["k"]).orderBy("k").collect()]))
    return fit(*x, min(share, 0.99))


def scored(
    docs: DataFrame, model: tuple | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3,
    keep: bool = False,
) -> DataFrame:
    """(id, score, predicted) of every row of ``docs`` from its text alone.

    Null and empty texts get the score of an empty text; without a model every score is
    0.5. Other columns are left out, or with ``keep`` stay (but for those named like a
    result); repeated rows each get a row.
    """
    named = ("score", "predicted")
    names = [c for c in docs.columns if c not in named] if keep else [id_col, text_col]
    at = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(at).to_pylist()]).reshape(len(b), WIDTH)
            s = np.full(len(b), 0.5) if model is None else 1 / (1 + np.exp(-np.clip(expanded(x, *model[:4]) @ model[4], -40, 40)))
            cols = [c for i, c in enumerate(b.columns) if keep or i != at]
            cols += [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*(n for n in names if keep or n != text_col), *named])

    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    kinds = [f for f in rows.schema.fields if keep or f.name != text_col]
    schema = T.StructType([*kinds, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(work, schema)
