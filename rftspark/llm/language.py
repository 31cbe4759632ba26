"""Language of a text by rank-order profiles of its character n-grams.

A profile lists the most frequent n-grams in order. The distance of a document to a
language is the sum, over the document's profile, of how far each n-gram is out of place
in the language's profile; one that is absent there counts as the whole profile length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

U = np.uint64
#: N-grams in a profile.
PROFILE = 300


def _letters() -> np.ndarray:
    """For every code point, its lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


#: Cells of a table of counts; texts of more different letters are counted by sorting.
CELLS = 1 << 20


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams of the letters of a text; other characters end a word.

    A code packs three characters of 21 bits, the last ones lowest and 0 for a blank; a word
    is taken with a blank before and behind it, and a blank alone is no n-gram.
    """
    if not _TABLE:
        _TABLE.append(_letters())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([np.zeros(1, np.uint32), _TABLE[0][points], np.zeros(1, np.uint32)])
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]  # one blank between words
    letters, small = np.unique(c, return_inverse=True)
    n, letters = len(letters), letters.astype(U)
    # Numbers in base n: one digit, n plus two digits, n + n * n plus three digits.
    small = small.astype(np.int64)
    two = small[:-1] * n + small[1:]
    three = (two[:-1] * n + small[2:])[small[1:-1] > 0]
    every = np.concatenate([small[small > 0], two + n, three + n + n * n])
    if n + n * n + n**3 <= CELLS:
        counts = np.bincount(every)
        every = np.flatnonzero(counts)
        counts = counts[every]
    else:
        every, counts = np.unique(every, return_counts=True)
    i, j = np.searchsorted(every, [n, n + n * n])
    d, e = every[i:j] - n, every[j:] - n - n * n
    codes = np.concatenate([
        letters[every[:i]] | U(1) << U(63),
        letters[d // n] << U(21) | letters[d % n] | U(3) << U(62),
        letters[e // (n * n)] << U(42) | letters[e // n % n] << U(21) | letters[e % n],
    ])
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties to the smaller code as a signed number."""
    if len(codes) > size:
        cut = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= cut
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes.view(np.int64), -counts))][:size]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def profiles(labelled: DataFrame, text: str, lang: str, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the profile of each language over all its texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for name, (codes, counts) in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)],
                    ["lang", "gram", "n"],
                )
            sums.clear()

        for b in batches:
            waiting: dict[str, list] = {}
            held = 0
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = grams(t)
                held += len(g[0])
                waiting.setdefault(name, []).append(g)
                if held > 1 << 21:
                    sums |= {k: merged([*([sums[k]] if k in sums else []), *parts]) for k, parts in waiting.items()}
                    waiting, held = {}, 0
            sums |= {k: merged([*([sums[k]] if k in sums else []), *parts]) for k, parts in waiting.items()}
            if sum(len(x[0]) for x in sums.values()) > 1 << 21:
                yield from out()
        yield from out()

    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    counts = rows.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < size).drop("n")


def identify(
    docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE,
) -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``; only the text is looked at.

    ``learned``: profiles as above; they reach the driver, ``size`` rows per language. The
    score is the nearness to the language chosen as a share of the nearness to all. A null
    text and one without a letter is ``und`` with score 0, as are all if nothing was
    learned. Ties go to the name that sorts first. Other columns are left out.
    """
    names, codes, places = [], [], []
    for r in learned.orderBy("lang", "place").collect():
        if not names or names[-1] != r["lang"]:
            names.append(r["lang"])
            codes.append([])
        codes[-1].append(r["gram"])
    every = np.unique(np.concatenate([np.array(c, np.int64).view(U) for c in codes])) if names else np.array([], U)
    places = np.full((len(names), len(every) + 1), size, np.int64)  # the last column: known to no language
    for row, c in zip(places, codes, strict=True):
        row[np.searchsorted(every, np.array(c, np.int64).view(U))] = np.arange(len(c))
    absent = places == size

    def one(text: str | None) -> tuple[str, float]:
        codes, counts = grams(text or "")
        if not names or not ((codes >> U(62)) == U(2)).any():  # no single letter
            return "und", 0.0
        own = ranked(codes, counts, size)
        at = np.minimum(np.searchsorted(every, own), len(every) - 1)
        at = np.where(every[at] == own, at, len(every))
        far = np.where(absent[:, at], size, np.abs(places[:, at] - np.arange(len(own)))).sum(axis=1)
        near = 1 - far / (size * len(own))
        best = int(far.argmin())
        return names[best], float(near[best] / near.sum()) if near.sum() > 0 else 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(t) for t in b.column(1).to_pylist()]
            pred, score = pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pred, score], ["k", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(work, "k long, lang_pred string, score double").withColumnRenamed("k", id_col)
