"""Removal of word windows that appeared earlier, found level by level.

Hashes of windows are built by doubling: the hash of 2n words comes from those of its two
halves. At the first level, of half the window, each window of full length names one of the
half-length windows inside it, the one with the smallest hash, as its anchor: equal windows
name equal anchors. Only windows whose anchor is repeated somewhere are extended to twice
the length and compared in full; the others cannot repeat. With the contract's length
the doubling ends there: a longer repeat is covered by the windows inside it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rounds as R

U = np.uint64
#: Multipliers of the two lanes of a window's hash.
LANES = ((U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)), (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)))


def mixed(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of a sequence of two hashes; the order counts."""
    m, n = LANES[lane]
    x = a * m
    x ^= x >> U(29)
    x += b
    x *= n
    x ^= x >> U(32)
    return x


def doubled(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hash of the ``length`` words from each position on, by doubling."""
    if length == 1:
        return words
    if length % 2:
        head = doubled(words, length - 1, lane)[: len(words) - length + 1]
        return mixed(head, words[length - 1 :], lane)
    half = doubled(words, length // 2, lane)
    n = max(0, len(words) - length + 1)
    return mixed(half[:n], half[length // 2 : length // 2 + n], lane)


def first_smallest(h: np.ndarray, span: int) -> np.ndarray:
    """Position of the first smallest value among ``span`` values from each position on."""
    at, width = np.arange(len(h)), 1
    while width < span:
        step = min(width, span - width)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        width += step
    return at


WHITE = np.zeros(256, bool)
WHITE[list(b" \t\n\r\x0b\x0c")] = True
#: Words of more bytes are hashed one by one; the others side by side, eight bytes at a time.
LONG_WORD = 64
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each begin to its end; eight bytes and more must stand behind the last."""
    size = end - begin
    eights = np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1))
    h, left = size.astype(U), np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        eight = eights[begin[left] + at].view("<u8")[:, 0] & FIRST_BYTES[np.minimum(size[left] - at, 8)]
        h[left] = mixed(h[left], eight, at % 16 // 8)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].tobytes())
    return h


class Windows:
    """Windows of a chunk: their anchors, and full hashes of those that may repeat."""

    def __init__(self, texts: list[bytes], window: int, n_buckets: int):
        self.window = window
        # White space behind every text, so that no word reaches into the next.
        self.data = np.frombuffer(b"\n".join([*texts, b" " * 8]), np.uint8)
        self.doc_end = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        white = WHITE[self.data]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        edge = edge if white[0] else np.r_[0, edge]
        self.begin, self.end = edge[::2], edge[1::2]
        self.ends = np.searchsorted(self.begin, self.doc_end)
        self.n_words = np.diff(self.ends, prepend=0)
        self.h = word_hashes(self.data, self.begin, self.end)
        base, total = max(1, window // 2), len(self.h)
        self.halves = doubled(self.h, base) if total >= base else np.array([], U)
        n = max(0, total - window + 1)
        starts = self.ends - self.n_words
        ok = np.zeros(n + 1, np.int64)
        long = self.n_words >= window
        np.add.at(ok, starts[long], 1)
        np.add.at(ok, (self.ends - window + 1)[long], -1)
        self.start = np.flatnonzero(np.cumsum(ok[:n]) > 0)
        at = first_smallest(self.halves, window - base + 1)[self.start] if n else np.array([], int)
        named = np.zeros(len(self.halves), bool)
        named[at] = True
        self.anchor_at, self.anchor_of = np.flatnonzero(named), (np.cumsum(named) - 1)[at]
        keys = mixed(self.halves[self.anchor_at], self.halves[self.anchor_at])
        self.keys, self.key_of, counts = np.unique(keys, return_inverse=True, return_counts=True)
        self.again = counts > 1
        self.bucket = R.bucket_of(self.keys, n_buckets)

    def extend(self, repeated: np.ndarray, n_buckets: int) -> None:
        """Full hashes of the windows whose anchor is repeated; the first of equal ones in the chunk are sent."""
        self.live = self.start[(repeated | self.again)[self.key_of[self.anchor_of]]]
        whole = [doubled(self.h, self.window, lane) for lane in (0, 1)] if len(self.live) else [np.array([], U)] * 2
        full = whole[0][self.live]
        order = np.argsort(full)
        begin = np.flatnonzero(np.r_[True, np.diff(full[order]) != 0]) if len(full) else order
        self.first = np.sort(np.minimum.reduceat(order, begin))
        self.full, self.check = full[self.first], (whole[1][self.live[self.first]] >> U(32)).astype(np.uint32)
        self.full_bucket = R.bucket_of(self.full, n_buckets)
        self.is_first = np.zeros(len(self.live), bool)
        self.is_first[self.first] = True
        self.doc = np.searchsorted(self.ends, self.live[self.first], side="right")

    def covered(self, later: np.ndarray) -> np.ndarray:
        """Words inside a window that starts earlier elsewhere; ``later``: of the windows sent."""
        repeated = ~self.is_first
        repeated[self.first[later]] = True
        at, edges = self.live[repeated], np.zeros(len(self.h) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + self.window, -1)
        return np.cumsum(edges[:-1]) > 0

    def left(self, gone: np.ndarray, rewritten: np.ndarray) -> pa.Array:
        """The texts; of those to be rewritten the words that are not ``gone``, joined by one space."""
        data, mark = self.data.copy(), np.zeros(len(self.data) + 1, np.int8)
        doc = np.repeat(np.arange(len(self.ends)), self.n_words)
        kept = np.flatnonzero(~gone & rewritten[doc])
        # A word and what stands behind it, unless it is the text's last.
        follows = np.r_[doc[kept[1:]] == doc[kept[:-1]], np.zeros(min(1, len(kept)), bool)]
        data[self.end[kept]] = 32
        mark[self.begin[kept]] += 1
        mark[self.end[kept] + follows] -= 1
        begin, whole = np.r_[0, self.doc_end[:-1]], ~rewritten
        np.add.at(mark, begin[whole], 1)
        np.add.at(mark, self.doc_end[whole] - 1, -1)
        here = np.cumsum(mark[:-1], dtype=np.int8) > 0
        size = np.r_[0, np.cumsum(here)]
        ends = np.r_[0, size[self.doc_end]]
        return pa.LargeStringArray.from_buffers(
            len(self.doc_end), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[here])
        ).cast(pa.string())


def _seen_twice(data: list[bytes]) -> list[np.ndarray]:
    """Anchors in the lists of two chunks or more. One sort of all lists, however many there are."""
    keys = [np.frombuffer(d, U) for d in data]
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    same = np.r_[False, every[1:] == every[:-1], False]
    twice = np.empty(len(order), bool)
    twice[order] = same[1:] | same[:-1]
    return np.split(twice, np.cumsum([len(k) for k in keys])[:-1])


def _anchors_once(data: list[bytes]) -> bytes:
    """The anchors of some chunks, each once."""
    return np.unique(np.concatenate([np.frombuffer(d, U) for d in data])).tobytes()


def _anchors_spread(data: list[bytes], bits: np.ndarray) -> list[np.ndarray]:
    """Anchors seen twice among these chunks, or elsewhere too."""
    keys = [np.frombuffer(d, U) for d in data]
    once, of, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    seen = (counts > 1) | bits[: len(once)]
    return np.split(seen[of], np.cumsum([len(k) for k in keys])[:-1])


def _pack(w: Windows, chunk: pa.Table) -> Callable[[np.ndarray], bytes]:
    ids, ties = np.asarray(chunk["k"].fill_null(R.LAST)), np.asarray(chunk["tie"])

    def pack(at: np.ndarray) -> bytes:
        doc = w.doc[at]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        docs, counts = doc[first], np.diff(first, append=len(doc))
        head = np.array([len(docs), len(at)], np.int64)
        parts = (head, ids[docs], ties[docs], counts.astype(np.int64), w.full[at], w.check[at])
        return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    return pack


def _firsts(every: list[np.ndarray]) -> np.ndarray:
    """Of equal windows the earliest, in the order of the windows; columns (ties, ids, check, full)."""
    ties, ids, check, full = every
    order = np.argsort(full)
    f = full[order]
    begin = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.array([], int)
    if (np.diff(begin, append=len(f)) == 1).all():
        return order
    c = check[order]
    if (np.minimum.reduceat(c, begin) != np.maximum.reduceat(c, begin)).any():
        order = np.lexsort(every)
        f, c = full[order], check[order]
        return order[np.r_[True, (f[1:] != f[:-1]) | (c[1:] != c[:-1])]]
    # The smallest id of a group, then the smallest tie among those, then the first place.
    group = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(f)))
    least = np.ones(len(f), bool)
    for column, none in ((ids[order], R.LAST), (ties[order], R.LAST), (order, len(f))):
        rest = np.where(least, column, none)
        smallest = np.minimum.reduceat(rest, begin)
        least &= rest == smallest[group]
    return smallest


def _sorted(data: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    """Columns (ties, ids, check, full) of all lists, the earliest of equal windows in the
    order of the windows, and the sizes of the lists."""
    cols, sizes = [[], [], [], []], []
    for d in data:
        docs, n = np.frombuffer(d, np.int64, 2)
        ids, ties, counts = np.frombuffer(d, np.int64, 3 * docs, 16).reshape(3, -1)
        full = np.frombuffer(d, U, n, 16 + 24 * docs)
        check = np.frombuffer(d, np.uint32, n, 16 + 24 * docs + 8 * n)
        for c, x in zip(cols, (np.repeat(ties, counts), np.repeat(ids, counts), check, full), strict=True):
            c.append(x)
        sizes.append(n)
    every = [np.concatenate(c) for c in cols]
    return every, _firsts(every), sizes


def _not_earliest(data: list[bytes]) -> list[np.ndarray]:
    """Windows whose words start earlier in another chunk."""
    every, first, sizes = _sorted(data)
    later = np.ones(len(every[0]), bool)
    later[first] = False
    return np.split(later, np.cumsum(sizes)[:-1])


def _earliest(data: list[bytes]) -> bytes:
    """The earliest of equal windows of some chunks, each as of a document of its own."""
    every, first, _ = _sorted(data)
    ties, ids, check, full = (c[first] for c in every)
    head = np.array([len(ids), len(ids)], np.int64)
    return b"".join(x.tobytes() for x in (head, ids, ties, np.ones(len(ids), np.int64), full, check))


def _earliest_spread(data: list[bytes], bits: np.ndarray) -> list[np.ndarray]:
    """Windows that are not the earliest of these chunks, or of all."""
    every, first, sizes = _sorted(data)
    later = np.ones(len(every[0]), bool)
    later[first] = bits[: len(first)]
    return np.split(later, np.cumsum(sizes)[:-1])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, joined: bool = True,
    total_bytes: int | None = None, together: int | None = None,
) -> DataFrame:
    """Every document without the words of windows that start earlier.

    Returns the columns of ``docs`` (an extra column named like a result is replaced) with
    the kept words as text, plus ``n_words`` and ``n_removed``. Words are runs without
    ASCII white space. With ``joined=False`` a text that loses nothing stays as it is;
    otherwise kept words are joined by one space. Null and empty texts have no words and
    give an empty text; texts shorter than the window lose nothing. "Earlier" goes by id,
    then (rows that share an id) by a hash of the text, then by place; null ids come last.
    An empty table gives an empty table. ``total_bytes`` (of all texts; counted if not given)
    and ``together`` set how the work is divided, not its result.
    """
    total = R.text_bytes(docs, text_col) if total_bytes is None else total_bytes
    n_buckets = max(1, -(-total // R.BUCKET_BYTES))
    chunks = R.chunked(docs, id_col, text_col, total)

    def anchors(chunk: pa.Table, _: R.Answers) -> pa.Table:
        w = Windows(R.bytes_of(chunk), window, n_buckets)
        return R.lists(chunk["chunk"][0].as_py(), w.bucket, lambda at: w.keys[at].tobytes())

    def extended(chunk: pa.Table, back: R.Answers) -> Windows:
        w = Windows(R.bytes_of(chunk), window, n_buckets)
        w.extend(back.of(0, w.bucket), n_buckets)
        return w

    def windows(chunk: pa.Table, back: R.Answers) -> pa.Table:
        if not len(chunk):
            return R.lists(0, np.array([], np.int32), bytes)
        w = extended(chunk, back)
        return R.lists(chunk["chunk"][0].as_py(), w.full_bucket, _pack(w, chunk))

    def kept(chunk: pa.Table, back: R.Answers) -> pa.Table:
        w = extended(chunk, back)
        gone = w.covered(back.of(1, w.full_bucket))
        n_gone = np.r_[0, np.cumsum(gone)]
        lost = n_gone[w.ends] - n_gone[w.ends - w.n_words]
        texts = w.left(gone, np.full(len(lost), True) if joined else lost > 0)
        return pa.table(
            {
                "k": chunk["k"], "t": texts, "rest": chunk["rest"],
                "n_words": pa.array(w.n_words, pa.int64()), "n_removed": pa.array(lost, pa.int64()),
            }
        )

    rest = chunks.schema["rest"].dataType
    schema = T.StructType(
        [T.StructField("k", T.LongType()), T.StructField("t", T.StringType()), T.StructField("rest", rest),
         T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    )
    steps = [
        R.Round(anchors, _seen_twice, _anchors_once, _anchors_spread),
        R.Round(windows, _not_earliest, _earliest, _earliest_spread),
    ]
    done = R.run_rounds(chunks, steps, kept, schema, R.n_chunks(total, R.CHUNK_BYTES), together)
    return R.unpacked(done, docs, id_col, text_col, ("n_words", "n_removed"))
