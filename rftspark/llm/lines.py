"""Removal of lines that appeared earlier, also with one unit changed, added or missing.

The units of a line are its words, or, where it has few of them, its characters.
Deletion neighbourhood over units: two lines lie within one edit exactly when one of them
equals the other without a unit, or both are equal without the unit at the same place. So
a line sends the hash of itself and of each variant that lacks one unit, with the place of
that unit; equal variants meet in a bucket, where the places verify the distance. Only
lines that share a half with another line send variants: an edit leaves one half intact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rounds as R
from .substrings import mixed

U = np.uint64
#: Odd bases of the two polynomial hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 … count - 1 for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Characters(dict):
    """Hash of each character, unlike that of a word of this one character."""

    def __missing__(self, c: str) -> int:
        self[c] = xxhash.xxh3_64_intdigest(c.encode(), 1)
        return self[c]


class Lines:
    """Lines of a chunk; ``own``: the first of those with equal words. ``n`` counts units."""

    def __init__(self, texts: list[bytes | None], min_words: int, near_words: int, near_chars: int):
        self.lines = [[] if t is None else t.split(b"\n") for t in texts]
        words = [x.split() for ls in self.lines for x in ls]
        self.n_lines = np.array([len(ls) for ls in self.lines], np.int64)
        n_words = np.array([len(w) for w in words], np.int64)
        flat = xxhash.xxh3_64_intdigest
        is_near, known = n_words >= near_words, Characters()
        for i in np.flatnonzero((n_words >= min_words) & ~is_near).tolist():
            if sum(map(len, words[i])) + len(words[i]) > near_chars:
                chars = b" ".join(words[i]).decode()
                if len(chars) >= near_chars:
                    words[i], is_near[i] = chars, True
        self.n = np.array([len(w) for w in words], np.int64)
        hashes = (known[w] if type(ws) is str else flat(w) for ws in words for w in ws)
        h = np.fromiter(hashes, U, count=int(self.n.sum()))
        most = int(self.n.max(initial=0)) + 2
        self.up = [powers(b, most) for b in BASES]
        self.down = [powers(b, most) for b in INVERSES]
        at = ranges(self.n)
        self.sums = [np.r_[U(0), np.cumsum(h * up[at])] for up in self.up]
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        self.whole = [s[self.end] - s[self.start] for s in self.sums]
        self.doc = np.repeat(np.arange(len(texts)), self.n_lines)
        self.line_no = ranges(self.n_lines)
        counted = np.flatnonzero(n_words >= min_words)
        _, first, same = np.unique(self.whole[0][counted], return_index=True, return_inverse=True)
        self.counted, self.is_first = counted, np.zeros(len(counted), bool)
        self.is_first[first] = True
        self.own = counted[self.is_first]
        self.near = self.own[is_near[self.own]]
        self.far = self.own[~is_near[self.own]]

    def part(self, lane: int, start: np.ndarray, length: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """Hash of ``length`` words from ``start``, which has ``skipped`` words of its line before it."""
        s = self.sums[lane]
        return (s[start + length] - s[start]) * self.down[lane][skipped]

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the halves of each near line, as of its own length and of one less; the line."""
        keys, of, i = [], [], self.near
        for shorter in (0, 1):
            n = self.n[i] - shorter
            left = n // 2
            for side, (skip, length) in enumerate(((0 * n, left), (self.n[i] - (n - left), n - left))):
                x = self.part(0, self.start[i] + skip, length, skip)
                keys.append(mixed(x, (2 * n + side).astype(U)))
                of.append(np.arange(len(i)))
        return np.concatenate(keys), np.concatenate(of)

    def variants(self, chosen: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Hashes of the chosen lines without each of their words; place + 1; the line."""
        n = self.n[chosen]
        place, line = ranges(n), np.repeat(chosen, n)
        at, lanes = self.start[line] + place, []
        for lane in (0, 1):
            s = self.sums[lane]
            rest = (s[self.end[line]] - s[at + 1]) * U(INVERSES[lane])
            lanes.append(s[at] - s[self.start[line]] + rest)
        return lanes, place + 1, line


def _shared(data: list[bytes]) -> list[np.ndarray]:
    """Halves that two different lines have."""
    pairs = [np.frombuffer(d, U).reshape(2, -1) for d in data]
    keys, lines = np.concatenate(pairs, axis=1)
    order = np.lexsort((lines, keys))
    k, x = keys[order], lines[order]
    shared = np.unique(k[1:][(k[1:] == k[:-1]) & (x[1:] != x[:-1])])
    return [np.isin(p[0], shared) for p in pairs]


def _ends(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct halves of some chunks, sorted; their smallest and largest line; the halves as sent."""
    pairs = [np.frombuffer(d, U).reshape(2, -1) for d in data]
    keys, lines = np.concatenate(pairs, axis=1)
    order = np.lexsort((lines, keys))
    k, x = keys[order], lines[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.array([], int)
    end = np.r_[begin[1:], len(k)][: len(begin)] - 1
    return k[begin], x[begin], x[end], [p[0] for p in pairs]


def _halves_once(data: list[bytes]) -> bytes:
    """Each half of some chunks once; it goes with its smallest line."""
    keys, low, _, _ = _ends(data)
    return keys.tobytes() + low.tobytes()


def _halves_spread(data: list[bytes], bits: np.ndarray) -> list[np.ndarray]:
    """Halves that two different lines of these chunks have, or of all."""
    keys, low, high, sent = _ends(data)
    shared = (low != high) | bits[: len(keys)]
    return [shared[np.searchsorted(keys, k)] for k in sent]


def _entries(data: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """Columns (hash, check, place, id, tie, line) of all lists, and the sizes of the lists."""
    cols, sizes = [[] for _ in range(6)], []
    for d in data:
        docs, n = np.frombuffer(d, np.int64, 2)
        ids, ties, counts = np.frombuffer(d, np.int64, 3 * docs, 16).reshape(3, -1)
        at = 16 + 24 * docs
        one = (np.frombuffer(d, U, n, at), np.frombuffer(d, np.uint32, n, at + 8 * n),
               np.frombuffer(d, np.int32, n, at + 12 * n), np.repeat(ids, counts), np.repeat(ties, counts),
               np.frombuffer(d, np.int32, n, at + 16 * n))
        for c, x in zip(cols, one, strict=True):
            c.append(x)
        sizes.append(n)
    return [np.concatenate(c) for c in cols], sizes


def _has_earlier(data: list[bytes]) -> list[np.ndarray]:
    """Entries for which an earlier line lies within the edit bound."""
    (v, check, place, ids, ties, line), sizes = _entries(data)
    order = np.lexsort((line, ties, ids, check, v))
    v, check, place = v[order], check[order], place[order]
    n = len(v)
    new = np.r_[True, (v[1:] != v[:-1]) | (check[1:] != check[:-1])] if n else np.array([], bool)
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    whole = np.full(len(begin), n)
    np.minimum.at(whole, group[place == 0], np.flatnonzero(place == 0))
    pos = np.arange(n)
    by_place = np.lexsort((pos, place, group))
    g, p = group[by_place], place[by_place]
    same = np.zeros(n, bool)
    same[by_place[1:]] = (g[1:] == g[:-1]) & (p[1:] == p[:-1])
    found = np.where(place == 0, pos > begin[group], same | (whole[group] < pos)) if n else same
    out = np.zeros(n, bool)
    out[order] = found
    return np.split(out, np.cumsum(sizes)[:-1])


def _firsts(cols: list[np.ndarray]) -> np.ndarray:
    """Positions of the earliest entry of each hash and place, in their order."""
    v, check, place, ids, ties, line = cols
    order = np.lexsort((line, ties, ids, place, check, v))
    new = np.ones(len(v), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in (v, check, place)])
    return order[new]


def _entries_once(data: list[bytes]) -> bytes:
    """The earliest entry of each hash and place of some chunks, each as of a document of its own."""
    cols, _ = _entries(data)
    v, check, place, ids, ties, line = (c[_firsts(cols)] for c in cols)
    n = len(v)
    parts = (np.array([n, n], np.int64), ids, ties, np.ones(n, np.int64), v, check, place, line)
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def _entries_spread(data: list[bytes], bits: np.ndarray) -> list[np.ndarray]:
    """Any entry but the first of its hash and place has an earlier one; the firsts as told."""
    cols, sizes = _entries(data)
    found, first = np.ones(len(cols[0]), bool), _firsts(cols)
    found[first] = bits[: len(first)]
    return np.split(found, np.cumsum(sizes)[:-1])


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, near_words: int = 8,
    total_bytes: int | None = None, together: int | None = None, near_chars: int = 16,
) -> DataFrame:
    """Every document without the lines that have an earlier equal.

    A line goes if an earlier line has the same words, or, where both have ``near_words``
    words or more, differs by one word changed, added or missing. Where both have fewer
    words but ``near_chars`` characters or more (runs of white space count as one), one
    character may be changed, added or missing. All lines of the table
    are judged as they came: an earlier line counts also where it goes itself. Lines of
    fewer than ``min_words`` words, blank ones too, stay. "Earlier" goes by id, then (rows
    that share an id) by a hash of the text, then by place; null ids come last. Returns the
    columns of ``docs`` (an extra column named like a result is replaced) with the kept
    lines as text, plus ``n_lines`` and ``n_removed``. A null text stays null and has no
    lines, an empty one has one blank line. An empty table gives an empty table.
    ``total_bytes`` (of all texts; counted if not given) and ``together`` set how the work
    is divided, not its result.
    """
    total = R.text_bytes(docs, text_col) if total_bytes is None else total_bytes
    n_buckets = max(1, -(-total // R.BUCKET_BYTES))
    chunks = R.chunked(docs, id_col, text_col, total)

    def read(chunk: pa.Table) -> Lines:
        return Lines([None if x is None else x.encode() for x in chunk["t"].to_pylist()], min_words, near_words, near_chars)

    def halves(chunk: pa.Table, _: R.Answers) -> pa.Table:
        x = read(chunk)
        keys, of = x.halves()
        lines = x.whole[0][x.near][of]
        return R.lists(
            chunk["chunk"][0].as_py(), R.bucket_of(keys, n_buckets),
            lambda at: keys[at].tobytes() + lines[at].tobytes(),
        )

    def entries(x: Lines, back: R.Answers):
        """What a chunk sends in the second round: hashes, places and lines."""
        keys, of = x.halves()
        shared = np.zeros(len(x.near), bool)
        np.logical_or.at(shared, of, back.of(0, R.bucket_of(keys, n_buckets)))
        lanes, place, line = x.variants(x.near[shared])
        own = np.r_[x.near, x.far]
        salt = np.r_[np.zeros(len(x.near), U), np.full(len(x.far), 1, U)]
        v = np.r_[mixed(x.whole[0][own], salt), mixed(lanes[0], np.zeros(len(line), U))]
        check = np.r_[x.whole[1][own], lanes[1]]
        place, line = np.r_[np.zeros(len(own), np.int64), place], np.r_[own, line]
        order = np.argsort(line, kind="stable")
        return v[order], (check[order] >> U(32)).astype(np.uint32), place[order].astype(np.int32), line[order]

    def variants(chunk: pa.Table, back: R.Answers) -> pa.Table:
        if not len(chunk):
            return R.lists(0, np.array([], np.int32), bytes)
        x = read(chunk)
        v, check, place, line = entries(x, back)
        ids, ties = np.asarray(chunk["k"].fill_null(R.LAST)), np.asarray(chunk["tie"])

        def pack(at: np.ndarray) -> bytes:
            of, counts = np.unique(x.doc[line[at]], return_counts=True)
            parts = (np.array([len(of), len(at)], np.int64), ids[of], ties[of], counts.astype(np.int64), v[at],
                     check[at], place[at], line[at].astype(np.int32))
            return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

        return R.lists(chunk["chunk"][0].as_py(), R.bucket_of(v, n_buckets), pack)

    def kept(chunk: pa.Table, back: R.Answers) -> pa.Table:
        x = read(chunk)
        v, _, _, line = entries(x, back)
        gone = np.zeros(len(x.n), bool)
        gone[line[back.of(1, R.bucket_of(v, n_buckets))]] = True
        gone[x.counted[~x.is_first]] = True
        texts, lost, end = chunk["t"].to_pylist(), [], 0
        for i, ls in enumerate(x.lines):
            out = gone[end : end + len(ls)]
            end += len(ls)
            lost.append(int(np.count_nonzero(out)))
            if lost[-1]:
                texts[i] = b"\n".join(ls[j] for j in np.flatnonzero(~out)).decode()
        return pa.table(
            {
                "k": chunk["k"], "t": pa.array(texts, pa.string()), "rest": chunk["rest"],
                "n_lines": pa.array(x.n_lines, pa.int64()), "n_removed": pa.array(lost, pa.int64()),
            }
        )

    schema = T.StructType(
        [T.StructField("k", T.LongType()), T.StructField("t", T.StringType()),
         T.StructField("rest", chunks.schema["rest"].dataType), T.StructField("n_lines", T.LongType()),
         T.StructField("n_removed", T.LongType())]
    )
    steps = [
        R.Round(halves, _shared, _halves_once, _halves_spread),
        R.Round(variants, _has_earlier, _entries_once, _entries_spread),
    ]
    done = R.run_rounds(chunks, steps, kept, schema, R.n_chunks(total, R.CHUNK_BYTES), together)
    return R.unpacked(done, docs, id_col, text_col, ("n_lines", "n_removed"))
