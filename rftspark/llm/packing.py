"""Packing of tokenized documents into sequences of bounded length.

Sum-of-squares rule: with N(g) open sequences that have g tokens left, a piece goes where
the sum of all N(g)**2 after placing it is smallest. The rule keeps sequences of every
remaining length at hand instead of many of one kind, so later pieces find exact fits.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and words without marks whose ids a worker remembers, and their longest; others are worked out anew.
REMEMBERED, CORES, LONGEST = 200_000, 600_000, 48
#: Texts that a worker holds as words at a time, which bounds its memory.
TEXTS = 128
#: Pieces that one task packs; tables of any size are divided into as many shards as needed.
SHARD = 100_000


class WordTokenizer:
    """Ids of texts from a tokenizer file; words are encoded once and remembered.

    For tokenizers that drop white space and treat each word alone. A text that holds the
    string of a special token is encoded as a whole.
    """

    MARKS = b".,;:!?*#$%&|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.is_end = np.zeros(self.tok.get_vocab_size(), bool)
        for piece, i in self.tok.get_vocab().items():
            self.is_end[i] = piece.endswith("</w>")
        self.known: dict[int, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.ends: dict[bytes, bytes] = {}

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _cores(self, cores: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of letters alone, in one call: each ends with its one end-of-word token."""
        if not cores:
            return {}
        text = b" ".join(cores).decode()
        ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = (np.flatnonzero(self.is_end[ids]) + 1).tolist()
        if len(ends) != len(cores):
            return dict(zip(cores, self._packed([c.decode() for c in cores]), strict=True))
        data, begins = ids.tobytes(), [0, *ends[:-1]]
        return {c: data[4 * i : 4 * j] for c, i, j in zip(cores, begins, ends, strict=True)}

    def _words(self, new: list[bytes]) -> list[bytes]:
        """Ids of words. Letters, and the marks after them, are separate to the tokenizer, case aside."""
        cores, ends, marks = self.cores, self.ends, self.MARKS
        split, out, odd, missing, tails = [], [b""] * len(new), [], set(), set()
        for i, w in enumerate(new):
            core = w.rstrip(marks)
            if core.isascii():
                letters, low = core.isalpha(), core.lower()
            else:
                # In lower case, too: a letter may become two characters, the second of them a mark.
                letters, low = core.decode().isalpha() and core.decode().lower().isalpha(), core
            if not letters:
                odd.append(i)
                continue
            tail = w[len(core) :]
            split.append((i, low, tail))
            if low not in cores:
                missing.add(low)
            if tail not in ends:
                tails.add(tail)
        fresh = self._cores(list(missing))
        for tail, ids in zip(tails, self._packed([t.decode() for t in tails]), strict=True):
            ends[tail] = ids
        for i, low, tail in split:
            ids = cores.get(low)
            out[i] = (fresh[low] if ids is None else ids) + ends[tail]
        for i, ids in zip(odd, self._packed([new[i].decode() for i in odd]), strict=True):
            out[i] = ids
        if len(cores) < CORES:
            cores |= {k: v for k, v in fresh.items() if len(k) <= LONGEST}
        if len(ends) > REMEMBERED:
            ends.clear()
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit numbers."""
        words = [t.encode().split() for t in texts]
        n = np.array([len(ws) for ws in words], np.int64)
        flat = [w for ws in words for w in ws]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, count=len(flat))
        hashes, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        known, keys = self.known, hashes.tolist()
        used = [known.get(h) for h in keys]
        new = [i for i, ids in enumerate(used) if ids is None]
        for i, ids in zip(new, self._words([flat[j] for j in first[new].tolist()]) if new else [], strict=True):
            used[i] = ids
            if len(known) < REMEMBERED and len(flat[first[i]]) <= LONGEST:
                known[keys[i]] = ids
        store = np.frombuffer(b"".join(used), np.uint32)
        size = np.array([len(x) >> 2 for x in used], np.int64)
        begin = np.cumsum(size) - size
        lengths = size[word]
        ends = np.cumsum(lengths)
        at = np.repeat(begin[word] - (ends - lengths), lengths)
        every = store[at + np.arange(len(at))] if len(at) else store[:0]
        cuts = np.r_[0, ends][np.cumsum(n)][:-1] if len(n) else []
        out = np.split(every, cuts)
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = np.frombuffer(self._packed([t])[0], np.uint32)
        return out


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(
    docs: DataFrame, path: str, cap: int, end_id: int, id_col: str, text_col: str, with_ids: bool,
) -> DataFrame:
    """(k, piece, start, length, ids_crc32, ids) of every piece of every row."""
    names = ["k", "piece", "start", "length", "ids_crc32", "ids"]
    end = np.array([end_id], np.uint32).tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                texts = [t or "" for t in some.column(1).to_pylist()]
                cols: list[list] = [[] for _ in names]
                for k, ids in zip(some.column(0).to_pylist(), tok.ids(texts), strict=True):
                    ids = ids.tobytes() + end
                    for i, begin in enumerate(range(0, len(ids), 4 * cap)):
                        part = ids[begin : begin + 4 * cap]
                        row = (k, i, begin // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                        for c, x in zip(cols, row, strict=True):
                            c.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(work, "k long, piece int, start long, length long, ids_crc32 long, ids binary")


def sum_of_squares(lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece, placed in the given order."""
    count = np.zeros(cap + 1, np.int64)  # open sequences by tokens left; full ones do not count
    held: list[list[int]] = [[] for _ in range(cap + 1)]
    left: list[int] = []
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        # Moving a sequence from gap g to g - n changes the sum by 2 (N(g-n) - N(g) + 1); full: 1 - 2 N(g).
        after = 2 * count[: cap + 1 - n] + 1
        after[0] = 0
        change = after + np.where(count[n:] > 0, 1 - 2 * count[n:], 4 * len(lengths) + 4)
        fresh = int(after[cap - n])
        g = int(change.argmin())
        if change[g] <= fresh and count[g + n]:
            s = held[g + n].pop()
            count[g + n] -= 1
        else:
            g, s = cap - n, len(left)
            left.append(cap)
        seq[i], offset[i] = s, cap - left[s]
        left[s] = g
        if g:
            held[g].append(s)
            count[g] += 1
    return seq, offset


def pack(
    docs: DataFrame, path: str, cap: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False, shard: int = SHARD,
) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    A document is the ids of its text and ``end_id``; a null text counts as empty. Only
    documents longer than ``cap`` are cut, into pieces of ``cap`` tokens and a rest. Pieces
    are packed within shards of about ``shard`` pieces, longest first. Other columns are
    left out; repeated rows are packed each; an empty table gives an empty table.
    """
    from .simhash import use_checkpoints

    use_checkpoints(docs.sparkSession)
    cut = pieces(docs, path, cap, end_id, id_col, text_col, with_ids).checkpoint()
    n = max(1, -(-cut.count() // shard))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("k", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    names = ["k", "piece", "start", "length", "ids_crc32", "ids", "shard"]

    def place(rows: pa.Table) -> pa.Table:
        length, crc = np.asarray(rows["length"]), np.asarray(rows["ids_crc32"])
        keys = np.asarray(rows["k"].fill_null(np.iinfo(np.int64).max))
        order = np.lexsort((np.asarray(rows["piece"]), keys, crc, -length))
        rows = rows.select(names).take(pa.array(order))
        seq, offset = sum_of_squares(length[order], cap)
        base = np.int64(rows["shard"][0].as_py() << 32)
        return rows.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(offset))

    schema = "k long, piece int, start long, length long, ids_crc32 long, ids binary, shard int, sequence_id long, offset long"
    done = dealt.groupBy("shard").applyInArrow(place, schema)
    columns = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return done.select(F.col("k").alias(id_col), *columns)
