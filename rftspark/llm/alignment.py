"""Two tokenizers of one text: where their tokens end together, and which tokens overlap.

Spans come first: the character offsets of one library and the byte spans of the other's
proto give coarse cuts, places where a token ends that shares no character with the next.
Between two such cuts, tokens hold parts of a character or single fallback bytes; their ends
there follow from the bytes that the entries decode to, and at every coarse cut both have
to agree.

No token of either tokenizer reaches from a character that is no white space over the space
behind it. So a text falls into units, each a run that begins with a space, and a unit has
the same tokens wherever it stands: it is encoded once in a chunk of documents.

The counts of linked id pairs are over the whole corpus. A chunk asks for its distinct pairs
only and gets one row for each back, so that what is shuffled follows the number of chunks.
"""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import operator
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import pinned, setting

#: Characters of text in a chunk, and in a part of it that is cut into units at a time; a longer text is one of its own.
CHUNK, PART = 3 << 20, 1 << 20
#: Characters encoded in one call, and units that a worker remembers from chunk to chunk.
BLOCK, REMEMBERED = 2_000, 200_000
#: Where a unit begins; a single space that ends a text stays with the unit before it.
UNIT = re.compile(r"(?<=\S)(?= (?!\Z))")
#: A pair of ids as one number: A's id times this, plus B's.
PAIR = 1 << 20
STATS = ["n_a", "n_b", "n_groups", "n_links"]


def shown_bytes() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: itself where it shows, else from 256 on."""
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}


def lengths(entries: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, entries), np.int64, len(entries))


class Aligner:
    """Tokens, groups and links of units; remembers what it has encoded."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        byte = shown_bytes()
        entries = {i: bytes(map(byte.__getitem__, t)) for t, i in self.a.get_vocab().items() if all(c in byte for c in t)}
        self.bytes_a = [entries.get(i, b"") for i in range(self.a.get_vocab_size())]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = np.fromiter(map(self.b.is_byte, range(len(pieces))), bool, len(pieces))
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if f else p.replace("▁", " ").encode()
            for p, f in zip(pieces, self.is_byte, strict=True)
        ]
        if any(b" " in p.lstrip(b" ") for p in self.bytes_b):
            raise ValueError("a piece reaches over a unit")
        self.len_a, self.len_b = lengths(self.bytes_a), lengths(self.bytes_b)
        # An id as it stands in a list of groups, before a token of its side and at the side's end.
        self.named_a, self.named_b = (
            np.array([f"{i}{mark}" for mark in marks for i in range(len(entries))], object)
            for marks, entries in ((",|", self.bytes_a), (",;", self.bytes_b))
        )
        self.proto = operator.attrgetter("id", "begin")
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []
        # Of each unit its counts and where its pairs end in ``flat``; what is new lies in blocks.
        self.stats, self.ends, self.flat = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []
        self.seen = np.zeros(0, np.int64)

    def settle(self) -> None:
        """Put the blocks behind what is known."""
        if self.fresh:
            stats, flat = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
            self.stats, self.flat = np.concatenate([self.stats, stats]), np.concatenate([self.flat, flat])
            self.ends, self.fresh = np.cumsum(self.stats[:, 3]), []

    def pairs_of(self, units: np.ndarray) -> np.ndarray:
        """The pairs of units, one unit after the other."""
        n = self.stats[units, 3]
        first = self.ends[units] - n
        return self.flat[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def forget(self) -> None:
        """Remember nothing but the units seen most often, half as many as may be remembered at most."""
        least = 2
        while (self.seen >= least).sum() > REMEMBERED // 2:
            least *= 2
        kept = np.flatnonzero(self.seen >= least)
        self.seen = self.seen[kept] // 2
        names = list(self.number)
        flat = self.pairs_of(kept)
        self.number = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.groups = [self.groups[i] for i in kept.tolist()]
        self.stats, self.flat = self.stats[kept], flat
        self.ends = np.cumsum(self.stats[:, 3])

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of both tokenizers; None where their bytes are not those of the text.

        ``text`` begins with the space that B adds itself.
        """
        data = text.encode()
        found = self.a.encode(text, add_special_tokens=False)
        ids_a = np.array(found.ids, np.int64)
        at = np.fromiter(itertools.chain.from_iterable(found.offsets), np.int64).reshape(-1, 2)
        if len(data) != len(text):
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.r_[0, np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))][at]
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        rows = np.fromiter(itertools.chain.from_iterable(map(self.proto, pieces)), np.int64).reshape(-1, 2)
        ids_b, begin = rows[:, 0], rows[:, 1] + 1
        for ids, entries in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            if b"".join(map(entries.__getitem__, ids.tolist())) != data:
                return None
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        # Coarse cuts: the next token begins with a new character, or behind the bytes of this one.
        coarse_a, coarse_b = np.flatnonzero(at[1:, 0] >= at[:-1, 1]), np.flatnonzero(begin[1:] > begin[:-1])
        if (ends_a[coarse_a] != at[coarse_a, 1]).any() or (ends_b[coarse_b] != begin[coarse_b + 1]).any():
            raise ValueError("spans and decoded bytes of a token differ")
        return ids_a, ends_a, ids_b, ends_b

    def _add(self, units: list[str]) -> bool:
        """Learn units that stand side by side; False if the bytes differ somewhere in them."""
        done = self.tokens("".join(units))
        if done is None:
            return False
        ids_a, ends_a, ids_b, ends_b = done
        stop = np.cumsum([len(u.encode()) for u in units])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        cuts = np.union1d(ends_a, ends_b)
        if not np.isin(stop, shared).all():
            raise ValueError("a token reaches over a unit")
        pair = ids_a[np.searchsorted(ends_a, cuts)] * PAIR + ids_b[np.searchsorted(ends_b, cuts)]
        place = [np.searchsorted(e, stop, "right") for e in (ends_a, ends_b, shared, cuts)]
        # Group by group, the ids of A and then those of B.
        last_a, last_b = (np.searchsorted(e, shared) for e in (ends_a, ends_b))
        of_a, of_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        ids = np.empty(len(ids_a) + len(ids_b), object)
        closes_a, closes_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        closes_a[last_a], closes_b[last_b] = len(self.bytes_a), len(self.bytes_b)
        ids[np.arange(len(ids_a)) + np.r_[0, last_b + 1][of_a]] = self.named_a[ids_a + closes_a]
        ids[np.arange(len(ids_b)) + (last_a + 1)[of_b]] = self.named_b[ids_b + closes_b]
        ids = ids.tolist()
        begin = 0
        for end in (place[0] + place[1]).tolist():
            self.groups.append("".join(ids[begin:end])[:-1])
            begin = end
        self.fresh.append((np.stack([np.diff(p, prepend=0) for p in place], axis=1), pair))
        return True

    def learn(self, units: list[str]) -> None:
        """Give every new unit a number. A unit that ends in white space is encoded alone."""
        block: list[str] = []
        size = 0

        def flush(part: list[str]) -> None:
            if not part:
                return
            begin = len(self.groups)
            if not self._add(part):
                for u in part:
                    if len(part) == 1 or not self._add([u]):
                        self.groups.append(None)
                        self.fresh.append((np.zeros((1, 4), np.int64), np.zeros(0, np.int64)))
            self.number.update(zip(part, range(begin, len(self.groups)), strict=True))

        for u in units:
            if u[-1].isspace():
                flush([u])
                continue
            block.append(u)
            size += len(u)
            if size >= BLOCK:
                flush(block)
                block, size = [], 0
        flush(block)

    def part(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(units of all texts, how many each has, groups of each)."""
        split = [UNIT.split(" " + t) if t else [] for t in texts]
        self.learn(list(set().union(*split).difference(self.number)))
        every = list(map(self.number.__getitem__, itertools.chain.from_iterable(split)))
        sizes, groups, known, begin = [], [], [], 0
        for us in split:
            found = list(map(self.groups.__getitem__, every[begin : begin + len(us)]))
            # A text with a unit whose bytes differ has no tokens at all.
            fine = None not in found
            sizes.append(len(us) if fine else 0)
            groups.append(";".join(found) if fine else "")
            known.append(every[begin : begin + len(us)] if fine else [])
            begin += len(us)
        return np.fromiter(itertools.chain.from_iterable(known), np.int32, sum(sizes)), np.array(sizes, np.int64), groups

    def chunk(self, keys: list, texts: list[str | None], with_groups: bool) -> dict:
        """One row: the documents, their units, and the units' distinct pairs."""
        if len(self.groups) > REMEMBERED:
            self.forget()
        numbers, sizes, groups, sha, begin = [], [], [], [], 0
        long = np.cumsum([len(t or "") for t in texts]) // PART
        for end in [*(np.flatnonzero(np.diff(long)) + 1).tolist(), len(texts)]:
            n, size, text = self.part(texts[begin:end])
            numbers.append(n)
            sizes.append(size)
            groups += text if with_groups else [None] * len(text)
            sha += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
            begin = end
        self.settle()
        numbers, sizes = np.concatenate(numbers), np.concatenate(sizes)
        bound = np.cumsum(sizes)
        times = np.bincount(numbers, minlength=len(self.groups))
        here = np.flatnonzero(times)
        self.seen = times + np.pad(self.seen, (0, len(times) - len(self.seen)))
        local = np.zeros(len(self.groups), np.int32)
        local[here] = np.arange(len(here))
        stats, flat = self.stats[here], self.pairs_of(here)
        n_pairs = stats[:, 3]
        pairs, of = np.unique(flat, return_inverse=True)
        unit = local[numbers]
        sums = []
        for column in stats.T:
            whole = np.r_[0, np.cumsum(column[unit])]
            sums.append(whole[bound] - whole[bound - sizes])
        return {
            "chunk": uuid.uuid4().hex, "keys": keys, **dict(zip(STATS, sums, strict=True)), "groups": groups, "sha": sha,
            "n_units": sizes, "units": unit, "unit_pairs": n_pairs, "flat": of, "pairs": pairs,
            "times": np.bincount(of, np.repeat(times[here], n_pairs), len(pairs)).astype(np.int64),
        }


LISTS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
COLUMNS = {
    "keys": "long", **dict.fromkeys(STATS, "long"), "groups": "string", "sha": "string", "n_units": "int",
    "units": "int", "unit_pairs": "int", "flat": "int",
}
ROW = "chunk string, piece int, data binary, pairs array<long>, times array<long>"
KINDS = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
NAMES = ["chunk", "piece", "data", "pairs", "times"]
#: Bytes of a piece of a chunk, pairs in a row and rows sent at once: a chunk as one row would be megabytes in the JVM.
PIECE, PAIRS, AT_ONCE = 1 << 17, 1 << 13, 8
#: Documents that a worker gets at a time, and how the pieces are written.
DOCS = 256
WRITER = {
    "parquet.block.size": 8 << 20, "parquet.enable.dictionary": "false",
    "parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 8,
}


def pieces(done: dict) -> Iterator[pa.RecordBatch]:
    """A chunk as rows ROW: its columns in compressed pieces, then its distinct pairs."""
    columns = [pa.array([done[n]], pa.list_(LISTS[kind])) for n, kind in COLUMNS.items()]
    sink = io.BytesIO()
    batch = pa.RecordBatch.from_arrays(columns, list(COLUMNS))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    data, pairs, times = sink.getvalue(), done["pairs"], done["times"]
    rows = [(i, data[at : at + PIECE], None, None) for i, at in enumerate(range(0, len(data), PIECE))]
    rows += [(None, None, pairs[at : at + PAIRS], times[at : at + PAIRS]) for at in range(0, len(pairs), PAIRS)]
    for some in (rows[at : at + AT_ONCE] for at in range(0, len(rows), AT_ONCE)):
        values = [[done["chunk"]] * len(some), *zip(*some, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, KINDS, strict=True)], NAMES)


def joined(rows: pa.Table) -> dict[str, pa.Array]:
    """Columns of the chunk whose pieces are given, in any order."""
    at = np.argsort(rows["piece"].to_numpy())
    data = rows["data"].combine_chunks()
    held = pa.ipc.open_stream(b"".join(data[i].as_py() for i in at.tolist())).read_next_batch()
    return {n: held.column(i).flatten() for i, n in enumerate(COLUMNS)}


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def chunks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool) -> DataFrame:
    """Rows ROW of all chunks, with their documents, units and distinct pairs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        keys: list = []
        texts: list = []
        size = 0

        # A few rows at a time, so that a batch does not stand in memory twice.
        for b in (b.slice(i, DOCS) for b in batches for i in range(0, len(b), DOCS)):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k)
                texts.append(t)
                size += len(t or "")
                if size >= CHUNK:
                    yield from pieces(tool.chunk(keys, texts, with_groups))
                    keys, texts, size = [], [], 0
        if keys:
            yield from pieces(tool.chunk(keys, texts, with_groups))

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return rows.mapInArrow(work, ROW)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, n, best): links of an id pair in the corpus, and whether that is the most of its B id."""
    each = parts.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    total = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")).withColumn("b", F.col("pair") % PAIR)
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_table(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n, best): the links of each id pair over all of ``docs``."""
    counts = pair_counts(chunks(docs, path_a, path_b, id_col, text_col, False))
    return counts.select((F.col("pair") / PAIR).cast("long").alias("a_id"), (F.col("pair") % PAIR).alias("b_id"), "n", "best")


def aligned(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True,
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256) of every row of ``docs``.

    A text counts with a space before it; A is a byte-level vocabulary of ``tokenizers``, B a
    ``sentencepiece`` model that adds the space itself. Groups are cut where a token of both
    ends: ``a1,a2|b1;a3|b2,b3``. A link is an occurrence of a token of A and one of B whose
    bytes overlap; the count of an id pair is its links in all of ``docs``, ``n_best`` the links
    whose count is the largest of their B id (ties included), ``count_sum`` the sum of counts.

    Null and empty texts, and those whose tokens' bytes are not the text's (U+2581 in it), have
    no tokens: zeros, and groups and digest ''. Very long texts are encoded in blocks of units; a
    single run without a space is one block. Rows that share an id, or are equal, each get a
    row and each count. Other columns are left out, so their names cannot clash. An empty table
    gives an empty table. ``with_groups=False`` leaves the groups null and keeps their digest.
    """
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", DOCS):
        parts = pinned(chunks(docs, path_a, path_b, id_col, text_col, with_groups), **WRITER)
    asked = parts.select(F.col("chunk").alias("asker"), F.explode("pairs").alias("pair"))
    answers = asked.join(pair_counts(parts), "pair").select("asker", "pair", "n", "best")
    names = ["keys", *STATS, "n_best", "count_sum", "groups", "sha"]
    out = "keys long, " + ", ".join(f"{s} long" for s in [*STATS, "n_best", "count_sum"]) + ", groups string, sha string"

    def summed(rows: pa.Table, answer: pa.Table) -> pa.Table:
        held = joined(rows)
        of, n_pairs, unit, sizes = (held[n].to_numpy(zero_copy_only=False) for n in ("flat", "unit_pairs", "units", "n_units"))
        order = np.argsort(answer["pair"].to_numpy())
        cols = []
        for values in (answer["best"].to_numpy(), answer["n"].to_numpy()):
            links = np.r_[0, np.cumsum(values[order].astype(np.int64)[of])]
            stop = np.cumsum(n_pairs)
            per_unit = links[stop] - links[stop - n_pairs]
            along = np.r_[0, np.cumsum(per_unit[unit])]
            stop = np.cumsum(sizes)
            cols.append(pa.array(along[stop] - along[stop - sizes]))
        n_best, count_sum = cols
        taken = {n: held[n] for n in ["keys", *STATS, "groups", "sha"]}
        taken |= {"n_best": n_best, "count_sum": count_sum}
        return pa.table([taken[n] for n in names], names)

    held = parts.filter(F.col("data").isNotNull()).select("chunk", "piece", "data")
    done = held.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(summed, out)
    kept = done.withColumnsRenamed({"keys": id_col, "sha": "groups_sha256"})
    return kept if with_groups else kept.drop("groups")
