"""Questions between chunks of documents and buckets of keys, in rounds.

Documents are dealt into chunks by a hash, once. In every round each chunk sends packed
lists of keys, one list per bucket; each bucket sees the lists of all chunks, and answers
with one bit per key it was sent. A chunk repeats its own deterministic work in the next
round to know which key a bit belongs to, so neither rows nor positions travel back.

A key goes out at most once per chunk, so a key that a third of all rows hold costs a
bucket as many entries as there are chunks. Where there are more than ``TOGETHER`` chunks,
the lists of so many are folded first: only the entries that stand for the others go on to
the bucket, and its bits are spread over the rest on the way back. Chunks and buckets are
sized by the bytes of text: a group grows with the table only by one entry per part for such a key. The chunked
documents are one shuffle that all rounds of the plan share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
#: Chunks whose lists for a bucket are folded into one where there are more chunks.
TOGETHER = 4_096
LAST = np.iinfo(np.int64).max
SENT = "bucket int, chunk int, data binary"
REPLY = "chunk int, round int, bucket int, data binary"


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def n_chunks(total: int, chunk_bytes: int) -> int:
    return max(1, -(-total // chunk_bytes))


def chunked(docs: DataFrame, id_col: str, text_col: str, total: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (chunk, k, tie, t, rest): ``rest`` holds the other columns, whatever their names.

    Documents are ordered by (k, tie); null ids come last and ``tie``, a hash of the text,
    orders rows that share an id.
    """
    n = n_chunks(total, chunk_bytes)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    tie = F.xxhash64(F.col(text_col))
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int").alias("chunk"),
        F.col(id_col).cast("long").alias("k"), tie.alias("tie"), F.col(text_col).alias("t"),
        F.struct(*others, F.lit(True).alias("_row")).alias("rest"),
    )


def in_order(chunk: pa.Table) -> pa.Table:
    """A chunk in the order of its documents, the same in every round."""
    k = np.asarray(chunk["k"].fill_null(LAST))
    return chunk.take(pa.array(np.lexsort((np.asarray(chunk["tie"]), k))))


def bytes_of(chunk: pa.Table) -> list[bytes]:
    return [(x or "").encode() for x in chunk["t"].to_pylist()]


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Answers:
    """Bits that came back to a chunk, by round and bucket."""

    def __init__(self, replies: pa.Table | None):
        self.bits: dict[tuple[int, int], bytes] = {}
        if replies is not None:
            for x in replies.select(["round", "bucket", "data"]).to_pylist():
                self.bits[x["round"], x["bucket"]] = x["data"]

    def of(self, rnd: int, bucket: np.ndarray) -> np.ndarray:
        """One bool per key that was sent, in the chunk's own order of keys."""
        out = np.zeros(len(bucket), bool)
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
            if data := self.bits.get((rnd, int(bucket[order[start]]))):
                out[order[start:end]] = np.unpackbits(np.frombuffer(data, np.uint8), count=end - start)
        return out


def lists(chunk: int, bucket: np.ndarray, pack: Callable[[np.ndarray], bytes]) -> pa.Table:
    """One row per bucket: ``pack`` of the positions whose key belongs there, in order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1 if len(order) else np.array([], int)
    rows = [(int(bucket[order[s]]), pack(order[s:e])) for s, e in zip(np.r_[0, ends[:-1]].astype(int), ends, strict=False)]
    return pa.table(
        {
            "bucket": pa.array([b for b, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()),
            "data": pa.array([d for _, d in rows], pa.binary()),
        }
    )


def answers(rnd: int, sent: pa.Table, flags: Iterable[np.ndarray]) -> pa.Table:
    """Bits for each list of a bucket."""
    data = [np.packbits(f).tobytes() for f in flags]
    return pa.table(
        {
            "chunk": sent["chunk"].cast(pa.int32()), "round": pa.array([rnd] * len(data), pa.int32()),
            "bucket": sent["bucket"].cast(pa.int32()), "data": pa.array(data, pa.binary()),
        }
    )


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of 64-bit keys whose high bits are evenly spread."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


@dataclass(frozen=True)
class Round:
    """One round: what chunks send, and how a bucket judges the lists of all.

    ``send(chunk, answers)`` gives a table SENT, ``judge(lists)`` one array of bools per
    list. ``fold(lists)`` gives a list of the same form that stands for the given ones, the
    same for any order of them, and ``spread(lists, bits)`` turns its bits into theirs.
    """

    send: Callable[[pa.Table, Answers], pa.Table]
    judge: Callable[[list[bytes]], list[np.ndarray]]
    fold: Callable[[list[bytes]], bytes]
    spread: Callable[[list[bytes], np.ndarray], list[np.ndarray]]

    def decided(self, sent: DataFrame, rnd: int) -> DataFrame:
        """REPLY of each bucket to each list."""
        judge = self.judge

        def decide(one: pa.Table) -> pa.Table:
            return answers(rnd, one, judge(one["data"].to_pylist()))

        return sent.groupBy("bucket").applyInArrow(decide, REPLY)

    def decided_in_parts(self, sent: DataFrame, rnd: int, together: int) -> DataFrame:
        """The same, with the lists of ``together`` chunks folded before they meet the others."""
        fold, spread = self.fold, self.spread
        parts = sent.withColumn("part", F.floor(F.col("chunk") / together).cast("int")).groupBy("bucket", "part")

        def folded(one: pa.Table) -> pa.Table:
            data = pa.array([fold(one["data"].to_pylist())], pa.binary())
            head = one.slice(0, 1)
            return pa.table({"bucket": head["bucket"].cast(pa.int32()), "chunk": head["part"].cast(pa.int32()), "data": data})

        def back(one: pa.Table, reply: pa.Table) -> pa.Table:
            bits = np.unpackbits(np.frombuffer(reply["data"][0].as_py(), np.uint8)).astype(bool)
            return answers(rnd, one, spread(one["data"].to_pylist(), bits))

        replies = self.decided(parts.applyInArrow(folded, SENT), rnd)
        return parts.cogroup(replies.groupBy("bucket", "chunk")).applyInArrow(back, REPLY)


def run_rounds(chunks: DataFrame, steps: list[Round], last: Callable, schema, n: int, together: int | None = None) -> DataFrame:
    """The rounds over ``n`` chunks one after the other; ``last(chunk, answers)`` gives the result."""
    groups, replies = chunks.groupBy("chunk"), None
    together = together or TOGETHER

    def with_answers(work):
        def one(chunk: pa.Table) -> pa.Table:
            return work(in_order(chunk), Answers(None))

        def both(chunk: pa.Table, back: pa.Table) -> pa.Table:
            return work(in_order(chunk), Answers(back))

        return one, both

    def applied(work, out):
        one, both = with_answers(work)
        if replies is None:
            return groups.applyInArrow(one, out)
        return groups.cogroup(replies.groupBy("chunk")).applyInArrow(both, out)

    for rnd, step in enumerate(steps):
        sent = applied(step.send, SENT)
        reply = step.decided(sent, rnd) if n <= together else step.decided_in_parts(sent, rnd, together)
        replies = reply if replies is None else replies.unionByName(reply)
    return applied(last, schema)


def unpacked(done: DataFrame, docs: DataFrame, id_col: str, text_col: str, named: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs`` in their order, less those named like a result, then the results."""
    columns = [
        F.col("k").cast(docs.schema[c].dataType).alias(c) if c == id_col else F.col("t").alias(c) if c == text_col
        else F.col(f"rest.`{c}`").alias(c)
        for c in docs.columns if c not in named
    ]
    return done.select(*columns, *named)
