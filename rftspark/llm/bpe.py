"""Byte-pair encoding by prefixes: encoding, decoding, and token counts by a transducer.

A sequence of tokens is the encoding of its text exactly when every two neighbours are the
encoding of their own concatenation. So each prefix of a text has one valid last token:
the one whose left neighbour, the last token of the shorter prefix, it can stand next to.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units whose result a worker remembers, matches and counts likewise, and the longest that
#: it remembers; others are worked out anew, with the same result.
REMEMBERED, MATCHES, LONGEST = 400_000, 1_000_000, 48


def spark_text(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Neighbours:
    """Which tokens can stand side by side. ``ranks``: piece → rank, lower merges first."""

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.known: dict = {}

    def merged(self, text) -> list:
        """Encoding of a short text by merging the lowest rank, leftmost first."""
        rank, none = self.ranks.get, float("inf")
        parts = [text[i : i + 1] for i in range(len(text))]
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while costs and (best := min(costs)) < none:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def fit(self, left, right) -> bool:
        """Whether ``right`` can follow ``left``; ``left`` None: whether it can begin a text."""
        key = left, right
        ok = self.known.get(key)
        if ok is None:
            parts = [right] if left is None else [left, right]
            ok = self.known[key] = self.merged((left or right[:0]) + right) == parts
            if len(self.known) > 4 * REMEMBERED:
                self.known.clear()
        return ok


class Prefixes:
    """A piece of text with the last token of each of its prefixes."""

    def __init__(self, table: Neighbours, data: bytes = b""):
        self.table, self.data, self.last = table, b"", [None]
        self.append(data)

    def _token_at(self, end: int) -> bytes:
        data, last, ranks, fit = self.data, self.last, self.table.ranks, self.table.fit
        for start in range(max(0, end - self.table.longest), end):
            piece = data[start:end]
            if piece in ranks and fit(last[start], piece):
                return piece
        raise ValueError(f"no token ends at byte {end}")

    def append(self, data: bytes) -> None:
        """Add bytes; what is known of the shorter prefixes stays."""
        begin = len(self.data) + 1
        self.data = data = self.data + data
        last, ranks, fit, longest = self.last, self.table.ranks, self.table.fit, self.table.longest
        known = self.table.known
        for end in range(begin, len(data) + 1):
            for start in range(max(0, end - longest), end):
                piece = data[start:end]
                if piece in ranks:
                    left = last[start]
                    ok = known.get((left, piece))
                    if fit(left, piece) if ok is None else ok:
                        last.append(piece)
                        break
            else:
                raise ValueError(f"no token ends at byte {end}")

    def edit(self, start: int, stop: int, data: bytes) -> None:
        """Put ``data`` in place of bytes start … stop; prefixes beyond are worked out again
        only until they agree with the old ones over the length of the longest token."""
        old, tail = self.last, self.data[stop:]
        self.data, self.last = self.data[:start] + data + tail, self.last[: start + 1]
        shift, same = len(data) - (stop - start), 0
        for end in range(start + 1, len(self.data) + 1):
            if same >= self.table.longest and end - shift > stop:
                self.last += old[end - shift :]
                return
            token = self._token_at(end)
            same = same + 1 if end - shift > stop and old[end - shift] == token else 0
            self.last.append(token)

    def tokens(self) -> list[bytes]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.last[end])
        return out[::-1]


class Codec:
    """Encoding and decoding by a file of ranks."""

    def __init__(self, path: str, pattern: str):
        lines = map(bytes.split, spark_text(path).splitlines())
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.bytes_of = {r: p for p, r in self.ranks.items()}
        self.table, self.pattern = Neighbours(self.ranks), regex.compile(pattern)
        self.units: dict[str, tuple[int, ...]] = {}
        self.matches: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return [self.ranks[t] for t in Prefixes(self.table, data).tokens()]

    def _matches(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.findall(text):
            ids = self.matches.get(m)
            if ids is None:
                ids = tuple(self.piece(m.encode()))
                if len(m) <= LONGEST and len(self.matches) < MATCHES:
                    self.matches[m] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Single spaces between other characters begin a match, so what
        stands between them is worked out on its own and remembered."""
        words = text.split(" ")
        if "" in words:
            return self._matches(text)
        out: list[int] = []
        units, first = self.units, True
        for w in words:
            key = w if first else " " + w
            first = False
            ids = units.get(key)
            if ids is None:
                ids = tuple(self._matches(key))
                if len(key) <= LONGEST and len(units) < REMEMBERED:
                    units[key] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256) of every row of ``docs``.

    A null text counts as empty: no ids. Other columns are left out, so their names cannot
    clash; repeated rows each get a row. ``with_ids=False`` leaves the ids out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        names: dict[int, str] = {i: str(i) for i in c.bytes_of}
        for b in batches:
            out: tuple[list, ...] = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode(t or "")
                out[0].append(len(ids))
                out[1].append(ids if with_ids else None)
                out[2].append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                out[3].append(hashlib.sha256(c.decode(ids)).hexdigest())
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string())
            cols = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["k", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    done = rows.mapInArrow(work, "k long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
    return done.withColumnRenamed("k", id_col)


class Transducer:
    """Deterministic transducer of a merge table; transitions carry the tokens they add.

    A state holds the suffixes that some longer token may still continue: each as a node of
    the tree of pieces, with the token before it and its count relative to the whole. From
    these the last token after one more character is known. States are compiled when first
    reached; a character outside the pieces emits its bytes and leads back to the start.
    """

    START = ((0, None, 0),)

    def __init__(self, ranks: dict[str, float]):
        self.table = Neighbours(ranks)
        self.child: dict[tuple[int, str], int] = {}
        self.piece: dict[int, str] = {}
        self.inner: set[int] = set()
        n = 0
        for p in ranks:
            node = 0
            for c in p:
                if (to := self.child.get((node, c))) is None:
                    n += 1
                    to = self.child[node, c] = n
                    self.inner.add(node)
                node = to
            self.piece[node] = p
        self.restart()

    def restart(self) -> None:
        self.states, self.numbers = [self.START], {self.START: 0}
        self.step: dict[tuple[int, str], tuple[int, int]] = {}

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        moved, last, more = [], None, 0
        for node, left, rel in self.states[state]:
            to = self.child.get((node, c))
            if to is None:
                continue
            p = self.piece.get(to)
            if p is not None and last is None and self.table.fit(left, p):
                last, more = p, rel + 1
            if to in self.inner:
                moved.append((to, left, rel))
        if last is None:
            target, more = self.START, len(c.encode())
        else:
            target = (*((to, left, rel - more) for to, left, rel in moved), (0, last, 0))
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states)
            self.states.append(target)
        return self.step.setdefault((state, c), (number, more))

    def count(self, text: str) -> int:
        """Tokens of a text from the start state."""
        if len(self.states) > REMEMBERED // 2 or len(self.step) > REMEMBERED:
            self.restart()
        state = total = 0
        step = self.step
        for c in text:
            state, more = step.get((state, c)) or self._compile(state, c)
            total += more
        return total


#: White space that begins a unit: no piece reaches over it from the left.
UNIT = re.compile(r" +[^ \n]*|\n[^ \n]*|^[^ \n]+")


class Counter:
    """Counts of tokens of whole texts, by chunks whose maps are composed.

    The map of a chunk is (head, count, tail): what stands before its first boundary, the
    tokens between, and what follows its last boundary, as every state leads to the same
    one there. A chunk without a boundary is all head. Maps are composed pairwise in
    rounds, so that chunks need not wait for each other.
    """

    CHUNK = 1 << 16

    def __init__(self, ranks: dict[str, float], mark: str):
        if any(mark in p.lstrip(mark) or ("\n" in p) for p in ranks):
            raise ValueError("a piece reaches over a boundary")
        self.machine, self.mark, self.units = Transducer(ranks), mark, {}

    def unit(self, text: str) -> int:
        n = self.units.get(text)
        if n is None:
            n = self.machine.count(text.replace(" ", self.mark))
            if len(text) <= LONGEST and len(self.units) < MATCHES:
                self.units[text] = n
        return n

    def mapped(self, chunk: str) -> tuple[str, int | None, str]:
        units = UNIT.findall(chunk)
        head = units.pop(0) if units and units[0][0] not in " \n" else ""
        if not units:
            return head, None, ""
        tail, get = units.pop(), self.units.get
        total = 0
        for u in units:
            n = get(u)
            total += self.unit(u) if n is None else n
        return head, total, tail

    def composed(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        middle = a[2] + b[0]
        return (a[0], a[1] + sum(map(self.unit, UNIT.findall(middle))) + b[1], b[2])

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = " " + text.replace(self.mark, " ")
        cuts, i = [], 0
        while i < len(text):
            end = min(i + self.CHUNK, len(text))
            while end < len(text) and text[end] == " ":  # a run of spaces stays in one chunk
                end += 1
            cuts.append(text[i:end])
            i = end
        maps = [self.mapped(c) for c in cuts]
        while len(maps) > 1:
            pairs = [self.composed(*maps[j : j + 2]) for j in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) - len(maps) % 2 :]
        head, total, tail = maps[0]
        return sum(map(self.unit, UNIT.findall(head))) + (total or 0) + (self.unit(tail) if tail else 0)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    import sentencepiece.sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(spark_text(path))
    return Counter({p.piece: -p.score for p in model.pieces if p.type == 1}, "▁")


def token_counts(
    docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
    make: Callable[[str], Counter] = counter,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    A null text counts as empty: no bytes, no tokens. Other columns are left out; repeated
    rows each get a row; an empty table gives an empty table.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = make(path)
        for b in batches:
            n = [c.count(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["k", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"), size.alias("n_bytes"))
    done = rows.mapInArrow(work, "k long, n_bytes long, n_tokens long")
    return done.select(F.col("k").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
