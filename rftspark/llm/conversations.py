"""Damage of conversations, and the cheapest repair to alternating turns.

The grammar of a conversation is an alternating string: ``(s?(ua)+)?``, an optional system
turn and pairs of user and assistant. Its feasible lengths are the prefixes of two
endless strings, ``uaua…`` and ``suaua…``, so one Wagner-Fischer table for each of them aligns
the turns to every length at once: column j of the last row is the cost of the target of length j.

A table is filled inside a Ukkonen band only: with an incumbent cost c, no column lies more than
c/2 deletions behind or c/5 insertions ahead of the diagonal. The incumbent begins at the
smallest cost that the faults allow and doubles until a table ends within it, which proves
that the band held the optimum. The audits of the ends that reach the optimum are traced back
over tight cells only, the smallest letter first, and compared.

A conversation is cut into chunks of bounded length. A chunk knows, for each place in the
grammar where it may begin and end, the cost and the order of the audits; places are few, so
these tables fold along the conversation, and then every chunk traces its own part. A
conversation of any length is so dealt over tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import pinned

KEEP, REROLE, DELETE, INSERT, UNDELETED = 0, 1, 2, 5, 5
#: Rows and characters of a chunk; a longer text is a chunk of its own.
ROWS, CHARACTERS = 256, 4 << 20
#: Places in the grammar: nothing yet, behind the system turn, behind a user turn, behind an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What completes a conversation that ends at a place.
ENDING = {NOTHING: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}
NAMES = {"s": "system", "u": "user", "a": "assistant"}
FAR = np.int64(1 << 40)
WHITE = " \t\n\x0b\x0c\r"


def target(place: int, length: int, system: bool) -> str:
    """What follows a place in the grammar, ``length`` turns of it."""
    head = "s" if system else "a" if place == USER else ""
    return (head + "ua" * (length // 2 + 1))[:length]


def place_after(place: int, letters: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[letters[-1]] if letters else place


@functools.lru_cache(maxsize=64)
def letter_costs(initial: str, fault: str) -> np.ndarray:
    """Cost of giving a row each letter of the target."""
    out = np.full(256, FAR)
    if fault in "-t":
        more = UNDELETED if fault == "t" else 0
        out[[ord("u"), ord("a")]] = REROLE + more
        if initial in NAMES:
            out[ord(initial)] = KEEP + more
    return out


class Table:
    """Costs of aligning rows to the prefixes of one endless target, inside a band.

    ``rows``: role initials; ``faults``: ``b`` blank, ``d`` duplicate, ``t`` truncated, ``-`` none.
    Insertions stand in front of a row, never behind the last.
    """

    def __init__(self, rows: str, faults: str, place: int, system: bool, limit: int):
        n = len(rows)
        self.n, self.rows, self.faults, self.place = n, rows, faults, place
        self.back, ahead = limit // DELETE + 1, limit // INSERT + 1
        self.width = self.back + ahead + 1
        self.text = target(place, n + ahead + 1, system)
        letters = np.frombuffer(self.text.encode(), np.uint8)
        # Column w of row i stands for target length i - back + w.
        self.insert = np.where(letters == ord("s"), FAR, INSERT)
        self.cost = np.full((n + 1, self.width), FAR)
        at = np.arange(self.width) - self.back
        self.cost[0, self.back] = 0
        for i in range(n + 1):
            row = self.cost[i]
            if i:
                before, j = self.cost[i - 1], at + i
                # The row goes (same length), or takes the letter before it (same column).
                row[:-1] = before[1:] + DELETE
                take = self.taken(i - 1)
                inside = (j >= 1) & (j <= len(letters))
                row[inside] = np.minimum(row[inside], before[inside] + take[letters[j[inside] - 1]])
            if i < n:
                j = at + i
                step = np.where((j >= 1) & (j <= len(letters)), self.insert[np.clip(j - 1, 0, len(letters) - 1)], FAR)
                step = np.cumsum(np.where(j < 1, 0, step))
                row[:] = np.minimum(FAR, np.minimum.accumulate(row - step) + step)
                row[j < 0] = FAR

    def taken(self, i: int) -> np.ndarray:
        """Cost of giving row i each letter; rows that have to go take none."""
        return letter_costs(self.rows[i], self.faults[i])

    def ends(self) -> dict[int, int]:
        """Place → smallest cost of a target that ends there."""
        out: dict[int, int] = {}
        for w in np.flatnonzero(self.cost[self.n] < FAR).tolist():
            j = self.n - self.back + w
            if 0 <= j <= len(self.text):
                to, c = place_after(self.place, self.text[:j]), int(self.cost[self.n, w])
                out[to] = min(c, out.get(to, c))
        return out

    def audit(self, to: int, best: int) -> str:
        """The smallest letters of any alignment that costs ``best`` and ends at ``to``."""
        n, cost = self.n, self.cost
        on = np.zeros((n + 1, self.width), bool)
        for w in np.flatnonzero(cost[n] == best).tolist():
            j = n - self.back + w
            on[n, w] = 0 <= j <= len(self.text) and place_after(self.place, self.text[:j]) == to
        at = np.arange(self.width) - self.back
        letters = np.frombuffer(self.text.encode(), np.uint8)
        for i in range(n - 1, -1, -1):
            j = at + i
            on[i, 1:] |= on[i + 1, :-1] & (cost[i, 1:] + DELETE == cost[i + 1, :-1])
            inside = (j >= 0) & (j < len(letters))
            take = np.where(inside, self.taken(i)[letters[np.clip(j, 0, len(letters) - 1)]], FAR)
            on[i] |= on[i + 1] & (cost[i] + take == cost[i + 1])
            step = np.where(inside, self.insert[np.clip(j, 0, len(letters) - 1)], FAR)
            tight = cost[i, :-1] + step[:-1] == cost[i, 1:]
            while (more := on[i, 1:] & tight & ~on[i, :-1]).any():
                on[i, :-1] |= more
        i, w, out = 0, self.back, []
        while i < n:
            j = i - self.back + w
            c = cost[i, w]
            if w and on[i + 1, w - 1] and c + DELETE == cost[i + 1, w - 1]:
                out.append("D")
                i, w = i + 1, w - 1
            elif w + 1 < self.width and on[i, w + 1] and c + self.insert[j] == cost[i, w + 1]:
                out.append("I")
                w += 1
            else:
                kept = self.rows[i] == self.text[j]
                out.append("K" if kept else "R")
                i += 1
        return "".join(out)


@functools.lru_cache(maxsize=50_000)
def alignments(rows: str, faults: str, place: int) -> dict[int, tuple[int, str]]:
    """End place → (cost, audit) of the best alignments of a run of rows from a place."""
    n = len(rows)
    reached = {place, USER, ASSISTANT}
    if place == NOTHING and any(r == "s" and f in "-t" for r, f in zip(rows, faults, strict=True)):
        reached.add(SYSTEM)
    limit = 8 + DELETE * sum(f != "-" for f in faults)
    while True:
        tables = [Table(rows, faults, place, s, limit) for s in ((False, True) if place == NOTHING else (False,))]
        found: dict[int, tuple[int, str]] = {}
        for t in tables:
            for to, c in t.ends().items():
                if to not in found or c <= found[to][0]:
                    option = (c, t.audit(to, c))
                    found[to] = min(found.get(to, option), option)
        # Within the incumbent, the band held all that could be better.
        if reached <= set(found) and all(c <= limit for c, _ in found.values()):
            return found
        limit *= 2


def whole(rows: str, faults: str) -> tuple[int, str]:
    """Cost and audit of a conversation in one run."""
    ends = alignments(rows, faults, NOTHING)
    return min((c + INSERT * len(ENDING[to]), a + "I" * len(ENDING[to])) for to, (c, a) in ends.items())


def _spoken(c: str, default: Column | None = None) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) after the damage that the checksum of ``conv_id:turn`` names.

    A null is one space, in the checksum too. 0 drops the row, 1 empties its text, 2 removes ``[.!?]``
    from it, 3 repeats it, 4 makes it a user's; ``copies`` says how often the row stands.
    """
    key = F.concat(_spoken("conv_id"), F.lit(":"), _spoken("turn"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), _spoken("role").alias("role"),
        _spoken("text").alias("text"), (F.crc32(key) % 20).alias("x"),
    ).filter("x <> 0")
    text = F.when(F.col("x") == 1, F.lit("")).when(F.col("x") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("x") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("x") == 3, 2).otherwise(1).cast("long")
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def faulty(rows: DataFrame) -> DataFrame:
    """Damaged rows, each copy by itself, with the first fault of each: b, d, t or -."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    key = [F.col("conv"), F.col("role"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")]
    # Null turns come first, so a row without one is earlier than any with one.
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    keyed = rows.select("*", *key[2:], order.alias("order"), last.alias("last"))
    first = keyed.groupBy("conv", "role", "h1", "h2").agg(F.min("order").alias("first"))
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))
    known = keyed.join(first, same).select("conv", "turn", "role", "text", "copies", "last", "h1", "h2", (F.col("order") == F.col("first")).alias("new"))
    each = known.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    fault = (
        F.when(F.col("last") == "", "b").when(~F.col("new") | (F.col("copy") > 1), "d")
        .when(~F.col("last").isin(".", "!", "?"), "t").otherwise("-")
    )
    return each.select("conv", "turn", "role", "text", "h1", "h2", fault.alias("fault"))


CHUNK = (
    "conv long, part int, run long, first_turn long, last_turn long, low long, high long, n_turns long, first string, "
    "last string, illegal long, rows string, faults string, roles array<string>, texts array<string>"
)
KINDS = {
    "conv": pa.int64(), "part": pa.int32(), "run": pa.int64(), "first_turn": pa.int64(), "last_turn": pa.int64(),
    "low": pa.int64(), "high": pa.int64(), "n_turns": pa.int64(), "first": pa.string(), "last": pa.string(),
    "illegal": pa.int64(), "rows": pa.string(), "faults": pa.string(), "roles": pa.list_(pa.string()),
    "texts": pa.list_(pa.string()),
}
LEGAL = {"su", "ua", "au"}


def chunked(rows: DataFrame) -> DataFrame:
    """Runs of rows of one conversation in order; (part, run) orders the runs of a conversation."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h1", "h2", "fault"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv", "turn", "role", "text", "fault", F.spark_partition_id().alias("part"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []
        runs = size = 0

        def close() -> None:
            nonlocal runs, size
            turns = [t for _, t, *_ in held if t is not None]
            initials = [r[:1] for _, _, r, *_ in held]
            wrong = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            done.append((
                held[0][0], held[0][5], runs, held[0][1], held[-1][1], min(turns, default=None), max(turns, default=None),
                len(set(turns)), initials[0], initials[-1], wrong, "".join(i if i in ("s", "u", "a") else "x" for i in initials),
                "".join(h[4] for h in held), [h[2] for h in held], [h[3] for h in held],
            ))
            held.clear()
            runs, size = runs + 1, 0

        def table() -> pa.RecordBatch:
            cols = zip(*done, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS.values(), strict=True)], list(KINDS))
            done.clear()
            return out

        for b in batches:
            waiting = 0
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= ROWS or size >= CHARACTERS):
                    waiting += size
                    close()
                    if waiting >= CHARACTERS:
                        yield table()
                        waiting = 0
                held.append(row)
                size += len(row[3])
            if done:
                yield table()
        if held:
            close()
            yield table()

    return placed.mapInArrow(work, CHUNK)


MAP = "conv long, part int, run long, illegal long, first_turn long, last_turn long, low long, high long, n_turns long, first string, last string, start int, costs array<long>, ranks array<int>"


def maps(chunks: DataFrame) -> DataFrame:
    """For each chunk and start place: cost and rank of the audit for each end place (-1: out of reach)."""
    names = ["conv", "part", "run", "illegal", "first_turn", "last_turn", "low", "high", "n_turns", "first", "last"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for place in (NOTHING, SYSTEM, USER, ASSISTANT):
                    ends = alignments(row[-2], row[-1], place)
                    order = sorted(ends, key=lambda to: ends[to][1])
                    costs = [ends[to][0] if to in ends else -1 for to in range(4)]
                    ranks = [order.index(to) if to in ends else -1 for to in range(4)]
                    out.append((*row[:-2], place, costs, ranks))
            kinds = [*(KINDS[n] for n in names), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            cols = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*names, "start", "costs", "ranks"]
            )

    return chunks.select(*names, "rows", "faults").mapInArrow(work, MAP)


ROUTE = "conv long, part int, run long, start int, end int, gaps long, illegal long, cost long"


def routes(mapped: DataFrame) -> DataFrame:
    """The start and end place of every chunk on the best way, and the totals of its conversation.

    A group holds four short rows for every ``ROWS`` turns, none of the texts.
    """

    def work(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["run"], r["start"]))
        steps = [rows[i : i + 4] for i in range(0, len(rows), 4)]
        after = [(INSERT * len(ENDING[p])) for p in range(4)]
        choice: list[list[int]] = []
        for step in reversed(steps):
            now, to = [], []
            for r in step:
                options = [(c + after[e], k, e) for e, (c, k) in enumerate(zip(r["costs"], r["ranks"], strict=True)) if c >= 0]
                c, _, e = min(options)
                now.append(c)
                to.append(e)
            after, choice = now, [*choice, to]
        heads = [s[0] for s in steps]
        lows = [h["low"] for h in heads if h["low"] is not None]
        joints = list(zip(heads, heads[1:], strict=False))
        twice = sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in joints)
        gaps = max(h["high"] for h in heads if h["high"] is not None) - min(lows) + 1 - (sum(h["n_turns"] for h in heads) - twice) if lows else 0
        illegal = sum(h["illegal"] for h in heads) + sum(a["last"] + b["first"] not in LEGAL for a, b in joints)
        place, out = NOTHING, []
        for h, to in zip(heads, reversed(choice), strict=True):
            out.append((h["conv"], h["part"], h["run"], place, to[place], gaps, illegal, after[NOTHING]))
            place = to[place]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["conv", "part", "run", "start", "end", "gaps", "illegal", "cost"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return mapped.groupBy("conv").applyInArrow(work, ROUTE)


def applied(audit: str, place: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a run."""
    rows = zip(roles, texts, strict=True)
    for letter in audit:
        if letter == "D":
            next(rows)
            continue
        role, text = ("", "") if letter == "I" else next(rows)
        expected = "a" if place == USER else "u"
        initial = role[:1] if letter == "K" else expected
        yield (role if letter == "K" else NAMES[initial]), text
        place = place_after(place, initial)


RESULT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"


def traced(chunks: DataFrame, ways: DataFrame, with_text: bool) -> DataFrame:
    """One row a conversation, from its chunks in order; a conversation streams through, chunk by chunk."""
    w = ways.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("run").alias("q"), "start", "end", "gaps", F.col("illegal").alias("wrong"), "cost")
    rows = chunks.join(w, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("run") == F.col("q")))
    rows = rows.select("conv", "part", "run", "start", "end", "gaps", "wrong", "cost", "rows", "faults", "roles", "texts")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "run")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def closed() -> tuple:
            tail = ENDING[now["place"]]
            for letter in tail:
                add(NAMES[letter], "")
            audit = "".join(now["audit"]) + "I" * len(tail)
            text = "\n".join(now["text"]) if with_text else None
            f = now["faults"]
            return (now["conv"], now["gaps"], f["b"], f["d"], f["t"], now["illegal"], now["cost"], audit, now["sha"].hexdigest(), text)

        def add(role: str, text: str) -> None:
            line = f"{role}:{text}"
            now["sha"].update((line if now["new"] else "\n" + line).encode())
            now["new"] = False
            if with_text:
                now["text"].append(line)

        def table(done: list[tuple]) -> pa.RecordBatch:
            kinds = [*[pa.int64()] * 7, *[pa.string()] * 3]
            cols = zip(*done, strict=True)
            names = [c.split()[0] for c in RESULT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            done = []
            for i in range(len(b)):
                r = {n: b.column(n)[i].as_py() for n in b.schema.names}
                if now is None or now["conv"] != r["conv"]:
                    if now:
                        done.append(closed())
                    now = {
                        "conv": r["conv"], "gaps": r["gaps"], "illegal": r["wrong"], "cost": r["cost"], "audit": [], "text": [],
                        "sha": hashlib.sha256(), "new": True, "faults": dict.fromkeys("bdt-", 0), "place": NOTHING,
                    }
                _, audit = alignments(r["rows"], r["faults"], r["start"])[r["end"]]
                now["audit"].append(audit)
                for f in "bdt":
                    now["faults"][f] += r["faults"].count(f)
                for role, text in applied(audit, r["start"], r["roles"], r["texts"]):
                    add(role, text)
                now["place"] = r["end"]
            if done:
                yield table(done)
        if now:
            yield table([closed()])

    return rows.mapInArrow(work, RESULT)


def repaired(turns: DataFrame, with_text: bool = True) -> DataFrame:
    """One row for every ``conv_id`` of ``turns`` (conv_id, turn, role, text), judged after the damage.

    Adds gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 and, ``with_text``,
    the repaired conversation. Rows are taken by turn, nulls first; rows of one turn by role and a hash
    of the text. Nulls in role and text are one space, so blank; null ids are one conversation. Equal
    rows are duplicates of the first. Very long texts and conversations of any number of turns go
    through in chunks. A conversation without rows after the damage has zeros, an empty audit and
    the digest of the empty string. Other columns are left out. An empty table gives an empty table.
    """
    chunks = pinned(chunked(faulty(damaged(turns))))
    done = traced(chunks, routes(maps(chunks)), with_text)
    ids = turns.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = hashlib.sha256().hexdigest()
    out = ids.join(done, F.col("conv_id").cast("long").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"), F.coalesce("repaired", F.lit("")).alias("repaired"),
    )
    return out if with_text else out.drop("repaired")
