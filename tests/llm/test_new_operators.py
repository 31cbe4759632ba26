"""The alignment of tokenizers, the repair of conversations and near vectors, against plain loops."""

from __future__ import annotations

import collections
import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from rftspark.llm import alignment, conversations, tiles  # noqa: E402


def result(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- tokenizers ---------------------------------------------------------------------------------

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
TEXTS = [
    "Hé 日本😀x", "a  b\n\tc  ", "<s> <|endoftext|> x", "a ▁x", None, "", " ", "\x00a  \n x", "don't  stop\n \n now", "𐍈𐍈 𐍈é ﬁ",
    "x" * 300 + " y", "the cat sat on the mat the cat ", "  ", "　 a 　", "The cat sat.", "The cat sat.", "日本語テスト" * 40, "á ﻿ b ​",
]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_tool = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    byte = alignment.shown_bytes()
    names = {i: t for t, i in a_tool.get_vocab().items()}

    def piece(i):
        p = b_tool.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tool.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], collections.Counter()
    for k, text in rows:
        want = (" " + (text or "")).encode()
        a = a_tool.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_tool.encode(text) if text else []
        of_a = [bytes(byte[c] for c in names[i]) for i in a]
        of_b = [piece(i) for i in b]
        if b"".join(of_a) != want or b"".join(of_b) != want:
            docs.append((k, [], [], [], ""))
            continue
        owner_a = [i for i, t in enumerate(of_a) for _ in t]
        owner_b = [i for i, t in enumerate(of_b) for _ in t]
        pairs = sorted(set(zip(owner_a, owner_b, strict=True)))
        links = [(a[i], b[j]) for i, j in pairs]
        counts.update(links)
        groups, begin = [], 0
        for p in range(1, len(want) + 1):
            if p == len(want) or owner_a[p] != owner_a[p - 1] and owner_b[p] != owner_b[p - 1]:
                side = [",".join(str(ids[i]) for i in sorted(set(o[begin:p]))) for ids, o in ((a, owner_a), (b, owner_b))]
                groups.append("|".join(side))
                begin = p
        docs.append((k, a, b, links, ";".join(groups)))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (
            (k, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(counts[x] == most[x[1]] for x in links),
             sum(counts[x] for x in links), g)
            for k, a, b, links, g in docs
        ),
        key=repr,
    )


@pytest.fixture(scope="module")
def text_rows():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß日😀") for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    made = [rnd.choice(["", " ", "\n"]).join(rnd.choice([" ", " ", "  ", "\n", "\t"]) + rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(30)]
    return [*enumerate(TEXTS), *enumerate(made, 100), (100, made[0]), (None, made[1]), (200, " ".join(words * 200))]


@pytest.mark.parametrize("chunk, remembered", [(alignment.CHUNK, alignment.REMEMBERED), (200, 10)])
def test_alignment(spark, text_rows, monkeypatch, chunk, remembered):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    df = spark.createDataFrame([(k, t, "clash", "c", 1) for k, t in text_rows], "doc_id long, text string, chunk string, groups string, n_a int")
    a, b = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    want = plain_alignment(text_rows)
    # One task a chunk size: the parameters reach workers by value only where they start anew.
    tool = alignment.Aligner(a, b)
    rows = [tool.chunk([k for k, _ in part], [t for _, t in part], True) for part in (text_rows[:9], text_rows[9:])]
    assert sorted((g for r in rows for g in r["groups"]), key=repr) == sorted((w[7] for w in want), key=repr)
    done = alignment.aligned(df.repartition(3), a, b)
    assert result(done, *COLUMNS) == want
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert all(r["groups_sha256"] == digest(r["groups"]) for r in done.collect())
    assert alignment.aligned(df.limit(0), a, b, with_groups=False).count() == 0


def test_chunks_travel_in_small_pieces(spark, monkeypatch):
    rnd = random.Random(8)
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(400))
    rows = [(i, text()) for i in range(300)]
    a, b = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    # As one row this chunk took over a megabyte.
    sent = alignment.chunks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), a, b, "doc_id", "text", False)
    size = "coalesce(octet_length(data), 0) + 16 * coalesce(size(pairs), 0)"
    found = sent.selectExpr("chunk", f"{size} as n").groupBy("chunk").agg({"n": "max", "chunk": "count"}).collect()
    assert len(found) == 1 and found[0]["count(chunk)"] > 3 and found[0]["max(n)"] <= 1 << 17

    monkeypatch.setattr(alignment, "PIECE", 100)
    monkeypatch.setattr(alignment, "PAIRS", 7)
    done = alignment.Aligner(a, b).chunk(*map(list, zip(*rows[:5], (9, None), (10, ""), strict=True)), True)
    made = alignment.pa.Table.from_batches(list(alignment.pieces(done)))
    held = alignment.joined(made.filter(made["data"].is_valid()).take(list(range(20))[::-1] + list(range(20, made["data"].is_valid().to_pylist().count(True)))))
    assert all(held[n].to_pylist() == list(done[n]) for n in alignment.COLUMNS)
    for n in ("pairs", "times"):
        assert [x for r in made[n].to_pylist() for x in r or []] == list(done[n])


# --- conversations ------------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """A recursion over rows and places that compares whole audits."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(key.encode()) % 20
        if x == 0:
            continue
        text = "" if x == 1 else "".join(c for c in text if c not in ".!?") if x == 2 else text
        convs[conv] += [(turn, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
    out = []
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        faults, seen = "", set()
        for _, role, text in held:
            last = text.rstrip(WHITE)[-1:]
            faults += "b" if not last else "d" if (role, text) in seen else "t" if last not in ".!?" else "-"
            seen.add((role, text))
        initials = [r[1][:1] for r in held]
        turns = [r[0] for r in held if r[0] is not None]

        @functools.cache
        def go(i, place, run, faults=faults, initials=tuple(initials)):
            options = [(0, "")] if i == len(initials) and place in "-a" else []
            following = "a" if place == "u" else "u"
            if run < 3:
                cost, audit = go(i, following, run + 1)
                options.append((cost + 5, "I" + audit))
            if i < len(initials):
                cost, audit = go(i + 1, place, 0)
                options.append((cost + 2, "D" + audit))
                if faults[i] in "-t":
                    more = 5 * (faults[i] == "t")
                    if initials[i] == following or initials[i] == "s" and place == "-":
                        cost, audit = go(i + 1, initials[i], 0)
                        options.append((cost + more, "K" + audit))
                    cost, audit = go(i + 1, following, 0)
                    options.append((cost + more + 1, "R" + audit))
            return min(options, default=(1 << 40, ""))

        cost, audit = go(0, "-", 0)
        lines, i, place = [], 0, "-"
        for letter in audit:
            following = "a" if place == "u" else "u"
            name = {"u": "user", "a": "assistant"}[following]
            if letter == "I":
                lines.append(f"{name}:")
                place = following
                continue
            if letter != "D":
                lines.append(f"{held[i][1] if letter == 'K' else name}:{held[i][2]}")
                place = initials[i] if letter == "K" else following
            i += 1
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(), "\n".join(lines),
        ))
    return sorted(out, key=repr)


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired"]


@pytest.fixture(scope="module")
def turn_rows():
    rnd = random.Random(9)
    rows = []
    for conv in range(120):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", None, "User", ""]) if rnd.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rnd.choice(["Yes.", "No!", "cut off", "Why? ", None, "", " \t", "long " * 3 + ".", f"text {rnd.randint(0, 3)}."])
            rows.append((conv, turn + rnd.choice([0, 0, 0, 20]), role, text))
    rows = list({(r[0], r[1]): r for r in rows}.values())  # one row a turn, so that order is not a matter of ties
    rows += [(200 + i, None, "user", "No turn.") for i in range(3)] + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    return rows + [(300, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 7 else "cut") for t in range(60)]


@pytest.mark.parametrize("size", [conversations.ROWS, 4])
def test_repair(spark, turn_rows, monkeypatch, size):
    monkeypatch.setattr(conversations, "ROWS", size)
    df = spark.createDataFrame([(*r, 1, "x") for r in turn_rows], "conv_id long, turn long, role string, text string, part int, fault string")
    assert result(conversations.repaired(df.repartition(5)), *REPAIR) == plain_repair(turn_rows)
    assert conversations.repaired(df.limit(0), with_text=False).count() == 0


def test_folded_runs_equal_one():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randint(1, 30)
        rows, faults = "".join(rnd.choices("suax", k=n)), "".join(rnd.choices("----bdt", k=n))
        after, routes = [conversations.INSERT * len(conversations.ENDING[p]) for p in range(4)], []
        for i in reversed(range(0, n, 7)):
            best = []
            for place in range(4):
                ends = conversations.alignments(rows[i : i + 7], faults[i : i + 7], place)
                best.append(min((c + after[to], a, to) for to, (c, a) in ends.items()))
            after = [c for c, _, _ in best]
            routes.append(best)
        place, audit = 0, ""
        for best in reversed(routes):
            audit, place = audit + best[place][1], best[place][2]
        assert conversations.whole(rows, faults) == (after[0], audit + "I" * len(conversations.ENDING[place]))


def test_equal_rows_of_a_turn(spark):
    rows = [(2, 5, "user", "Hi."), (2, 5, "user", "Hi."), (2, 5, "user", "Hi."), (2, None, "user", "Hi."), (2, None, "user", "Hi.")]
    done = conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    damage = [zlib.crc32(k.encode()) % 20 for k in ("2:5", "2: ")]
    assert not {0, 1, 2, 3} & set(damage) and [r["duplicate"] for r in done] == [4]


# --- vectors ------------------------------------------------------------------------------------


def plain_links(rows):
    ok = [
        l is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        for _, v, l in rows
    ]
    n = len(rows)
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float64) for k in (i, j))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, least == rows[i][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def vector_rows():
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=(30, 24))
    rows = [(int(i), base[i].tolist(), int(i % 3)) for i in range(30)]
    for i in range(260):
        b = int(rnd.integers(30))
        # Most of these lie close to the threshold, on either side.
        v = base[b] + rnd.normal(size=24) * rnd.choice([0.05, 0.28, 0.4])
        rows.append((100 + i, (v * 10.0 ** int(rnd.integers(-3, 4))).tolist(), b % 3))
    rows += [(500, base[0].tolist(), 0), (500, base[0].tolist(), 0), (501, base[0].tolist(), 1), (502, base[0].tolist(), None)]
    rows += [(503, None, 0), (504, [0.0] * 24, 0), (505, [float("nan")] * 24, 0), (506, [None] * 24, 0), (507, [], 0), (508, [1.0], 0)]
    rows += [(509, [2.0], 0), (510, [-2.0], 0), (None, base[1].tolist(), 1), (None, [5.0] * 24, 9), (511, [float("inf")] + [1.0] * 23, 0)]
    return rows + [(512, [1e-200] * 24, 8), (513, [1e200] * 24, 8)]


@pytest.mark.parametrize("block, side", [(tiles.BLOCK, tiles.SIDE), (16, 16 * 9 * 24 * 2)])
def test_near_vectors(spark, vector_rows, monkeypatch, block, side):
    monkeypatch.setattr(tiles, "BLOCK", block)
    monkeypatch.setattr(tiles, "SIDE", side)
    rows = [(*r, "clash", 3) for r in vector_rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, times int").repartition(4)
    assert result(tiles.near_vectors(df), "vec_id", "n_links", "component_id", "kept") == plain_links(vector_rows)
    assert tiles.near_vectors(df.limit(0)).count() == 0


def test_error_bound_holds():
    rnd = np.random.default_rng(0)
    for d in (1, 3, 64, 1500):
        x = tiles.unit(rnd.normal(size=(200, d)) * 10.0 ** rnd.integers(-5, 5, size=(200, 1)))
        codes, steps, errors = tiles.quantised(x)
        told = tiles.products(codes, codes) * steps[:, None] * steps
        assert (np.abs(told - x @ x.T) <= errors[:, None] + (1 + errors[:, None]) * errors + 1e-12).all()
        whole = codes.astype(np.int64)
        assert (tiles.products(codes, codes) == whole @ whole.T).all()
