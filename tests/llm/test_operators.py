"""Operators against plain loops on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import base64
import hashlib
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from rftspark.llm import bpe, imatch, language, lines, neighbours, packing, quality, simhash, substrings  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, chunk string, k long"


def texts() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    word = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared, base = word(30), "\n".join(word(12) for _ in range(8))
    rows = [(i, f"{word(rnd.randint(5, 60))}\n{word(9)} {shared if i % 4 == 0 else ''}") for i in range(0, 40, 2)]
    rows += [(41, base), (43, base), (45, base.replace(" ", "  ", 3)), (47, base.split("\n")[0] + " extra"), (49, None), (51, "")]
    rows += [(53, " \n\t "), (55, "one"), (57, "one two"), (59, "x " * 3000), (61, word(4000)), (63, base), (63, base)]
    first = base.split("\n")[1].split(" ")
    rows += [(65, " ".join(first[:-1] + ["changed"])), (67, " ".join(first[:4] + first[5:])), (None, base), (71, "日本語 テスト 1 2 3")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "clash", "c", 7) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered():
    """The rows in the order in which operators call one earlier, with repeated rows side by side."""
    big = 1 << 63
    return sorted(texts(), key=lambda r: (big if r[0] is None else r[0], r[1] or ""))


def result(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_judges_of_windows_do_not_grow_with_chunks():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 400_000).astype(np.uint64)
    lists = [np.unique(rng.choice(pool, 400)) for _ in range(1_000)]
    began = time.perf_counter()
    got = substrings._seen_twice([x.tobytes() for x in lists])
    # A search of every list in all repeated anchors took over 10 s.
    assert time.perf_counter() - began < 4
    keys, times = np.unique(np.concatenate(lists), return_counts=True)
    assert all((g == (times[np.searchsorted(keys, x)] > 1)).all() for g, x in zip(got, lists, strict=True))


def test_earliest_of_equal_windows():
    rnd = random.Random(6)
    def packed(rows):
        head = np.array([len(rows), len(rows)], np.int64)
        ids, ties, full, check = zip(*rows, strict=True)
        one = np.ones(len(rows), np.int64)
        return b"".join(np.array(x, t).tobytes() for x, t in ((head, "i8"), (ids, "i8"), (ties, "i8"), (one, "i8"), (full, "u8"), (check, "u4")))

    # With one check per hash, with several, and with ids and ties at the end of their range.
    for checks in (1, 2):
        last = np.iinfo(np.int64).max
        lists = [[(rnd.choice([1, 2, last]), rnd.choice([-3, 5, last]), h, h % 7 + rnd.randrange(checks)) for h in rnd.sample(range(40), 15)] for _ in range(9)]
        every = [r for x in lists for r in x]
        best = {}
        for at, (i, t, h, c) in enumerate(every):
            best[h, c] = min(best.get((h, c), (last, last, len(every))), (i, t, at))
        want = [best[h, c][2] != at for at, (i, t, h, c) in enumerate(every)]
        assert np.concatenate(substrings._not_earliest([packed(x) for x in lists])).tolist() == want


def test_words_and_what_is_left_of_them():
    rnd = random.Random(7)
    texts = [b"", b" ", b"a", b" a\x00 a ", b"x" * 200 + b" " + b"x" * 200 + b"y", b"\x1c a\x85b", "日本語 テスト".encode()]
    texts += [bytes(rnd.choice(b" \t\n\x0b\x0c\rab\x00\x1f") for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    w = substrings.Windows(texts, 20, 3)
    split = [t.split() for t in texts]
    words = [x for ws in split for x in ws]
    assert w.n_words.tolist() == [len(x) for x in split] and len(set(w.h.tolist())) == len(set(words))
    assert all(len({h for x, h in zip(words, w.h.tolist(), strict=True) if x == y}) == 1 for y in set(words))
    gone, anew, at = np.array([rnd.random() < 0.4 for _ in words]), np.array([rnd.random() < 0.7 for _ in texts]), 0
    for ws, text, new, got in zip(split, texts, anew, w.left(gone, anew).cast("binary").to_pylist(), strict=True):
        kept = [x for x, g in zip(ws, gone[at : at + len(ws)], strict=True) if not g]
        assert got == (b" ".join(kept) if new else text)
        at += len(ws)


@pytest.mark.parametrize("together", [None, 1, 3])
def test_substrings(docs, empty, together):
    seen, want = set(), []
    for i, t in ordered():
        w, gone = (t or "").encode().split(), set()
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone |= set(range(p, p + 20))
            seen.add(key)
        want.append((i, " ".join(x.decode() for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    done = substrings.remove_repeats(docs, total_bytes=30 << 20, together=together)
    assert result(done, "doc_id", "text", "n_words", "n_removed") == sorted(want, key=repr)
    assert {r["chunk"] for r in done.collect()} == {"c"} and done.columns.count("n_words") == 1
    assert substrings.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("together", [None, 1, 3])
def test_lines(docs, empty, together):
    seen, less, want = set(), set(), []
    for i, t in ordered():
        kept, n = [], 0
        for line in [] if t is None else t.split("\n"):
            w = tuple(line.encode().split())
            near = [w[:j] + w[j + 1 :] for j in range(len(w))] if len(w) >= 8 else []
            gone = len(w) >= 2 and (w in seen or len(w) >= 8 and (
                w in less or any((v, j) in less for j, v in enumerate(near)) or any(len(v) >= 8 and v in seen for v in near)))
            seen.add(w)
            less |= set(near) | {(v, j) for j, v in enumerate(near)}
            n += gone
            kept += [] if gone else [line]
        want.append((i, None if t is None else "\n".join(kept), n))
    done = lines.dedup_lines(docs, total_bytes=30 << 20 if together else None, together=together)
    assert result(done, "doc_id", "text", "n_removed") == sorted(want, key=repr)
    assert lines.dedup_lines(empty).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    rows = texts()
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    ids = lambda g: [i for (i, _), x in zip(rows, group, strict=True) if x == g and i is not None]
    want = [(i, f"{f:016x}", min(ids(g))) for (i, _), f, g in zip(rows, fps, group, strict=True)]
    assert result(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 10**6])
def test_links_against_all_pairs(spark, hot):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:80]:
        fps |= {f ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for _ in range(3)}
    fps = sorted(fps)
    simhash.use_checkpoints(spark)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.star_edges(df, 2, hot)).collect()}
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                    low = min(root[a], root[b], key=simhash.signed)
                    root[a] = root[b] = low
                    changed = True
    mine, plain = {}, {}
    for f in fps:
        mine.setdefault(got.get(simhash.signed(f), simhash.signed(f)), set()).add(f)
        plain.setdefault(root[f], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


def test_packing(docs, empty):
    path, cap = P.path("word_bpe_49k.json"), 64
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, cap=cap, with_ids=True, shard=40).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], np.uint32).tolist())
    for i, t in texts():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[i] == ids or i == 63
    for seq in {r["sequence_id"] for r in rows}:
        inside = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == seq)
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:j]) for j in range(len(inside))]
        assert sum(n for _, n in inside) <= cap
    assert packing.pack(empty, path).count() == 0


def test_sum_of_squares_is_the_rule():
    rnd = random.Random(1)
    lengths = [rnd.randint(1, 20) for _ in range(300)]
    seq, _ = packing.sum_of_squares(np.array(lengths), 20)
    left: dict[int, int] = {}
    for n, s in zip(lengths, seq.tolist(), strict=True):
        def total(choice):
            state = dict(left)
            state[choice] = state.get(choice, 20) - n
            counts = [list(state.values()).count(g) for g in range(1, 21)]
            return sum(c * c for c in counts)

        options = [total(x) for x in [*(x for x, g in left.items() if g >= n), -1]]
        assert total(s) == min(options)
        left[s] = left.get(s, 20) - n


ODD = ["", " ", "a  b", " a", "a \n b", "foo\n\nbar  \n x", "日本語 テスト", "😀😀 ok", "it's we'll", "x" * 300, " " * 40 + "x", "▁a ▁ b", "<|endoftext|> <s>", "a b"]


def odd_texts():
    rnd, parts = random.Random(2), ["a", "b", " ", "\n", "é", "日", "😀", "the", "ing", "▁", "'s", "1", "!", "\t", "  "]
    return ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(300)]


def test_encoding(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.codec(path, P.PATTERN)
    for t in odd_texts():
        assert c.encode(t) == enc.encode_ordinary(t) and c.decode(c.encode(t)) == t.encode()
    want = []
    for i, t in texts():
        ids = enc.encode_ordinary(t or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((i, len(ids), sha, hashlib.sha256((t or "").encode()).hexdigest()))
    done = bpe.encoded(docs, path, P.PATTERN)
    assert result(done, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe.encoded(empty, path, P.PATTERN).count() == 0


def test_prefixes_append_and_edit():
    c = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(4)
    some = lambda n: bytes(rnd.choice(b"abcdeinghtr") for _ in range(n))
    for _ in range(40):
        x = bpe.Prefixes(c.table, some(60))
        x.append(more := some(9))
        assert x.last == bpe.Prefixes(c.table, x.data).last and x.data.endswith(more)
        a = rnd.randint(0, 60)
        x.edit(a, a + rnd.randint(0, 8), some(rnd.randint(0, 5)))
        assert x.last == bpe.Prefixes(c.table, x.data).last


def test_token_counts(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), bpe.counter(path)
    old = c.CHUNK
    try:
        for c.CHUNK in (old, 5, 16):
            assert [t for t in odd_texts() if c.count(t) != len(sp.encode(t))] == []
    finally:
        c.CHUNK = old
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 100) for i, t in texts()]
    assert result(bpe.token_counts(docs, path, 100), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert bpe.token_counts(empty, path).count() == 0


def test_language(spark, docs, empty):
    rows = [("de", "der und die das ich nicht sie"), ("en", "the and of that with this have"), (None, "zzz"), ("en", None)]
    learned = language.profiles(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    asked = spark.createDataFrame([(1, "UND DAS IST DER"), (2, "and this with that"), (3, None), (4, "12 !?"), (4, "12 !?"), (5, "")], "doc_id int, text string")
    got = result(language.identify(asked, learned), "doc_id", "lang_pred")
    assert got == [(1, "de"), (2, "en"), (3, "und"), (4, "und"), (4, "und"), (5, "und")]
    assert all(0 <= r["score"] <= 1 for r in language.identify(docs, learned).collect())
    assert language.identify(empty, learned).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.profiles(empty, "text", "lang")).collect()} == {"und"}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = language.profiles(docs.filter("doc_id % 4 <> 2"), "text", "lang")
    held = language.identify(docs, learned).join(docs.select("doc_id", "lang"), "doc_id").filter("doc_id % 4 = 2")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()


def test_quality(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    whole, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learned(whole, labels, "crc32(cast(doc_id as string)) % 5 <> 0")
    held = quality.scored(whole, model).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0")
    assert held.filter("predicted = quality").count() >= 0.9 * held.count()
    assert quality.scored(docs, model).count() == docs.count() and quality.scored(empty, model).count() == 0
    assert quality.scored(docs, model, keep=True).columns == [*docs.columns, "score", "predicted"]
    assert quality.learned(empty, labels, "true") is None


@pytest.mark.parametrize("block", [15, 200])
def test_neighbours(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0, 2.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in neighbours.nearest(df, block=block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        want = [j for j in np.lexsort((np.arange(900), -s)) if j != q][:20]
        found.sort()
        hits += len({v for _, v, _ in found} & set(want))
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in {v for _, v, _ in found}
        assert all(abs(sc - s[v]) < 1e-9 for _, v, sc in found)
    assert hits >= 0.9 * 20 * len(got)
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_fingerprints(docs, empty):
    distinct = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((i, t or "") for i, t in {i: t for i, t in texts() if i is not None}.items()), reverse=True)
    got = {r["doc_id"]: r for r in imatch.fingerprints(distinct, band=(0.1, 9.0)).collect()}
    for j, (i, t) in enumerate(rows):
        after = rows[(j + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 3] + after[1][: len(t) // 3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_next"] == 1) == (r["fingerprint"] == got[after[0]]["fingerprint"]) and 0 <= r["near_edited"] <= 1
    assert got[41]["fingerprint"] == got[43]["fingerprint"]
    assert result(imatch.fingerprints(docs, largest=0), *r.asDict()) == result(imatch.fingerprints(docs), *r.asDict())
    assert imatch.fingerprints(docs).count() == docs.count() and imatch.fingerprints(empty).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline as C

    plain = docs.select(*C.COLUMNS)
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, plain, str(tmp_path)).columns == C.COLUMNS
        assert stage(spark, plain.limit(0), str(tmp_path)).count() == 0
    kept = C.near_dedup(spark, plain, str(tmp_path)).select(F.col("doc_id")).collect()
    assert {41, 43} & {r[0] for r in kept} == {41}
    assert C.run(spark, str(tmp_path)).count() > 0
