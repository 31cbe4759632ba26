"""Fingerprints against a plain loop: terms, document frequencies, band, lexicons, likeness."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash

from rftspark.llm import imatch


def xx(values, seed=42):
    """Hash of 64-bit numbers one after the other, each seeded with the hash before."""
    for v, size in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def terms_of(text):
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {x - (1 << 64) if x >= 1 << 63 else x for x in h}


def signs(terms, lexicon):
    inside = sorted(terms & lexicon)
    out = []
    for i, d in enumerate(imatch.SUBSETS):
        part = [x for x in inside if xx([(x, 8), (i, 4)]) % d == 0]
        out.append(xx([(x, 8) for x in part]) if part else None)
    return [*out, xx([(x, 8) for x in inside or sorted(terms)])]


def shown(s):
    return "".join("........" if x is None else f"{x & 0xFFFFFFFF:08x}" for x in s)


def likeness(a, b):
    if a[-1] == b[-1]:
        return 1.0
    pairs = [(x, y) for x, y in zip(a[:-1], b[:-1], strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def expected(rows, band):
    texts = [(k, t or "") for k, t in rows]
    df = Counter(w for _, t in texts for w in terms_of(t))
    n = len(texts)
    least, most = max(2.0, n / math.e ** band[1]), max(n / math.e ** band[0], 2.0)
    lexicon = {w for w, c in df.items() if least <= c <= most}
    assert lexicon
    down = sorted(texts, key=lambda r: -r[0])
    out = {}
    for i, (k, t) in enumerate(down):
        after = down[(i + 1) % n][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = (signs(terms_of(x), lexicon) for x in (t, edited, after))
        out[k] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), likeness(a, b), likeness(a, c))
    return out


@pytest.mark.parametrize("largest", [1_000_000, 0])
def test_fingerprints_equal_a_plain_loop(spark, largest):
    rng = random.Random(11)
    words = [f"Wort{i}" for i in range(150)] + ["é", "日本", "𝒳y"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice((0, 1, 5, 40, 90))))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[5][1]), (63, " \t" + "wort3 " * 4000), (64, "wort1\nWORT1\x0bwort2")]
    band = (0.5, 3.5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = imatch.fingerprints(df, band=band, largest=largest).collect()
    assert {
        r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"])
        for r in got
    } == expected(rows, band)


def test_slot_table_is_no_column_of_the_rows(spark):
    """The optimizer must put the table of slots into the projection that looks terms up."""
    sides = spark.createDataFrame(
        [(1, 1, 5, 1, 2, 2, "x", "a b", "b c")], "k long, h long, n long, times long, nk long, nh long, sha string, t string, u string"
    )
    sides = sides.withColumns({"own": imatch.terms(sides["t"]), "other": imatch.terms(sides["u"])}).drop("t", "u")
    kept = sides.selectExpr("explode(own) as term", "1L as bits")
    found = imatch.looked_up(sides, kept)
    plan = found._jdf.queryExecution().optimizedPlan()
    outputs = [plan.output().mkString(",")]
    while plan.children().size() == 1:
        plan = plan.children().head()
        outputs.append(plan.output().mkString(","))
    assert not any("slots#" in names for names in outputs)
    row = found.first()
    assert len(row["in_own"]) == 2 and len(row["in_other"]) == 1
