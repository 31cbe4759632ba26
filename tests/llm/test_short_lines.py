"""Lines of few words against a plain loop."""

from __future__ import annotations

import random

import pytest

from rftspark.llm import lines


def short_texts():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7)))
    base = [" ".join(word() for _ in range(rnd.randint(2, 7))) for _ in range(40)]
    base += ["".join(rnd.choice("日本語東京大学生漢字") for _ in range(rnd.randint(4, 40))) for _ in range(20)]
    rows = [(i, "\n".join(rnd.sample(base, 6) + ["Ietzte.", " Ietzte. ", ""])) for i in range(10)]
    for i in range(10, 40):
        edited = []
        for line in rnd.sample(base, 6):
            p = rnd.randrange(len(line))
            edited.append(line[:p] + rnd.choice(["", "q", "q" + line[p : p + 1]]) + line[p + 1 :])
        rows.append((i, "\n".join(edited)))
    return rows


def near(a: str, b: str) -> bool:
    """Within one character changed, added or missing."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


@pytest.mark.parametrize("together", [None, 3])
def test_short_lines(spark, together):
    seen, want = [], []
    for i, t in short_texts():
        kept = []
        for line in t.split("\n"):
            own = " ".join(line.split())
            gone = own != "" and any(own == x or min(len(own), len(x)) >= 16 and near(own, x) for x in seen)
            seen.append(own)
            kept += [] if gone else [line]
        want.append((i, "\n".join(kept)))
    docs = spark.createDataFrame(short_texts(), "doc_id long, text string").repartition(3)
    done = lines.dedup_lines(docs, total_bytes=30 << 20 if together else None, together=together)
    assert sorted((r["doc_id"], r["text"]) for r in done.collect()) == want
