"""The near-duplicate stage of the pipeline against a plain loop over all pairs."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as C  # noqa: E402
from tests.llm.test_operators import plain_fingerprint  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows):
    """The first row of each component."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps, group = [plain_fingerprint(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for r, g in zip(rows, group, strict=True):
        first.setdefault(g, r)
    return sorted(first.values(), key=repr)


def test_stage(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 400)))
        rows.append((i, text))
        rows += [(100 + 10 * i + k, text + " " + rnd.choice(words) * (k % 2)) for k in range(rnd.randint(0, 6))]
    rows += [(900, None), (901, ""), (902, "  "), (903, "one"), (903, "two"), (903, "two"), (None, "one"), (None, "null id")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(6)
    done = C.near_dedup(spark, df, "")
    assert done.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in done.collect()), key=repr) == plain(rows)
    assert C.near_dedup(spark, df.limit(0), "").count() == 0


def test_pieces_of_letters_that_grow():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from rftspark.llm.packing import WordTokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = WordTokenizer(path), Tokenizer.from_file(path)
    longer = [chr(c) for c in range(0x80, 0x1F000) if len(chr(c).lower()) > 1]
    texts = [f"TAR{c}H{c}. a{c}, {c}! {c}́" for c in [*longer, "É", "ß", "ﬁ", "ǅ"]]
    for text, ids in zip(texts, own.ids(texts), strict=True):
        assert np.array(ids).tolist() == library.encode(text, add_special_tokens=False).ids, text
