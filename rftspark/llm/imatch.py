"""I-Match fingerprints: hashes of the mid-frequency terms of a text, over several lexicons.

Only DataFrame functions. The lexicon holds the terms whose inverse document frequency
lies in a band. Each of ``SUBSETS`` randomised lexicons keeps a share of it; a text's
fingerprint holds, for each of them, the hash of its sorted distinct terms there. Shares
differ, as a short text needs large lexicons to have terms in, and a long one small ones to
agree in after an edit.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One term in so many is in a lexicon, for each of the lexicons.
SUBSETS = (8,) * 4 + (32,) * 12 + (128,) * 16
#: Band of ln(documents / documents with the term). As document frequencies add up to the
#: mean number of distinct terms m times the documents, at most 1000 m terms are inside.
BAND = (2.3, 6.9)
#: Terms up to which a lexicon is sent to every task, about 32 bytes each; a larger one is joined by shuffle.
BROADCAST = 1_000_000
#: Slots of a lexicon that is sent to every task; four terms a slot at most, on average.
SLOTS = 1 << 18


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text in lower case."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(rows: DataFrame, text: str, band: tuple[float, float] = BAND) -> DataFrame:
    """(term): hashes of the terms in the band; one that a single document holds never counts."""
    held = rows.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = rows.count()
    least, most = max(2.0, n / 2.718281828459045 ** band[1]), n / 2.718281828459045 ** band[0]
    return held.filter((F.col("df") >= least) & (F.col("df") <= max(most, 2.0))).select("term")


def subsets(term: Column) -> Column:
    """Bit i is set if the term is in randomised lexicon i. A term is in one of them on average."""
    inside = [F.when(F.pmod(F.xxhash64(term, F.lit(i)), F.lit(d)) == 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, d in enumerate(SUBSETS)]
    return functools.reduce(Column.bitwiseOR, inside)


def slots(kept: DataFrame) -> DataFrame:
    """One row with one array: the terms of a lexicon and their bits, by slot, so that a term is found at once."""
    spark = kept.sparkSession
    filled = kept.groupBy(F.pmod("term", F.lit(SLOTS)).alias("id")).agg(F.collect_list(F.struct("term", "bits")).alias("held"))
    every = spark.range(SLOTS).join(filled, "id", "left")
    none = F.array().cast("array<struct<term: bigint, bits: bigint>>")
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("held", none).alias("held"))))
    return every.agg(ordered["held"].alias("slots"))


def looked_up(sides: DataFrame, kept: DataFrame) -> DataFrame:
    """The terms of both texts that a lexicon of bounded size holds, without a row a term.

    The table of slots and either list are each named once, so that the optimizer puts them
    into one projection: the table is a constant of the task and no column of the rows.
    """
    def found(listed: Column) -> Column:
        slot = lambda x: F.get(F.col("slots"), F.pmod(x, F.lit(SLOTS)).cast("int"))
        inside = F.flatten(F.transform(listed, lambda x: F.filter(slot(x), lambda e: e["term"] == x)))
        return F.struct(F.sort_array(inside).alias("in"), F.xxhash64(F.sort_array(listed)).alias("all"))

    both = sides.withColumn("slots", slots(kept).scalar()).select(
        "k", "h", "n", "times", "nk", "nh", "sha", F.transform(F.array("own", "other"), found).alias("both")
    )
    own, other = F.col("both")[0], F.col("both")[1]
    return both.select(
        "k", "h", "n", "times", "nk", "nh", "sha", own["in"].alias("in_own"), other["in"].alias("in_other"),
        own["all"].alias("all_own"), other["all"].alias("all_other"),
    )


def signatures(rows: DataFrame, names: dict[str, str], inside: str, everything: str) -> DataFrame:
    """Hash per lexicon (null without a term there) and of the whole band, or of all terms if the band is empty.

    ``names`` maps the column with the sorted (term, bits) to the column of its hashes. Lexicons of one
    share are looked for among the terms that any of them holds.
    """
    shares = sorted(set(SUBSETS))
    held = {d: sum(1 << i for i, one in enumerate(SUBSETS) if one == d) for d in shares}

    def having(listed: str, mask: int) -> Column:
        return F.filter(F.col(listed), lambda e: e["bits"].bitwiseAND(F.lit(mask).cast("long")) != 0)

    parts = {f"_{source}{d}": having(inside.format(source), held[d]) for source in names for d in shares}
    rows = rows.select("*", *[c.alias(n) for n, c in parts.items()])

    def signs(source: str) -> Column:
        lists = [having(f"_{source}{d}", 1 << i) for i, d in enumerate(SUBSETS)]
        hashed = F.transform(F.array(*lists), lambda p: F.when(F.size(p) > 0, F.xxhash64(F.transform(p, lambda e: e["term"]))))
        band = F.col(inside.format(source))
        whole = F.when(F.size(band) > 0, F.xxhash64(F.transform(band, lambda e: e["term"])))
        return F.concat(hashed, F.array(whole.otherwise(F.col(everything.format(source)))))

    return rows.select("*", *[signs(s).alias(n) for s, n in names.items()])


def as_text(signs: Column) -> Column:
    """Eight hex digits per hash, dots without a term."""
    return F.concat_ws("", F.transform(
        signs, lambda x: F.when(x.isNull(), "........").otherwise(F.lower(F.substring(F.lpad(F.hex(x), 16, "0"), 9, 8)))
    ))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the lexicons where either text has terms; 1 for equal fingerprints."""
    both = F.zip_with(a, b, lambda x, y: F.struct((x == y).alias("same"), (x.isNotNull() | y.isNotNull()).alias("any")))
    first = F.slice(both, 1, len(SUBSETS))
    used = F.size(F.filter(first, lambda p: p["any"]))
    same = F.size(F.filter(first, lambda p: F.coalesce(p["same"], F.lit(False))))
    equal = F.element_at(a, -1) == F.element_at(b, -1)
    return F.when(equal, 1.0).when(used == 0, 0.0).otherwise(same / used).cast("double")


def neighbours(rows: DataFrame) -> DataFrame:
    """(k, h, n, times, nk, nh, pk, ph, pn): each distinct row with the one after it and before it,
    in descending order of (k, h), the first following the last.

    Ranges of the order are numbered by partition; only their first rows meet in one place.
    """
    from .simhash import use_checkpoints

    use_checkpoints(rows.sparkSession)
    down = [F.desc("k"), F.desc("h")]
    one = rows.groupBy("k", "h").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    placed = one.repartitionByRange(*down).withColumn("range", F.spark_partition_id()).checkpoint()
    here = Window.partitionBy("range").orderBy(*down)
    me = F.struct("k", "h", "n")
    ends = placed.groupBy("range").agg(F.max(me).alias("top"), F.min(me).alias("low"))
    order, whole = Window.orderBy("range"), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range", F.coalesce(F.lead("top").over(order), F.first("top").over(whole)).alias("next_top"),
        F.coalesce(F.lag("low").over(order), F.last("low").over(whole)).alias("prev_low"),
    )
    near = placed.withColumns({"after": F.lead(me).over(here), "before": F.lag(me).over(here)}).join(ends, "range")
    after, before = F.coalesce("after", "next_top"), F.coalesce("before", "prev_low")
    return near.select(
        "k", "h", "n", "times", after["k"].alias("nk"), after["h"].alias("nh"),
        before["k"].alias("pk"), before["h"].alias("ph"), before["n"].alias("pn"),
    )


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND, largest: int = BROADCAST,
) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text is the text whose last third of characters is replaced by the first as
    many (or all) of the next document's, by descending id; rows that share an id are
    ordered by a hash of the text, null ids come last, and rows equal in id and text are
    one document there and get equal results each. A null text counts as empty: an empty
    text has no terms, its fingerprint says so, and equals that of any other empty text.
    Other columns are left out. An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("k"), text.alias("t"))
    rows = rows.select("k", F.xxhash64("t").alias("h"), F.length("t").cast("long").alias("n"), "t")
    order = neighbours(rows.select("k", "h", "n"))
    # Copies meet where the join sends them; each distinct row is worked on once and counted by ``times``.
    full = rows.drop("n").join(order, ["k", "h"]).dropDuplicates(["k", "h"])
    heads = full.select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.expr("left(t, cast(pn div 3 as int))").alias("head"))
    edited = full.join(heads, ["k", "h"]).withColumn("edited", F.expr("concat(left(t, cast(n - n div 3 as int)), head)"))
    sides = edited.select(
        "k", "h", "n", "times", "nk", "nh", F.sha2("edited", 256).alias("sha"),
        terms(F.col("t")).alias("own"), terms(F.col("edited")).alias("other"),
    )
    kept = lexicon(rows, "t", band).withColumn("bits", subsets(F.col("term"))).checkpoint()
    grouped = (looked_up if kept.count() <= largest else _joined)(sides, kept)
    signed = signatures(grouped, {"own": "a", "other": "b"}, "in_{}", "all_{}")
    signed = signed.select("k", "h", "n", "times", "nk", "nh", "sha", "a", "b").checkpoint()
    following = signed.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("a").alias("c"))
    done = signed.join(following, ["nk", "nh"]).select(
        F.when(F.col("k") != lowest, F.col("k")).alias(id_col), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"),
        as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_copy"),
    )
    return done.drop("_copy")


def _joined(sides: DataFrame, kept: DataFrame) -> DataFrame:
    """The terms of both texts that a lexicon of any size holds, one narrow row a term on the way."""
    # Most terms are in both texts: one row each, told apart by their place in one list.
    sides = sides.withColumn("both", F.array_intersect("own", "other"))
    sides = sides.select(
        "k", "h", "both", F.array_except("own", "both").alias("gone"), F.array_except("other", "both").alias("come"),
        F.struct(
            "n", "times", "nk", "nh", "sha", F.xxhash64(F.sort_array("own")).alias("all_own"),
            F.xxhash64(F.sort_array("other")).alias("all_other"),
        ).alias("meta"),
    )
    ends = [F.size("both"), F.size("both") + F.size("gone"), F.size("both") + F.size("gone") + F.size("come")]
    # The last entry stands for the document, whatever its terms; as a term it is a hash, which spreads a join by term.
    listed = F.concat("both", "gone", "come", F.array("h"))
    placed = sides.select("k", "h", "meta", *[e.alias(f"e{i}") for i, e in enumerate(ends)], F.posexplode(listed).alias("at", "term"))
    at, (e0, e1, e2) = F.col("at"), map(F.col, ("e0", "e1", "e2"))
    spread = placed.select(
        "k", "h", "term", (at == e2).alias("last"), (at < e1).alias("in_own"),
        ((at < e0) | (at >= e1) & (at < e2)).alias("in_other"), F.when(at == e2, F.col("meta")).alias("meta"),
    )
    spread = spread.join(kept, "term", "left").filter("bits is not null or last")
    entry = F.when(F.col("bits").isNotNull(), F.struct("term", "bits"))
    return spread.groupBy("k", "h").agg(
        F.first("meta", ignorenulls=True).alias("meta"),
        F.sort_array(F.collect_set(F.when(F.col("in_own"), entry))).alias("in_own"),
        F.sort_array(F.collect_set(F.when(F.col("in_other"), entry))).alias("in_other"),
    ).select("k", "h", "meta.*", "in_own", "in_other")
