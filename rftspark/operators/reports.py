"""Reports over response pools, sample tables and packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PERCENTILES = (0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def corrects_per_query(pool: DataFrame, by: list[str]) -> DataFrame:
    return count_by(pool.filter("correct"), *by)


def describe_counts(counts: DataFrame, column: str = "n", exact: bool = True) -> DataFrame:
    """Count, mean, deviation, extremes and low percentiles of a count column.

    The exact percentiles keep one counter per distinct value, so they stay small for
    counts; ``exact=False`` bounds the memory for any other column.
    """
    points = F.array(*[F.lit(p) for p in PERCENTILES])
    marks = F.percentile(column, points) if exact else F.percentile_approx(column, list(PERCENTILES), 10_000)
    summary = counts.agg(
        F.count(column).alias("n_queries"),
        F.avg(column).alias("mean"),
        F.stddev(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        marks.alias("_p"),
    )
    found = {f"p{int(p * 100)}": F.col("_p")[i].cast("double") for i, p in enumerate(PERCENTILES)}
    return summary.withColumns(found).drop("_p")


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width bins between the extremes; the last one includes the maximum."""
    edges = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    marked = df.select(column).withColumn("_edges", edges)
    low, high = F.col("_edges.lo"), F.col("_edges.hi")
    width = F.nullif((high - low) / bins, F.lit(0.0))
    position = F.coalesce(F.floor((F.col(column) - low) / width), F.lit(0))
    return (
        marked.withColumn("bin", F.least(position, F.lit(bins - 1)).cast("int"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def with_level(df: DataFrame, levels: DataFrame, key: str = "query", order: str | None = None) -> DataFrame:
    """Left lookup of ``level`` by trimmed text, 0 where there is none.

    Of several levels for one trimmed text the last by the column ``order`` counts, without
    one the largest; a response is never repeated.
    """
    text = F.regexp_replace(F.col(key), r"^\s+|\s+$", "")
    level = F.max_by("level", order) if order else F.max("level")
    levels = levels.groupBy(text.alias("_key")).agg(level.alias("_level"))
    joined = df.drop("level").withColumn(key, text).join(levels, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("level", F.coalesce(F.col("_level"), F.lit(0))).drop("_key", "_level")


def level_average(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Responses per query by level; the denominators come from the query table."""
    return (
        count_by(df, "level")
        .join(count_by(queries, "level").withColumnRenamed("n", "n_queries"), "level")
        .select("level", (F.col("n") / F.col("n_queries")).alias("avg_responses"))
    )


def coverage(df: DataFrame, queries: DataFrame, key: str = "query") -> DataFrame:
    """Share of the reference queries that a sample table holds."""
    wanted = queries.select(key).distinct()
    seen = df.select(F.col(key).alias("_seen")).distinct()
    return (
        wanted.join(seen, F.col(key) == F.col("_seen"), "left")
        .agg(F.count(F.lit(1)).alias("n_queries"), F.count("_seen").alias("n_covered"))
        .withColumn("coverage", F.col("n_covered") / F.col("n_queries"))
    )


def strategy_matrix(tables: dict[str, DataFrame], queries: DataFrame, levels: list[int]) -> DataFrame:
    """One row per strategy, one column of average responses per level."""
    union = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("strategy"), "level")
        union = part if union is None else union.unionByName(part)
    counts = count_by(union, "strategy", "level")
    sizes = count_by(queries, "level").withColumnRenamed("n", "n_queries")
    rates = counts.join(sizes, "level").withColumn(
        "rate", F.round(F.col("n") / F.col("n_queries"), 2)
    )
    return rates.groupBy("strategy").pivot("level", levels).agg(F.first("rate")).withColumnsRenamed(
        {str(level): f"level_{level}" for level in levels}
    )


def accuracy(graded: DataFrame, *keys: str) -> DataFrame:
    return graded.groupBy(*keys).agg(
        F.count("correct").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    )


def macro_average(graded: DataFrame) -> DataFrame:
    """Mean over datasets of each agent's accuracy."""
    return (
        accuracy(graded, "agent", "dataset")
        .groupBy("agent")
        .agg(F.count(F.lit(1)).alias("n_datasets"), F.avg("accuracy").alias("macro_accuracy"))
    )


def accuracy_matrix(graded: DataFrame, datasets: list[str]) -> DataFrame:
    """One row per agent, one accuracy column per dataset."""
    return (
        accuracy(graded, "agent", "dataset").groupBy("agent").pivot("dataset", datasets).agg(F.first("accuracy"))
    )


def best_temperature(graded: DataFrame) -> DataFrame:
    """Most accurate temperature per agent and dataset; the lower one on a tie."""
    rank = F.struct("accuracy", -F.col("temperature"))
    return (
        accuracy(graded, "agent", "dataset", "temperature")
        .groupBy("agent", "dataset")
        .agg(F.max_by("temperature", rank).alias("best_temperature"), F.max("accuracy").alias("accuracy"))
    )


def token_stats(df: DataFrame, query_tokens: str = "query_tokens", response_tokens: str = "response_tokens") -> DataFrame:
    q, r = F.size(query_tokens).cast("long"), F.size(response_tokens).cast("long")
    return df.agg(
        F.avg(q).alias("average_query_token_size"),
        F.avg(r).alias("average_response_token_size"),
        F.sum(q).alias("total_query_tokens"),
        F.sum(r).alias("total_response_tokens"),
    )


def longest(df: DataFrame, column: str = "input_ids") -> DataFrame:
    return df.agg(F.max(F.size(column)).alias("max_len"))


def covered_queries(graded: DataFrame, key: str = "query") -> DataFrame:
    """Distinct trimmed queries with a correct response."""
    text = F.regexp_replace(F.col(key), r"^\s+|\s+$", "")
    return graded.filter("correct").select(text.alias(key)).distinct()


def uncovered_queries(graded: DataFrame, covered: DataFrame, key: str = "query") -> DataFrame:
    """Distinct trimmed queries with a wrong response that ``covered`` does not hold."""
    text = F.regexp_replace(F.col(key), r"^\s+|\s+$", "")
    return (
        graded.filter(~F.col("correct")).select(text.alias(key)).distinct().join(covered, key, "left_anti")
    )
