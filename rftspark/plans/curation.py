"""Curation jobs: grade files, curate correct responses, sampling strategies."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.grading import grade
from ..operators.quotas import proportional_quota, retry_budget, uniform_quota
from ..operators.ranking import first_k
from ..operators.reports import corrects_per_query, count_by, describe_counts, histogram
from ..sources.files import read_jsonl, rows_per_file, scan_runs, write_jsonl


def grade_path(spark: SparkSession, source: str, target: str, compression: str | None = None, **options: object) -> None:
    """Grade a response file into a new path; the input is never overwritten. Compressed input is read by its suffix."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("target must differ from source")
    write_jsonl(grade(read_jsonl(spark, source, schemas.RESPONSE), **options), target, compression=compression)


@dataclass(frozen=True)
class Curated:
    """The chosen rows and the reports about where they come from."""

    chosen: DataFrame
    per_file: DataFrame
    per_dataset: DataFrame
    summary: DataFrame
    histogram: DataFrame


def curate(
    spark: SparkSession,
    dirs: list[str],
    name_pattern: str = ".*",
    k_u: int = 50,
    out: str | None = None,
    k_p: int | None = None,
    schema=schemas.RESPONSE,
) -> Curated:
    """Scan graded runs and keep ``k_u`` corrects per query (or, with ``k_p``, by difficulty).

    Arrival order is that of the folders as given, then path, then position in the file.
    """
    folders = [scan_runs(spark, [d], schema, name_pattern).withColumn("folder", F.lit(i)) for i, d in enumerate(dirs)]
    scan = functools.reduce(DataFrame.unionByName, folders).withColumn("row_no", F.monotonically_increasing_id())
    order = ["folder", "file_path", "file_block", "row_no"]
    if k_p is None:
        chosen = uniform_quota(scan, ["query"], order, k_u)
    else:
        chosen = proportional_quota(scan, ["query"], order, k_p)
    counts = corrects_per_query(scan, ["query"])
    if out:
        write_jsonl(chosen.drop(*order, "file_name"), out)
    return Curated(
        chosen=chosen,
        per_file=rows_per_file(scan),
        per_dataset=count_by(scan.filter("correct"), "dataset"),
        summary=describe_counts(counts),
        histogram=histogram(counts, "n"),
    )


def _stacked(*tables: DataFrame) -> DataFrame:
    """Union that keeps the table order in ``_src``."""
    union = None
    for i, table in enumerate(tables):
        part = table.withColumn("_src", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return union


def greedy_sample_retry(
    greedy: DataFrame, sampled: DataFrame, pool: DataFrame, by: list[str], order: list[str],
    keep: int = 4, first: int = 64,
) -> dict[str, DataFrame]:
    """Strategy 1: corrects of a greedy run, filled from a sampled run, then from first tries and retries."""
    step1 = greedy.filter("correct")
    both = _stacked(step1, sampled.filter("correct"))
    step2 = first_k(both, by, ["_src", *order], keep).drop("_src")
    tries = _stacked(first_k(pool, by, order, first), retry_budget(pool, by, order, first))
    chosen = first_k(tries.filter("correct"), by, ["_src", *order], keep).drop("_src")
    return {"greedy": step1, "sampled": step2, "final": step2.unionByName(chosen)}


def cover_then_fill(
    first_run: DataFrame, patches: list[DataFrame], pool: DataFrame, by: list[str], order: list[str],
    patch_keep: int = 2, raw: int = 100, keep: int = 4,
) -> dict[str, DataFrame]:
    """Strategy 2: corrects of a first run; only uncovered queries are filled from later runs."""
    step1 = first_run.filter("correct")
    patch = _stacked(*[p.filter("correct") for p in patches])
    uncovered = patch.join(step1.select(*by).distinct(), by, "left_anti")
    step2 = step1.unionByName(first_k(uncovered, by, ["_src", *order], patch_keep).drop("_src"))
    open_pool = pool.join(step2.select(*by).distinct(), by, "left_anti")
    tries = first_k(open_pool, by, order, raw).filter("correct")
    return {
        "first": step1,
        "patched": step2,
        "final": step2.unionByName(first_k(tries, by, order, keep)),
    }
