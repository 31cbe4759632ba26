"""Question sets as query tables: one projection per source, then specs and limits."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import sqltext
from ..functions.extract import boxed_strict
from ..operators.prompts import olympiad_query
from ..operators.ranking import sample_rows


def math_level(level: Column, problem: Column) -> Column:
    """Number of ``Level n``; the two problems without one are told apart by their first word."""
    word = F.element_at(F.split(level, " ", -1), -1)
    return F.when(word == "?", F.when(problem.startswith("We"), 2).otherwise(1)).otherwise(
        word.try_cast("int")
    )


def _last_part(c: str) -> Column:
    return F.element_at(F.split(F.col(c), r"\.", -1), -1)


def competition_math(raw: DataFrame, dataset: str) -> DataFrame:
    return raw.select(
        F.col("problem").alias("query"),
        boxed_strict(sqltext.col("solution")).column().alias("ref_ans"),
        math_level(F.col("level"), F.col("problem")).alias("level"),
        F.replace("type", F.lit(" "), F.lit("")).alias("domain"),
    )


def grade_school(raw: DataFrame, dataset: str) -> DataFrame:
    return raw.select(
        F.col("question").alias("query"),
        F.element_at(F.split("answer", "\n#### ", -1), -1).alias("ref_ans"),
    )


def grade_school_fixed(raw: DataFrame, dataset: str) -> DataFrame:
    return raw.select(
        "query", F.col("gt_ans").alias("ref_ans"), F.col("query_metadata.n_step").alias("n_step")
    )


def word_problems(raw: DataFrame, dataset: str) -> DataFrame:
    return raw.select(
        F.col("question").alias("query"),
        F.col("answer").alias("ref_ans"),
        _last_part("data_source").alias("source"),
        _last_part("data_topic").alias("domain"),
    )


def question_answer(raw: DataFrame, dataset: str) -> DataFrame:
    return raw.select(F.col("question").alias("query"), F.col("answer").alias("ref_ans"))


def olympiad(raw: DataFrame, dataset: str) -> DataFrame:
    return olympiad_query(raw, dataset.rsplit("/", 1)[-1]).select(
        "query",
        F.try_element_at("final_answer", F.lit(1)).alias("ref_ans"),
        F.col("error").try_cast("double").alias("abs_tol"),
        F.col("subfield").alias("domain"),
    )


def theorem_answers(raw: DataFrame, dataset: str) -> DataFrame:
    """``Answer`` is read as JSON text: numbers also fill ``ref_num``, truth words and lists do not."""
    answer = F.col("Answer")
    number = F.when(answer.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), answer.try_cast("double"))
    text = F.when(answer.isin("true", "false"), F.initcap(answer)).otherwise(answer)
    return raw.select(F.col("Question").alias("query"), text.alias("ref_ans"), number.alias("ref_num"))


def one_entry_maps(raw: DataFrame, dataset: str) -> DataFrame:
    """Every row is a map with one entry, whose value is the question."""
    entry = raw.select(F.map_values(F.col(raw.columns[0]))[0].alias("e"))
    return entry.select(
        F.col("e.question").alias("query"), F.col("e.answer").alias("ref_ans"),
        F.col("e.label").alias("domain"), F.col("e.level").alias("level"),
    )


def forum(raw: DataFrame, dataset: str) -> DataFrame:
    return raw.select(
        F.col("problem").alias("query"), F.col("answer").alias("ref_ans"), F.col("link").alias("id")
    )


def query_file(raw: DataFrame, dataset: str) -> DataFrame:
    return raw


ADAPTERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "math/": competition_math,
    "gsm8k/": grade_school,
    "gsm8k-fix/": grade_school_fixed,
    "mwpbench/": word_problems,
    "deepmind-mathematics": question_answer,
    "olympiadbench": olympiad,
    "theoremqa": theorem_answers,
    "odyssey-math": one_entry_maps,
    "aops": forum,
}


def raw_schema(dataset: str):
    """Schema of the raw file of a dataset."""
    for prefix in sorted(ADAPTERS, key=len, reverse=True):
        if dataset.startswith(prefix):
            return schemas.RAW[prefix.rstrip("/")]
    return schemas.RAW["file"]


def adapt(raw: DataFrame, dataset: str) -> DataFrame:
    """Query table of a raw table; unknown names are files of (query, ref_ans)."""
    for prefix in sorted(ADAPTERS, key=len, reverse=True):
        if dataset.startswith(prefix):
            found = ADAPTERS[prefix](raw, dataset)
            break
    else:
        found = query_file(raw, dataset)
    return found.withColumn("dataset", F.lit(dataset))


def parse_spec(spec: str) -> tuple[str, dict[str, list], float | None]:
    """``id;field=value;…`` → dataset, filters and sample size. Values are Python literals."""
    dataset, *fields = spec.split(";")
    filters: dict[str, list] = {}
    sample = None
    for field in fields:
        name, value = field.split("=", 1)
        if name == "sample":
            sample = ast.literal_eval(value)
        elif name == "ref_ans":
            if value != "int":
                raise NotImplementedError(f"ref_ans={value}")
            filters[name] = ["int"]
        elif name in ("level", "domain"):
            literal = ast.literal_eval(value)
            filters[name] = literal if isinstance(literal, list) else [literal]
        else:
            raise NotImplementedError(field)
    return dataset, filters, sample


def integer_answer(ref_ans: Column) -> Column:
    """The reference answer is an integer value."""
    value = F.when(
        ref_ans.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), ref_ans.try_cast("double")
    )
    return F.coalesce(value == F.floor(value), F.lit(False))


def select_rows(queries: DataFrame, filters: dict[str, list], sample: float | None, seed: int = 42) -> DataFrame:
    """Apply the filters of a spec, then its sample."""
    for name, allowed in filters.items():
        chosen = integer_answer(F.col("ref_ans")) if name == "ref_ans" else F.col(name).isin(*allowed)
        queries = queries.filter(chosen)
    return queries if sample is None else sample_rows(queries, "query", sample, seed)


def _per_dataset(values: int | list[int], n: int, name: str) -> list[int]:
    listed = [values] if isinstance(values, int) else list(values)
    if len(listed) == 1:
        listed = listed * n
    if len(listed) != n:
        raise ValueError(f"{name} has {len(listed)} values for {n} datasets")
    return listed


def load_queries(
    raws: dict[str, DataFrame],
    max_n_trials: int | list[int] = 1,
    min_n_corrects: int | list[int] = 0,
    prompt_template: str = "alpaca",
    n_shots: int = -1,
) -> DataFrame:
    """Union of the query tables of several specs (spec → raw table), each with its limits."""
    most = _per_dataset(max_n_trials, len(raws), "max_n_trials")
    enough = _per_dataset(min_n_corrects, len(raws), "min_n_corrects")
    union = None
    for (spec, raw), m, e in zip(raws.items(), most, enough):
        dataset, filters, sample = parse_spec(spec)
        part = select_rows(adapt(raw, dataset), filters, sample).withColumns(
            {
                "max_n_trials": F.lit(m),
                "min_n_corrects": F.lit(e),
                "prompt_template": F.lit(prompt_template),
                "n_shots": F.lit(n_shots),
                "n_trials": F.lit(0).cast("long"),
                "n_corrects": F.lit(0).cast("long"),
            }
        )
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return union


def read_queries(spark: SparkSession, paths: dict[str, str], **limits: object) -> DataFrame:
    """``load_queries`` from JSON-lines, JSON-array (``.json``) or Parquet files (spec → path)."""
    raws = {}
    for spec, path in paths.items():
        schema = raw_schema(spec.split(";")[0])
        if path.endswith(".parquet"):
            raws[spec] = spark.read.parquet(path)
        elif isinstance(schema, schemas.T.MapType):
            raws[spec] = spark.read.text(path).select(F.from_json("value", schema).alias("entry"))
        else:
            raws[spec] = spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)
    return load_queries(raws, **limits)


def collect_responses(queries: DataFrame, responses: DataFrame, on: list[str]) -> DataFrame:
    """Response rows with all columns of their query."""
    extra = [c for c in responses.columns if c not in queries.columns]
    return queries.join(responses.select(*on, *extra), on)


def output_order(df: DataFrame) -> DataFrame:
    """Short fields first; agent, template, query and response last."""
    tail = [c for c in ("agent", "prompt_template", "query", "resp") if c in df.columns]
    return df.select(*[c for c in df.columns if c not in tail], *tail)
