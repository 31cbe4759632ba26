"""Batch request and response files of a hosted sampling service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ranking import keep_latest

# FIXED VALUES: the wording and parameters of a request.
SYSTEM_TEXT = (
    "You are a helpful assistant. Solve the problem and provide the final answer in the format of "
    '"The answer is $\\boxed{...}$".'
)
MODEL = "gpt-4o-mini-2024-07-18"
ENDPOINT = "/v1/chat/completions"
TASK_PATTERN = r"^(?:req|resp)_(.*)\.jsonl?$"


def trimmed(c: Column) -> Column:
    """Text without the whitespace at its ends; the form all query keys compare in."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def build_requests(
    queries: DataFrame,
    dataset: Column,
    index: Column,
    n: int = 2,
    temperature: float = 0.6,
    max_tokens: int = 2048,
    system: str = SYSTEM_TEXT,
    model: str = MODEL,
    seed: int = 42,
) -> DataFrame:
    """One nested request row per query; its id is ``<dataset>:<index>``."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"),
        F.array(message("system", F.lit(system)), message("user", F.col("query"))).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(n).alias("n"),
        F.lit(float(temperature)).alias("temperature"),
        F.lit(1.0).alias("top_p"),
        F.lit(seed).alias("seed"),
        F.lit(True).alias("logprobs"),
        F.lit(20).alias("top_logprobs"),
    )
    return queries.select(
        F.concat(dataset, F.lit(":"), index.cast("string")).alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(ENDPOINT).alias("url"),
        body.alias("body"),
    )


def read_tasks(spark: SparkSession, path: str, schema) -> DataFrame:
    """Request or response files with the ``task`` their name carries."""
    name = F.regexp_extract(F.col("_metadata.file_name"), TASK_PATTERN, 1)
    return spark.read.schema(schema).json(path).withColumn("task", name)


def flatten_responses(responses: DataFrame, requests: DataFrame, on: list[str]) -> DataFrame:
    """One row per choice, with query and system text of its request.

    Responses without a request drop out here; ``unmatched_responses`` shows them.
    """
    asked = requests.select(
        *on,
        F.element_at("body.messages", -1)["content"].alias("query"),
        F.col("body.messages")[0]["content"].alias("prompt_template"),
    )
    return responses.join(asked, on).select(
        *on,
        F.split_part("custom_id", F.lit(":"), F.lit(1)).alias("dataset"),
        "query",
        F.col("response.body.model").alias("agent"),
        "prompt_template",
        F.posexplode("response.body.choices").alias("choice_no", "_choice"),
    ).withColumn("resp", F.col("_choice.message.content")).drop("_choice")


def unmatched_responses(responses: DataFrame, requests: DataFrame, on: list[str]) -> DataFrame:
    return responses.join(requests.select(*on), on, "left_anti")


def with_reference(outputs: DataFrame, answers: DataFrame, order: list[str]) -> DataFrame:
    """Join the reference answer by trimmed query; of several the last one counts."""
    key = trimmed(F.col("query"))
    last = keep_latest(answers.select(key.alias("_key"), F.col("ref_ans"), *order), ["_key"], order)
    last = last.select("_key", "ref_ans")
    return outputs.join(last, key == F.col("_key")).drop("_key")


def mapped_fields(df: DataFrame, fields: dict[str, str], extract: Column | None = None) -> DataFrame:
    """Rename source fields; without a reference field the answer comes from ``extract``."""
    columns = [F.col(source).alias(target) for target, source in fields.items()]
    if "ref_ans" not in fields:
        columns.append(extract.alias("ref_ans"))
    elif extract is not None:
        columns = [c for c, t in zip(columns, fields) if t != "ref_ans"]
        columns.append(F.coalesce(F.col(fields["ref_ans"]), extract).alias("ref_ans"))
    return df.select(*columns)


REQUEST, BATCH_RESPONSE = schemas.REQUEST, schemas.BATCH_RESPONSE
