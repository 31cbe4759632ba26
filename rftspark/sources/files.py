"""Files in and out: JSON lines, whole JSON arrays, Parquet, run directories and splits."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import dense_index

#: Each split is a directory and a file of its own; this many of them are one task's work.
SPLITS_PER_TASK = 256


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, **options: object) -> DataFrame:
    """JSON lines with a given schema; a map column ``extras`` collects all other fields."""
    known = [f for f in schema.fields if f.name != "extras"]
    reader = spark.read.options(**options)
    if len(known) == len(schema.fields):
        return reader.schema(schema).json(paths)
    return with_extras(reader.text(paths).withColumnRenamed("value", "_line"), "_line", schema)


def with_extras(lines: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Parse JSON text of an open schema: known fields typed, the rest as text in ``extras``."""
    known = T.StructType([f for f in schema.fields if f.name != "extras"])
    fields = F.from_json(column, known)
    everything = F.from_json(column, T.MapType(T.StringType(), T.StringType()))
    names = F.array(*[F.lit(f.name) for f in known.fields])
    others = [c for c in lines.columns if c != column]
    parsed = lines.select(*others, fields.alias("_f"), everything.alias("_all"))
    return parsed.select(
        *others, "_f.*", F.map_filter("_all", lambda k, _: ~F.array_contains(names, k)).alias("extras")
    )


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON array per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False, compression: str | None = None, max_rows: int = 500_000) -> None:
    """JSON lines. A compressed file is read by one task, so it holds ``max_rows`` lines at most."""
    writer = df.write.mode("append" if append else "overwrite")
    if compression:
        writer = writer.option("compression", compression).option("maxRecordsPerFile", max_rows)
    writer.json(path)


def write_parquet(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def scan_runs(
    spark: SparkSession, dirs: list[str], schema: T.StructType, name_pattern: str = ".*", recursive: bool = False
) -> DataFrame:
    """All files of some directories whose name matches from its start; adds ``file_path``, ``file_name``, ``file_block``.

    The name test is on file metadata, which Spark uses to skip files before reading them.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", recursive)
    name = F.col("_metadata.file_name")
    scan = reader.json(dirs).filter(name.rlike(f"^(?:{name_pattern})"))
    return scan.withColumns(
        {"file_path": F.col("_metadata.file_path"), "file_name": name, "file_block": F.col("_metadata.file_block_start")}
    )


def rows_per_file(scan: DataFrame) -> DataFrame:
    """Rows of each file; files of one name in two folders are two files."""
    return scan.groupBy("file_path", "file_name").agg(F.count(F.lit(1)).alias("n"))


def split_ranges(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Number the rows and cut them into splits: ``split_start``, ``split_end`` (exclusive)."""
    numbered = dense_index(df, order, "row_no")
    return _cut(numbered, rows, numbered.count())


def _cut(numbered: DataFrame, rows: int, total: int) -> DataFrame:
    start = F.floor(F.col("row_no") / rows) * rows
    return numbered.withColumns({"split_start": start, "split_end": F.least(start + rows, F.lit(total).cast("long"))})


def write_splits(df: DataFrame, path: str, order: list[str], rows: int) -> None:
    """One directory with one file per split, named by its range.

    The rows are counted where they are numbered, not by working ``df`` out once more. A task's time goes with the
    files it makes, not with its bytes, so the number of tasks follows the number of splits.
    """
    numbered = dense_index(df, order, "row_no")
    total = numbered.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // (rows * SPLITS_PER_TASK)))
    cut = _cut(numbered, rows, total).drop("row_no").repartition(tasks, "split_start")
    cut.write.partitionBy("split_start", "split_end").mode("overwrite").json(path)


def path_slug(c: Column) -> Column:
    """A model, template or dataset id as part of a file name."""
    return F.replace(c, F.lit("/"), F.lit("--"))


def _plain(c: Column) -> Column:
    return c.cast("string")


def run_name(df: DataFrame, target: str = "run_name") -> DataFrame:
    """Result file name from the run parameters.

    Needs ``model, max_new_toks, temperature, top_p, prompt_template, dataset, n_shots, tag,
    seed``. Without temperature sampling is greedy, so top-p has no effect either.
    """
    greedy = F.col("temperature") <= 0
    name = F.concat_ws(
        "-",
        path_slug(F.col("model")),
        F.concat(F.lit("outlen"), _plain(F.col("max_new_toks"))),
        F.concat(F.lit("t"), F.when(greedy, "0").otherwise(_plain(F.col("temperature")))),
        F.concat(F.lit("p"), F.when(greedy, "1").otherwise(_plain(F.col("top_p")))),
        F.concat(F.lit("prompt-"), path_slug(F.col("prompt_template"))),
        path_slug(F.col("dataset")),
        F.concat(_plain(F.col("n_shots")), F.lit("shot")),
        F.concat(F.lit("tag-"), F.col("tag")),
        F.concat(F.lit("seed"), _plain(F.col("seed"))),
    )
    return df.withColumn(target, F.concat(name, F.lit(".jsonl")))


def write_runs(df: DataFrame, path: str) -> None:
    """Hive-style run directories, so that later scans prune by run parameters."""
    df.withColumns(
        {f"run_{c}": path_slug(F.col(c).cast("string")) for c in ("model", "dataset", "temperature", "seed")}
    ).write.partitionBy("run_model", "run_dataset", "run_temperature", "run_seed").mode("append").parquet(path)


def piece_digests(rows: DataFrame, by: str, pieces: int) -> DataFrame:
    """(piece, digest): rows fall into pieces by a hash of ``by``; the digest follows the multiset of a piece's rows.

    Two sums of row hashes and a count do not depend on the order, and copies count.
    """
    plain = [F.col(c) for c in rows.columns]
    sums = [F.sum(F.xxhash64(F.lit(i), *plain, *[c.isNull() for c in plain]).cast("decimal(38,0)")) for i in (0, 1)]
    held = rows.groupBy(_piece(by, pieces).alias("piece")).agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    return held.select("piece", F.md5(F.concat_ws("|", "n", "s0", "s1")).alias("digest"))


def _piece(by: str, pieces: int) -> Column:
    return F.pmod(F.xxhash64(F.col(by)), F.lit(pieces)).cast("int")


def kept_pieces(
    rows: DataFrame, build: Callable[[DataFrame], DataFrame], home: str, by: str, *key: object, pieces: int = 64
) -> DataFrame:
    """``build(rows)`` kept under ``home``; only pieces whose rows have changed are built again.

    ``key`` names everything else the result depends on; ``build`` must treat every row on its
    own and keep ``by``. A batch of built pieces counts once it stands in the table of contents, so one that
    was cut short is built again. The driver sees one line per piece, at most ``pieces``.
    """
    spark = rows.sparkSession
    name = hashlib.sha256(repr((*key, by, pieces)).encode()).hexdigest()[:16]
    path = f"{home.rstrip('/')}/{str(key[0]).replace('/', '--')}-{name}-tokenized"
    wanted = piece_digests(rows, by, pieces)
    contents = T.StructType.fromDDL("piece int, digest string, batch string")
    try:
        known = spark.read.schema(contents).parquet(f"{path}/contents")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], contents)
    newest = known.groupBy("piece", "digest").agg(F.max("batch").alias("batch"))
    found = {r["piece"]: (r["digest"], r["batch"]) for r in wanted.join(newest, ["piece", "digest"], "left").collect()}
    stale = sorted(p for p, (_, batch) in found.items() if batch is None)
    if stale:
        batch = uuid.uuid4().hex
        piece = _piece(by, pieces)
        built = build(rows.filter(piece.isin(stale)) if len(stale) < len(found) else rows)
        built.withColumn("piece", piece).write.partitionBy("piece").parquet(f"{path}/{batch}")
        lines = [(p, found[p][0], batch) for p in stale]
        spark.createDataFrame(lines, contents).coalesce(1).write.mode("append").parquet(f"{path}/contents")
        found |= {p: (found[p][0], batch) for p in stale}
        schema = built.schema
    else:
        schema = build(rows).schema
    of: dict[str, list[int]] = {}
    for p, (_, batch) in found.items():
        of.setdefault(batch, []).append(p)
    if not of:
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("piece", T.IntegerType())])
    parts = [spark.read.schema(full).parquet(f"{path}/{b}").filter(F.col("piece").isin(ps)) for b, ps in sorted(of.items())]
    return functools.reduce(DataFrame.unionByName, parts).drop("piece")


_LEDGER = T.StructType([T.StructField("batch", T.StringType())])


def _ledger(spark: SparkSession, path: str) -> set[str]:
    """Names of the batches that count: one short line each, the only thing the driver reads."""
    try:
        return {r["batch"] for r in spark.read.schema(_LEDGER).json(f"{path}/ledger").collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def _batch_home(path: str, batch: str) -> str:
    return f"{path}/data/{hashlib.sha256(batch.encode()).hexdigest()[:32]}"


def append_once(df: DataFrame, path: str, batch: str) -> bool:
    """Append ``df`` as the batch of that name; False if it stands there already.

    A batch has a folder of its own and counts once its name is in the ledger. What a killed attempt left behind
    is not read, and the next attempt replaces it, so repeating an append leaves every row once. Different batches
    may be written at the same time; one batch has one writer at a time. An empty table is a batch too.
    """
    path = path.rstrip("/")
    if batch in _ledger(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(_batch_home(path, batch))
    df.sparkSession.createDataFrame([(batch,)], _LEDGER).coalesce(1).write.mode("append").json(f"{path}/ledger")
    return True


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches in the ledger; none if nothing was appended yet."""
    path = path.rstrip("/")
    homes = [_batch_home(path, b) for b in sorted(_ledger(spark, path))]
    return spark.read.schema(schema).parquet(*homes) if homes else spark.createDataFrame([], schema)
