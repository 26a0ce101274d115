"""The query log: masked JSON lines out, tolerant read back in."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.redact import redact_columns
from ..session import exists, write_once

COST_FIELDS = "input_tokens bigint, output_tokens bigint, latency_s double, model string, cost_inr double"
RESULT_FIELDS = "answer string, citations array<string>, answered boolean, reason_if_unanswered string"
SCHEMA = f"seq bigint, question string, result struct<{RESULT_FIELDS}>, cost struct<{COST_FIELDS}>, _corrupt_record string"


def log_rows(entries: DataFrame) -> DataFrame:
    """Nested log rows from flat entries. Every text is masked, and only in the log: the
    entries keep theirs. ``cost`` is NULL where no model was called; ``seq`` tells the order of
    the calls, NULL if the entries have none."""
    if "seq" not in entries.columns:
        entries = entries.withColumn("seq", F.lit(None).cast("long"))
    masked = redact_columns(entries, ["question", "answer", "reason_if_unanswered"])
    cost = F.struct(
        "input_tokens", "output_tokens", "latency_s", "model", F.round("cost_inr", 4).alias("cost_inr")
    )
    return masked.select(
        "seq", "question",
        F.struct("answer", "citations", "answered", "reason_if_unanswered").alias("result"),
        F.when(F.col("model").isNotNull(), cost).alias("cost"),
    )


def append_log(entries: DataFrame, path: str) -> None:
    log_rows(entries).write.mode("append").json(path)


# ---- batches -----------------------------------------------------------------------------
#
# <log>/data/batch=<id>/try=<uuid>/ holds what one attempt wrote, <log>/commits/<id> names the attempt that counts.
# The manifest is created whole under a name of its own and then renamed, which only one attempt can do.


def append_batch(entries: DataFrame, path: str, batch: str) -> bool:
    """Appends the entries as batch ``batch``; False if that batch is in the log already, by an earlier run or by
    another attempt that was faster. What a lost attempt wrote is never read."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
        raise ValueError(f"not a name for a batch: {batch!r}")
    spark = entries.sparkSession
    if exists(spark, f"{path}/commits/{batch}"):
        return False
    attempt = f"batch={batch}/try={uuid.uuid4().hex}"
    log_rows(entries).write.json(f"{path}/data/{attempt}")
    return write_once(spark, f"{path}/commits/{batch}", attempt)


def committed(spark: SparkSession, path: str) -> list[str]:
    """Folders of the committed batches: one line of a manifest each."""
    if not exists(spark, f"{path}/commits"):
        return []
    return sorted(f"{path}/data/{r['value']}" for r in spark.read.text(f"{path}/commits").collect())


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All readable rows of committed batches, each with its ``batch``."""
    folders = committed(spark, path)
    if not folders:
        return readable(spark.createDataFrame([], SCHEMA)).withColumn("batch", F.lit(None).cast("string"))
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(folders)
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/data/batch=([^/]+)/try=", 1)
    return readable(rows.withColumn("batch", batch))


# ---- reading -----------------------------------------------------------------------------


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, reason): lines that give no measured call, and why: blank, malformed (not an object of JSON), without a
    cost entry, or with one that lacks a needed key."""
    if not exists(spark, path):
        return spark.createDataFrame([], "file string, line string, reason string")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.withColumn("row", F.from_json("line", SCHEMA, options))
    reason = (
        F.when(F.trim(F.regexp_replace("line", r"\s", " ")) == "", "blank")
        .when(F.col("row").isNull() | F.col("row._corrupt_record").isNotNull(), "malformed")
        .when(F.col("row.cost").isNull(), "no cost")
        .when(~complete("row."), "missing key")
    )
    return parsed.select("file", "line", reason.alias("reason")).where("reason is not null")


def rejects_by_file(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("file", "reason").agg(F.count("*").alias("n_lines"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All readable rows; blank and malformed lines are skipped, a missing log is an empty one."""
    if not exists(spark, path):
        return readable(spark.createDataFrame([], SCHEMA))
    return readable(spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path))


def readable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


NEEDED = ("question", "cost.input_tokens", "cost.output_tokens", "cost.latency_s", "cost.model")


def complete(prefix: str = "") -> Column:
    """Whether a log row has all that a measured call needs."""
    has = F.lit(True)
    for name in NEEDED:
        has = has & F.col(prefix + name).isNotNull()
    return has


def measured_calls(rows: DataFrame) -> DataFrame:
    """Log rows with a complete cost entry, flat."""
    return rows.where(complete()).select("seq", *NEEDED)
