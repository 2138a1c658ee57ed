"""Trace files and training logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "struct<traceEvents:array<struct<name:string,ts:double,dur:double>>>"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Events ``name, ts, dur`` of trace files; events without name, ts or dur are left out."""
    files = spark.read.text(path, wholetext=True)
    return trace_events(files, "value")


def trace_events(df: DataFrame, column: str) -> DataFrame:
    events = df.select(F.explode(F.from_json(column, TRACE).getField("traceEvents")).alias("e"))
    return events.select("e.*").where("name is not null and ts is not null and dur is not null")


def read_epoch_logs(spark: SparkSession, path: str) -> DataFrame:
    """``case, np, seconds`` of every epoch line in log files named ``<case>_<np>.out``."""
    return epoch_lines(spark.read.text(path).select("value", F.input_file_name().alias("file")))


def epoch_lines(lines: DataFrame) -> DataFrame:
    """Epoch lines of ``value, file``; a line counts if it has seconds before its loss."""
    name = r"([^/]+)_(\d+)\.out$"
    seconds = F.regexp_extract("value", r"(\d+)s - loss", 1)
    return lines.where(seconds != "").select(F.regexp_extract("file", name, 1).alias("case"), F.regexp_extract("file", name, 2).cast("int").alias("np"), seconds.cast("double").alias("seconds"))
