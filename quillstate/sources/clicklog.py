"""Readers and writers of click logs: preprocessed CSV, raw TSV, day files, cardinality files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_DENSE, N_SPARSE = 13, 26
DENSE, SPARSE = [f"I{i}" for i in range(1, N_DENSE + 1)], [f"C{i}" for i in range(1, N_SPARSE + 1)]


def schema(sparse: T.DataType, index: bool = False) -> T.StructType:
    fields = [T.StructField("_c0", T.LongType())] if index else []
    fields.append(T.StructField("label", T.IntegerType()))
    fields += [T.StructField(c, T.DoubleType()) for c in DENSE] + [T.StructField(c, sparse) for c in SPARSE]
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Preprocessed examples with a header; the unnamed leading index column is left out."""
    return spark.read.schema(schema(T.LongType(), index=True)).option("header", True).option("enforceSchema", True).csv(path).drop("_c0")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Raw examples without a header; sparse columns are hexadecimal tokens."""
    return spark.read.schema(schema(T.StringType())).option("sep", "\t").csv(path)


def read_days(spark: SparkSession, path: str, sparse: T.DataType | None = None) -> DataFrame:
    """A folder of ``day_<n>`` files (or folders of files, or ``day_n=<n>`` folders) with its day number; missing numbers are 0. Files are split by Spark."""
    rows = spark.read.schema(schema(sparse or T.LongType())).option("sep", "\t").csv(f"{path.rstrip('/')}/day_*")
    return rows.fillna(0, subset=DENSE).withColumn("day_n", F.regexp_extract(F.input_file_name(), r"day_(?:n=)?(\d+|__HIVE_DEFAULT_PARTITION__)", 1).try_cast("int"))


def worker_files(spark: SparkSession, path: str, rank: int, size: int) -> list[str]:
    """The data files a worker reads: of all files below ``path`` in order of name, those at ``rank``, ``rank + size``, ..."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while found.hasNext():
        f = found.next().getPath()
        if not f.getName().startswith(("_", ".")):
            files.append(f.toString())
    return sorted(files)[rank::size]


def read_worker_days(spark: SparkSession, path: str, rank: int, size: int, sparse: T.DataType | None = None) -> DataFrame:
    """The rows of a worker's files of a folder of day files, each file read by one worker only."""
    files = worker_files(spark, path, rank, size)
    kind = schema(sparse or T.LongType())
    return spark.read.schema(kind).option("sep", "\t").csv(files) if files else spark.createDataFrame([], kind)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Numbers with six decimals, one header per file."""
    made = [F.format_string("%.6f", F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes]
    df.select(*made).write.mode(mode).option("header", True).csv(path)


def write_days(df: DataFrame, path: str, rows_per_file: int, mode: str = "error") -> None:
    """Files of at most ``rows_per_file`` rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("sep", "\t").csv(path)


def write_all_days(df: DataFrame, path: str, rows_per_file: int, mode: str = "error") -> None:
    """One folder ``day_n=<n>`` for every ``day_n`` present, in one write; files of at most ``rows_per_file`` rows."""
    df.write.mode(mode).partitionBy("day_n").option("maxRecordsPerFile", rows_per_file).option("sep", "\t").csv(path)


def write_records(df: DataFrame, path: str, rows_per_file: int = 1_000_000, mode: str = "error") -> None:
    """Columnar example files of a bounded size."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``C<i> <count>`` as ``column, cardinality``."""
    return spark.read.schema("column string, cardinality bigint").option("sep", " ").csv(path)


def write_vocabulary(cardinalities: DataFrame, path: str, mode: str = "error") -> None:
    cardinalities.select("column", "cardinality").write.mode(mode).option("sep", " ").csv(path)
