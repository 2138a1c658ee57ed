"""Session helpers: cutting lineage, reading partition counts, bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a local folder only where none is named and the master is local (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillstate-checkpoint-"))


def shared_dir(spark: SparkSession) -> str:
    """A folder all executors see, for tables an operator has to write."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


_made: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared folder, deleted when the driver's Python ends and its session still runs.

    Results are lazy and may read it until then.
    """
    path = f"{shared_dir(spark)}/quillstate/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append(path)
    return path


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        for path in _made:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: what is left is the folder's owner's to clean
        return


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after ``df`` was seen to hold at most ``max_rows`` rows.

    The probe reads at most ``max_rows + 1`` rows. Beyond the bound the frame is
    returned unhinted, and Catalyst shuffles both sides of the join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
