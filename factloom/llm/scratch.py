"""Tables written once to the folder that driver and executors share, in order to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one, on a local master only."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _local[app] = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return f"file://{_local[app]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{root(spark)}/factloom-{uuid.uuid4().hex}/{tag}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later steps start from the files, also after executors are lost."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, tag: str, max_rows: int = 20_000) -> DataFrame:
    """Stages a table of few, short rows; a broadcast hint is given only if its counted rows are max_rows at most."""
    out = stage(df, tag)
    return F.broadcast(out) if out.count() <= max_rows else out


def drop(*staged: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for df in staged:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(spark: SparkSession, size: int, each: int = 32 << 20, most: int = 100_000) -> int:
    """Tasks for `size` bytes: the shuffle partitions, or more where one would get over `each` bytes, up to `most`."""
    return max(partitions(spark), min(most, -(-size // each)))
