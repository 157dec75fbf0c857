"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the scan and quality contracts: runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode, where driver and executors are
    one process, an unset one becomes a temporary folder; on a cluster that would be each machine's own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="vartide-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends there, lost executors cost nothing."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch = path
    return written


def discard(written: DataFrame) -> None:
    """Delete a table of `materialize` that nothing reads any more."""
    spark = written.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(written._scratch)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def release(spark: SparkSession) -> None:
    """Between phases whose results are written tables: let go of finished stages' shuffle files."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
