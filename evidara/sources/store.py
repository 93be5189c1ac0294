"""Where intermediate tables and indexes stand: one folder an application, in the storage that all executors share."""

from __future__ import annotations

import atexit
import hashlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder.

    Where none is set, a local master (tests) gets a temporary folder; a cluster must name one, as
    its executors could not read what others wrote to their own disks.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="evidara-checkpoint-")
        atexit.register(shutil.rmtree, local, True)
        known = "file://" + local
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/evidara-{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Delete this application's tables and indexes, once no result that reads them is needed."""
    path = _path(spark, application_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, kind: str = "table") -> str:
    return f"{application_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def exists(spark: SparkSession, name: str) -> bool:
    path = _path(spark, name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def stamp(df: DataFrame) -> str:
    """Digest of the files that ``df`` reads: their names, sizes and times, so that a changed input gets another."""
    spark, digest = df.sparkSession, hashlib.sha256()
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in sorted(df.inputFiles()):
        path = _path(spark, name)
        status = path.getFileSystem(conf).getFileStatus(path)
        digest.update(f"{name} {status.getLen()} {status.getModificationTime()}\n".encode())
    return digest.hexdigest()[:32]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again: cuts lineage, and outlives executors."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
