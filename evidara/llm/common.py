"""Shared helpers of the training-data operators.

Word rule used everywhere here: a word is a maximal run of characters outside
``[\\x20\\x09-\\x0D]``; ``bytes.split()`` in Python and the Java class below agree on it.
"""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions.plan import steady_unions

WS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A file scan's rows over all cores, where its files and row groups give fewer tasks than cores.

    Only for plain scans, whose number of tasks is known without running anything; large tables
    have tasks enough and are left as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body`` (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


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


def intermediate_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/evidara-{spark.sparkContext.applicationId}"


def drop_intermediate(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(intermediate_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


ROWS_A_FILE = 200_000  #: of narrow rows; below it more files only cost tasks


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many partitions as its number of narrow rows calls for, never more than it has."""
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder; survives lost executors.

    Unlike ``checkpoint()`` the copy is columnar, so later readers fetch only what they use.
    ``rows``, where about known, avoids a swarm of tiny files.
    """
    spark = df.sparkSession
    steady_unions(spark)
    df = df if rows is None else fitted(df, rows)
    path = f"{intermediate_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def process_cache() -> dict:
    """A dict that lives as long as the Python worker, for loaded models."""
    return sys.__dict__.setdefault("_evidara_worker_cache", {})


def give_back() -> None:
    """Return a Python worker's freed memory to the system; idle workers count on their executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """``run``, an iterator over Arrow batches, that gives memory back at the end of its partition."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions by value, so executors need not have this package installed."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_by_value(__name__)
