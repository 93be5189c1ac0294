"""Sources and sinks: JSON lines with declared schemas, Parquet indexes, text and PDF pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidara import schemas


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One object a line; blank lines are skipped and missing keys are null."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table; ``spread`` deals its rows over all cores where its files give fewer tasks than cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return scan.repartition(cores) if spread and scan.rdd.getNumPartitions() < cores else scan


def save_index(vectors: DataFrame, path: str, partition_by: str | None = None, mode: str = "error") -> None:
    """Vectors with their ids; a facet as partition column lets filtered searches prune files."""
    writer = vectors.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """Raises AnalysisException if the path is missing."""
    return spark.read.parquet(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def scan_files(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """(pattern, path, text): files under ``root`` by ordered globs, each once, by its first glob.

    ``path`` is relative to ``root``; globs that match nothing are passed over.
    """
    from pyspark.errors import AnalysisException

    from evidara.operators.graph import first_hits

    out, base = None, root.rstrip("/") + "/"
    for i, g in enumerate(globs):
        try:
            one = read_texts(spark, base + g).select(F.lit(i).alias("pattern"), F.substring_index("path", base.removeprefix("file://"), -1).alias("path"), "text")
        except AnalysisException:
            continue
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], "pattern int, path string, text string") if out is None else first_hits(out)


def read_pdf_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[dict]]) -> DataFrame:
    """(source_file, page_num, full_text, lines) of PDF files through a plugged-in parser.

    ``parse`` gets a file's bytes and returns one dict a page with full_text and lines of
    (text, size).  No PDF library is bundled; only this byte step is Python.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = T.StructType([T.StructField("source_file", T.StringType()), *schemas.PAGES.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                pages = parse(bytes(content))
                yield pd.DataFrame([{"source_file": name.rsplit("/", 1)[-1], "page_num": i + 1, "full_text": p["full_text"], "lines": p["lines"]} for i, p in enumerate(pages)], columns=[f.name for f in schema])

    return files.mapInPandas(run, schema)


def write_report(df: DataFrame, path: str, title: str = "Report") -> None:
    """A result as a Markdown table on the driver's disk, all rows, one partition at a time."""
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    with open(path, "w") as f:
        f.write(f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns) + "\n")
        for r in df.toLocalIterator():
            f.write("| " + " | ".join(cell(v) for v in r) + " |\n")


def write_json_report(df: DataFrame, path: str, **about) -> None:
    """A result as one JSON object on the driver's disk: ``about``, the number of rows and all rows."""
    n = 0
    with open(path, "w") as f:
        f.write(json.dumps(about, ensure_ascii=False, default=str)[:-1] + (", " if about else "") + '"rows": [')
        for r in df.toLocalIterator():
            f.write((",\n" if n else "\n") + json.dumps(r.asDict(True), ensure_ascii=False, default=str))
            n += 1
        f.write(f'\n], "n_rows": {n}}}\n')
