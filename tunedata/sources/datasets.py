"""Dataset references (A1): a path is read by its suffix, anything else is a catalog table.

Suffixes: ``.json`` (JSON lines, or one JSON array per file), ``.jsonl``, ``.csv`` (header row,
quoted fields may span lines), ``.parquet``, ``.txt`` (one row per line, column ``text``).
Unlike the single-file loader it mirrors, a directory or glob with one of these suffixes is
accepted too (Spark writes datasets as directories of part files).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".json", ".jsonl", ".csv", ".parquet", ".txt")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_status(spark: SparkSession, path: str) -> str:
    """'file', 'dir', 'glob' or 'missing' (through the Hadoop filesystem, so any scheme works)."""
    p, fs = _fs(spark, path)
    if any(ch in path for ch in "*?[{"):
        found = fs.globStatus(p)
        return "glob" if found is not None and len(found) > 0 else "missing"
    if not fs.exists(p):
        return "missing"
    return "dir" if fs.getFileStatus(p).isDirectory() else "file"


def _array_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """``(files that hold one JSON array, other files)``: by the first character of a file that is no
    blank, wherever it stands. One pass over the lines; only the file names come to the driver,
    which lists them for every read anyway."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
                                         F.regexp_extract("value", r"^[\s\uFEFF]*(\S)", 1).alias("first"))
    found = lines.where("first <> ''").groupBy("file").agg(F.min_by("first", "at").alias("first")).collect()
    return [r["file"] for r in found if r["first"] == "["], [r["file"] for r in found if r["first"] != "["]


def _json(spark, path, status):
    arrays, others = _array_files(spark, path)
    if not arrays:
        return spark.read.json(path)
    rows = spark.read.option("multiLine", True).json(arrays)  # an array is one task, however long
    return rows.unionByName(spark.read.json(others), allowMissingColumns=True) if others else rows


def _jsonl(spark, path, status):
    return spark.read.json(path)


def _csv(spark, path, status):
    return (spark.read.option("header", True).option("inferSchema", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def _parquet(spark, path, status):
    return spark.read.parquet(path)


def _txt(spark, path, status):
    return spark.read.text(path).withColumnRenamed("value", "text")


READERS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {
    ".json": _json, ".jsonl": _jsonl, ".csv": _csv, ".parquet": _parquet, ".txt": _txt,
}


def register_reader(suffix: str, reader: Callable[[SparkSession, str, str], DataFrame]) -> None:
    READERS[suffix.lower()] = reader


def read_dataset(spark: SparkSession, ref: str, split: str = "train") -> DataFrame:
    """Resolve ``ref``: an existing path by suffix (unknown suffix raises), else a table name.

    Local files are one split: every row is read whatever ``split`` asks for."""
    status = path_status(spark, ref)
    if status != "missing":
        name = ref.rstrip("/").split("/")[-1]
        suffix = ("." + name.rsplit(".", 1)[-1].lower()) if "." in name else ""
        reader = READERS.get(suffix)
        if reader is None:
            raise ValueError(f"Unsupported local dataset source: {ref}")
        return reader(spark, ref, status)
    if "/" in ref:
        raise ValueError(f"dataset path does not exist: {ref}")
    return spark.table(ref)
