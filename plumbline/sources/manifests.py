"""Manifest scans and report / routing sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import has_columns, require_columns

#: Columns that reproduce the order of rows in the files.
FILE_ORDER = ["_file_path", "_file_start", "_file_row"]


@dataclass(frozen=True)
class ManifestSource:
    """One registered corpus: where its manifest and its assets live."""

    name: str
    root: str
    manifest: str
    id_col: str = "file_id"
    subdirs: tuple[str, ...] = ()
    label: int | None = None

    def bases(self) -> list[str]:
        """Asset folders in order of preference."""
        root = self.root.rstrip("/")
        return [f"{root}/{s}" for s in self.subdirs] if self.subdirs else [root]

    def manifest_path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.manifest}"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern names any file; lists, but reads nothing."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return False
    return True


def scan_manifest(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = (),
                  multi_line: bool = True, file_order: bool = False) -> DataFrame:
    """CSV manifest with a header, every column a string.

    A missing file gives zero rows with the given ``columns``; of several paths those that
    exist are read.  ``multi_line`` allows line breaks inside quotes at the price of one task per file; turn it off
    for large files without such cells so that they split.
    """
    there = [p for p in ([path] if isinstance(path, str) else path) if _exists(spark, p)]
    if there:
        df = spark.read.csv(there, header=True, inferSchema=False, multiLine=multi_line,
                            escape='"', encoding="UTF-8")
    else:
        cols = [*columns, *(FILE_ORDER if file_order else [])]
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType())
                                                       for c in cols]))
    if file_order:
        df = df.select("*", F.col("_metadata.file_path").alias("_file_path"),
                       F.col("_metadata.file_block_start").alias("_file_start"),
                       F.monotonically_increasing_id().alias("_file_row"))
    return df


def scan_registry(spark: SparkSession, sources: Sequence[ManifestSource],
                  columns: Sequence[str] = (),
                  keep: Callable[[DataFrame, ManifestSource], DataFrame] | None = None,
                  file_order: bool = False, skip_invalid: bool = False,
                  multi_line: bool = True) -> DataFrame:
    """All registered manifests as one frame, tagged with source name and label.

    ``multi_line=False`` lets large manifests without line breaks in cells split.

    ``keep`` filters each manifest before the union, while the columns it really
    has are still known.  A manifest without its id column is an error, or left out
    with ``skip_invalid``.
    """
    parts = []
    for i, src in enumerate(sources):
        df = scan_manifest(spark, src.manifest_path(), [src.id_col, *columns],
                           multi_line, file_order)
        if skip_invalid and not has_columns(df, [src.id_col]):
            continue
        df = require_columns(df, [src.id_col]).withColumnRenamed(src.id_col, "file_id")
        if file_order:
            for c in ("_file_start", "_file_row"):
                df = df.withColumn(c, F.col(c).cast("bigint"))
        if keep is not None:
            df = keep(df, src)
        parts.append(df.withColumn("source", F.lit(src.name))
                     .withColumn("source_rank", F.lit(i))
                     .withColumn("label", F.lit(src.label).cast("int")))
    if not parts:
        raise ValueError("no manifest has its id column")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_routed(df: DataFrame, route: str, path: str, fmt: str = "csv",
                 mode: str = "errorifexists") -> None:
    """One pass, one folder per route.  An existing target is an error unless ``mode`` says
    otherwise; ``overwrite`` empties the whole folder."""
    writer = df.write.mode(mode).partitionBy(route)
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)


def write_report(df: DataFrame, path: str, single: bool = True, mode: str = "errorifexists") -> None:
    """Result table as CSV: one file, or with ``single=False`` one per partition for tables
    that are no summaries.  The layout does not depend on the size."""
    (df.coalesce(1) if single else df).write.mode(mode).csv(path, header=True)
