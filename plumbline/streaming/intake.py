"""Continuous intake: admission, scoring and verdict records on a file stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from ..operators.filters import EXTENSIONS, MAX_MB, admit


def read_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return (spark.readStream.format("binaryFile").schema(schema)
            .option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true")
            .load(folder))


def read_scores(spark: SparkSession, folder: str, schema, per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
            .parquet(folder))


def admitted(df: DataFrame, path: str = "path", length: str = "length",
             max_mb: float = MAX_MB, exts=EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(admitted rows, refused rows with their reason)."""
    judged = admit(df, path, length, exts, max_mb)
    ok = judged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return ok, judged.filter(F.col("reject_reason").isNotNull())


def intake_stream(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], sink: str,
                  checkpoint: str, path: str = "path", length: str = "length",
                  available_now: bool = True) -> StreamingQuery:
    """Append ``judge(admitted rows)`` to a Parquet sink; :func:`refused_stream` takes the rest.

    The flow keeps no state across rows, so it needs no watermark.  ``checkpoint``
    must lie in shared storage; the file sink then writes each row exactly once.
    """
    ok, _ = admitted(stream, path, length)
    return _started(judge(ok), sink, checkpoint, available_now)


def refused_stream(stream: DataFrame, sink: str, checkpoint: str, columns: Sequence[str],
                   path: str = "path", length: str = "length", available_now: bool = True) -> StreamingQuery:
    """Append every refused row of the same stream, with ``reject_reason``, to its own sink.

    It runs beside :func:`intake_stream` with a checkpoint of its own, so that each row of
    the stream ends up in exactly one of the two sinks.
    """
    _, refused = admitted(stream, path, length)
    return _started(refused.select(*columns, "reject_reason"), sink, checkpoint, available_now)


def route_stream(stream: DataFrame, judge: Callable[[DataFrame], DataFrame], target: str, checkpoint: str,
                 columns: Sequence[str], path: str = "path", length: str = "length",
                 available_now: bool = True, between: Callable[[int], None] | None = None) -> StreamingQuery:
    """Verdicts and refusals of a stream from one read of each micro-batch.

    ``judge(admitted rows)`` goes to ``target``/verdicts, the refused rows' ``columns`` with
    ``reject_reason`` to ``target``/refused, each in a folder named by the number of the
    micro-batch.  A micro-batch that is run again after a failure, wherever that was, holds
    the same rows and replaces its folders: no row is lost or written twice.  The rows of a
    micro-batch are kept on the executors between the two writes, so the trigger's size
    bounds them.  ``between`` is called there, with the number of the micro-batch.

    :func:`routed` reads both tables.
    """
    def write(batch: DataFrame, number: int) -> None:
        held = admit(batch, path, length, EXTENSIONS, MAX_MB).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ok = held.filter(F.col("reject_reason").isNull()).drop("reject_reason")
            refused = held.filter(F.col("reject_reason").isNotNull()).select(*columns, "reject_reason")
            for name, rows in (("verdicts", judge(ok)), ("refused", refused)):
                if name == "refused" and between is not None:
                    between(number)
                rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def routed(spark: SparkSession, target: str) -> DataFrame:
    """All answered rows: verdicts, and refusals with their reason; ``batch`` is the number of
    the micro-batch that a row came in."""
    tables = [spark.read.parquet(f"{target}/{name}") for name in ("verdicts", "refused")]
    return tables[0].unionByName(tables[1], allowMissingColumns=True)


def _started(df: DataFrame, sink: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = (df.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint).option("path", sink))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
