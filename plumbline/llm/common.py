"""Helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The white space that parts words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value together with its classes, so that executors need not have this
    package; the result gets it back inside a task.  The value must be of bounded size."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        return pickle.loads(sent.value)
    return get


def kept(spark: SparkSession, value: object) -> Callable[[], object]:
    """Like :func:`shared`, but a Python worker unpacks the value once and hands the same
    object to all its tasks: for values that cost time to unpack or that learn as they go."""
    sent = spark.sparkContext.broadcast([cloudpickle.dumps(value)])

    def get() -> object:
        held = sent.value
        if len(held) == 1:
            held.append(pickle.loads(held[0]))
        return held[1]
    return get


def trim() -> None:
    """Give memory that a task no longer needs back to the system.  A Python worker outlives its
    task, and what it holds on to is missing in the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    found = F.array_remove(F.split(text, SPACE), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(words(text)).cast("bigint")
