"""Dense-array files (.npy) and JSON weight maps as columns."""

from __future__ import annotations

import io
import sys
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import read_file

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SHAPE = T.StructField("shape", T.ArrayType(T.IntegerType()))
_ERR = T.StructField("err", T.StringType())
ARRAY = T.StructType([_SHAPE, T.StructField("data", T.ArrayType(T.FloatType())),
                      T.StructField("ints", T.ArrayType(T.LongType())), _ERR])
PROBE = T.StructType([_SHAPE, *[T.StructField(c, T.BooleanType())
                                for c in ("is_float", "has_nan", "has_inf")], _ERR])
WEIGHT_MAP = "map<string,struct<alpha:double>>"


def _load(raw: bytes | None) -> np.ndarray:
    return np.load(io.BytesIO(raw or b""), allow_pickle=False)


@F.pandas_udf(ARRAY)
def _decode(content: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in content:
        try:
            a = _load(raw)
            whole = np.issubdtype(a.dtype, np.integer)
            rows.append((list(a.shape), a.astype(np.float32).reshape(-1),
                         a.astype(np.int64).reshape(-1) if whole else None, None))
        except Exception as e:  # noqa: BLE001 - a broken file is a value, not a failure
            rows.append((None, None, None, type(e).__name__))
    return pd.DataFrame(rows, columns=["shape", "data", "ints", "err"])


def _looked_at(load: Callable[[], np.ndarray]) -> tuple:
    try:
        a = load()
        floating = bool(np.issubdtype(a.dtype, np.floating))
        return (list(a.shape), floating, floating and bool(np.isnan(a).any()),
                floating and bool(np.isinf(a).any()), None)
    except Exception as e:  # noqa: BLE001 - a broken file is a value, not a failure
        return None, None, None, None, type(e).__name__


@F.pandas_udf(PROBE)
def _probe(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_looked_at(lambda: _load(raw)) for raw in content], columns=PROBE.names)


@F.pandas_udf(PROBE)
def _probe_file(path: pd.Series) -> pd.DataFrame:
    # Files are opened some together, and none is held longer than it takes to look at it.
    with ThreadPoolExecutor(8) as pool:
        rows = list(pool.map(lambda p: (None,) * 5 if p is None else _looked_at(lambda: _load(read_file(p))), path))
    return pd.DataFrame(rows, columns=PROBE.names)


@F.pandas_udf(T.BinaryType())
def encode_array(data: pd.Series) -> pd.Series:
    """1-D float array to .npy bytes."""
    def pack(values: np.ndarray) -> bytes:
        buf = io.BytesIO()
        np.save(buf, np.asarray(values, dtype=np.float32), allow_pickle=False)
        return buf.getvalue()
    return data.map(pack)


@F.pandas_udf(T.BinaryType())
def encode_ints(data: pd.Series) -> pd.Series:
    """1-D whole-number array to .npy bytes."""
    def pack(values: np.ndarray) -> bytes:
        buf = io.BytesIO()
        np.save(buf, np.asarray(values, dtype=np.int64), allow_pickle=False)
        return buf.getvalue()
    return data.map(pack)


def _packed(values: np.ndarray, rows: int, kind: type) -> bytes:
    buf = io.BytesIO()
    np.save(buf, np.asarray(values, dtype=kind).reshape(rows, -1), allow_pickle=False)
    return buf.getvalue()


@F.pandas_udf(T.BinaryType())
def encode_matrix(data: pd.Series, rows: pd.Series) -> pd.Series:
    """Flat float array to .npy bytes of an array with that many rows."""
    return pd.Series([_packed(x, n, np.float32) for x, n in zip(data, rows, strict=True)])


@F.pandas_udf(T.BinaryType())
def encode_int_matrix(data: pd.Series, rows: pd.Series) -> pd.Series:
    """Flat whole-number array to .npy bytes of an array with that many rows."""
    return pd.Series([_packed(x, n, np.int64) for x, n in zip(data, rows, strict=True)])


def decode_arrays(df: DataFrame, content: str = "content", out: str = "array") -> DataFrame:
    """Add struct(shape, data, ints, err): flat float data, or the error's name.

    Integer files also have their exact values in ``ints``, since floats hold whole numbers
    only up to 2**24.
    """
    return df.withColumn(out, _decode(F.col(content)))


def probe_arrays(df: DataFrame, content: str = "content", out: str = "probe") -> DataFrame:
    """Add struct(shape, is_float, has_nan, has_inf, err) without the data itself."""
    return df.withColumn(out, _probe(F.col(content)))


def probe_files(df: DataFrame, when: Column, path: str = "path", out: str = "probe") -> DataFrame:
    """The same from the files themselves, which are opened in the tasks; NULL where ``when``
    does not hold."""
    return df.withColumn(out, F.when(when, _probe_file(F.when(when, F.col(path)))))


def bands(array: Column | str) -> Column:
    """Band-major 2-D array from a decoded struct(shape, data)."""
    a = F.col(array) if isinstance(array, str) else array
    rows, cols = F.get(a["shape"], F.lit(0)), F.get(a["shape"], F.lit(1))
    steps = F.when(rows > 0, F.sequence(F.lit(0), rows - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.slice(a["data"], i * cols + 1, cols))


def parse_weight_map(col: Column | str) -> Column:
    """``{frame: {"alpha": x}}`` as array<struct<frame, alpha>> in frame order; a missing
    alpha is 0."""
    c = F.col(col) if isinstance(col, str) else col
    entries = F.array_sort(F.map_entries(F.from_json(c, WEIGHT_MAP)))
    return F.transform(entries, lambda e: F.struct(
        e["key"].alias("frame"),
        F.coalesce(e["value"]["alpha"], F.lit(0.0)).alias("alpha")))
