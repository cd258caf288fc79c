"""Contents of named files: fetched for the rows that need them, and written.

A listing tells which files there are without opening one.  Once rows have chosen their files
by path alone, :func:`fetch` opens those, and only those, inside the tasks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Reads the file at a path.
Opener = Callable[[str], bytes]


def _located(path: str):
    """The file system of a path, and the path inside it."""
    from pyarrow import fs

    if local := re.match(r"^(?:file:/*(?=/[^/]))?(/.*)$", path):
        return fs.LocalFileSystem(), local.group(1)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def read_file(path: str) -> bytes:
    """The content of a file on any store that Arrow knows (local, S3, GCS, HDFS)."""
    system, inside = _located(path)
    with system.open_input_stream(inside) as stream:
        return stream.read()


def _folder(path: str | None) -> str:
    return (path or "").rpartition("/")[0]


def fetch(df: DataFrame, contents: Mapping[str, str], opener: Opener = read_file, prefix: str = "",
          rows: int = 32, threads: int = 8) -> DataFrame:
    """Add the contents of the files that path columns name: ``contents`` maps path columns
    to new binary columns; ``error`` holds the name of the first failure of a row.

    A null path gives null content and opens nothing.  ``rows`` rows are in memory at a time;
    their paths are opened folder by folder, a path that occurs again only once, ``threads`` of
    them together.  ``prefix`` goes in front of paths that have lost their scheme (``s3:/``).
    """
    names = df.columns
    pairs = list(contents.items())

    def load(path: str) -> tuple[bytes | None, str | None]:
        try:
            return opener(prefix + path), None
        except Exception as e:  # noqa: BLE001 - a missing file is a value, not a failure
            return None, type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for start in range(0, batch.num_rows, rows):
                    part = batch.slice(start, rows)
                    paths = [part.column(names.index(p)).to_pylist() for p, _ in pairs]
                    wanted = sorted({p for column in paths for p in column if p is not None},
                                    key=lambda p: (_folder(p), p))
                    got = dict(zip(wanted, pool.map(load, wanted), strict=True))
                    got[None] = (None, None)
                    made = [pa.array([got[p][0] for p in column], pa.binary()) for column in paths]
                    errors = [next((got[p][1] for p in row if got[p][1]), None) for row in zip(*paths, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, *made, pa.array(errors, pa.string())],
                        [*part.schema.names, *[out for _, out in pairs], "error"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    fields += [f"`{out}` binary" for _, out in pairs] + ["error string"]
    return df.mapInArrow(run, ", ".join(fields))


def write_files(df: DataFrame, path: Column | str, content: Column | str) -> int:
    """Write each row's content to its path and return how many files were written.

    Folders are made as needed and a file that is there is replaced, so a task that runs
    again gives the same files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                system, inside = _located(name)
                if _folder(inside) not in made:
                    system.create_dir(_folder(inside), recursive=True)
                    made.add(_folder(inside))
                with system.open_output_stream(inside) as stream:
                    stream.write(raw.as_buffer())
            yield pa.RecordBatch.from_arrays([pc.cast(pa.array([batch.num_rows]), pa.int64())], ["n"])

    sent = df.select((F.col(path) if isinstance(path, str) else path).alias("path"),
                     (F.col(content) if isinstance(content, str) else content).cast("binary").alias("content"))
    return sent.filter("path IS NOT NULL AND content IS NOT NULL").mapInArrow(run, "n long").agg(
        F.coalesce(F.sum("n"), F.lit(0))).first()[0]
