"""Asset listings: which files belong to which sample, and what is missing."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from .files import fetch
from .manifests import ManifestSource

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Folder and file name endings per kind, in order of preference.
NAMES = {
    "audio": ("audio", [".flv_melspec.npy", "_melspec.npy"]),
    "input_ids": ("text", [".flv_input_ids.npy", "_input_ids.npy"]),
    "attention_mask": ("text", [".flv_attention_mask.npy", "_attention_mask.npy"]),
}
WEIGHT_FILES = ["keyframe_weights.npy", "attention_weights.npy", "attention_weights.json"]
FRAME_PATTERN = r"^frame_.*\.jpg$"


def plain_path(path: Column | str) -> Column:
    """Path without scheme, so that listings and registered roots compare equal."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def parse_assets(listing: DataFrame, source: ManifestSource, path: str = "path") -> DataFrame:
    """(source, base, base_rank, file_id, kind, variant, path, ...) of a file listing.

    The listing may be any table with a path column: a ``binaryFile`` scan, or an
    inventory export for stores that hold too many files to list on the driver.
    A name like ``X.flv_melspec.npy`` can belong to id ``X`` or to id ``X.flv``;
    both readings are emitted and the manifest join keeps the right one.
    """
    bases = [b.rstrip("/") for b in source.bases()]
    base_names = F.array(*[plain_path(F.lit(b)) for b in bases])
    p = plain_path(path)
    parts = F.regexp_extract(p, r"^(.*)/(audio|text)/([^/]+)$", 1)
    folder = F.regexp_extract(p, r"^(.*)/(audio|text)/([^/]+)$", 2)
    name = F.regexp_extract(p, r"^(.*)/(audio|text)/([^/]+)$", 3)
    readings = []
    for kind, (where, endings) in NAMES.items():
        for rank, ending in enumerate(endings):
            hit = (folder == where) & name.endswith(ending) & (F.length(name) > len(ending))
            readings.append(F.when(hit, F.struct(
                parts.alias("base"),
                F.substring(name, F.lit(1), F.length(name) - len(ending)).alias("file_id"),
                F.lit(kind).alias("kind"), F.lit(rank).alias("variant"))))
    vbase = F.regexp_extract(p, r"^(.*)/visual/([^/]+)/([^/]+)$", 1)
    vid = F.regexp_extract(p, r"^(.*)/visual/([^/]+)/([^/]+)$", 2)
    vname = F.regexp_extract(p, r"^(.*)/visual/([^/]+)/([^/]+)$", 3)
    vkind = (F.when(vname.rlike(FRAME_PATTERN), "frame")
             .when(vname.isin(*WEIGHT_FILES), "weights").otherwise("other"))
    vrank = F.when(vkind == "weights", F.array_position(
        F.array(*[F.lit(n) for n in WEIGHT_FILES]), vname) - 1).otherwise(0).cast("int")
    readings.append(F.when(vid != "", F.struct(
        vbase.alias("base"), vid.alias("file_id"), vkind.alias("kind"), vrank.alias("variant"))))
    found = F.explode(F.filter(F.array(*readings), lambda r: r.isNotNull()))
    out = listing.withColumn("_a", found)
    rank = F.array_position(base_names, F.col("_a.base"))
    return (out.filter(rank > 0)
            .select(F.lit(source.name).alias("source"), F.col("_a.base").alias("base"),
                    (rank - 1).cast("int").alias("base_rank"), F.col("_a.file_id").alias("file_id"),
                    F.col("_a.kind").alias("kind"), F.col("_a.variant").alias("variant"),
                    *[c for c in listing.columns]))


def _local(root: str) -> str | None:
    """The path of a root in the file system that all machines share, else None."""
    found = re.match(r"^(?:file:/*(?=/[^/]))?(/.*)$", root)
    return found and (found.group(1).rstrip("/") or "/")


def _seen(name: str) -> bool:
    """Whether Spark's own file sources would list a name."""
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names in every given folder, without a look at what they name."""
    def rows():
        for batch in batches:
            for place, root, folder, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not os.path.isdir(root):
                    raise FileNotFoundError(f"no folder {root}")
                if os.path.isdir(folder):
                    with os.scandir(folder) as entries:
                        yield from ((place, inside, os.fsencode(e.path)) for e in entries if _seen(e.name))

    return _in_batches(rows(), pa.schema([("place", pa.int32()), ("inside", pa.bool_()), ("path", pa.binary())]))


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, path, length) of every named file, or with ``inside`` of the files in every
    named folder."""
    def rows():
        for batch in batches:
            for place, inside, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if inside and os.path.isdir(path):
                    with os.scandir(os.fsdecode(path)) as entries:
                        yield from ((place, _shown(e.path), e.stat().st_size) for e in entries if _seen(e.name) and e.is_file())
                elif not inside and os.path.isfile(path):
                    yield place, _shown(path), os.stat(path).st_size

    return _in_batches(rows(), pa.schema([("place", pa.int32()), ("path", pa.string()), ("length", pa.int64())]))


def _shown(path: str | bytes) -> str:
    return "file:" + os.fsencode(path).decode("utf-8", "replace")


def _listed(spark: SparkSession, sources: Sequence[ManifestSource]) -> DataFrame:
    """(place, path, length) of the asset files of sources in a shared file system; place is
    the position of the source.

    A task reads the names in one of the few asset folders; these are dealt to tasks that
    look at each file, or list each sample's folder.  Neither files nor partitions pass
    through the driver, and what was found is stored, so that all readers see the same files.
    """
    bases = [(i, _local(s.root), _local(b) or "") for i, s in enumerate(sources) for b in dict.fromkeys(s.bases())]
    folders = [(i, root, f"{base}/{name}", name == "visual") for i, root, base in bases for name in ("audio", "text", "visual")]
    places = spark.createDataFrame(folders, "place int, root string, folder string, inside boolean")
    names = places.mapInArrow(_names, "place int, inside boolean, path binary")
    dealt = names.repartition(4 * spark.sparkContext.defaultParallelism, "path")
    found = dealt.mapInArrow(_files, "place int, path string, length long")
    # A base inside another one has files that belong to both.
    if any(i == j and a.startswith(f"{b}/") for i, _, a in bases for j, _, b in bases):
        found = found.distinct()
    return stored(found)


def list_assets(spark: SparkSession, source: ManifestSource, content: bool = False) -> DataFrame:
    """Listing of a source's asset tree; file contents are read only on request."""
    return list_registry_assets(spark, [source], content)


def list_registry_assets(spark: SparkSession, sources: Sequence[ManifestSource],
                         content: bool = False) -> DataFrame:
    """Listings of all registered sources as one frame, tagged with the source.

    Roots in a file system that all machines share are listed in tasks, of all sources
    together; those in other stores as Spark's file sources do it, through the driver.
    """
    shared = [s for s in sources if _local(s.root)]
    listed = _listed(spark, shared) if shared else None
    parts = []
    for s in sources:
        if s in shared:
            found = parse_assets(listed.filter(F.col("place") == shared.index(s)).select("path", "length"), s)
            if content:
                found = fetch(found, {"path": "content"})
                failed = F.raise_error(F.concat(F.lit("cannot read "), "path", F.lit(": "), "error")).cast("binary")
                found = found.withColumn("content", F.when(F.col("error").isNull(), F.col("content")).otherwise(failed)).drop("error")
        else:
            raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(s.root)
            found = parse_assets(raw.select("path", "length", *(["content"] if content else [])), s)
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)


def inventory(expected: DataFrame, listing: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected artefacts with status present / MISSING."""
    seen = listing.select(*on).distinct().withColumn("_seen", F.lit(True))
    return (expected.join(seen, list(on), "left")
            .withColumn("status", F.when(F.col("_seen"), "present").otherwise("MISSING"))
            .drop("_seen"))
