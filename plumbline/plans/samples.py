"""From manifest rows and a file listing to model-ready samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import (
    CROP_WIDTH,
    SLOTS,
    center_crop_bands,
    seeded_crop_bands,
    span_mask,
    zscore_bands,
)
from ..operators.order import top_per_group
from ..operators.resolve import complete_samples
from ..sources.arrays import bands, decode_arrays, parse_weight_map
from ..sources.files import Opener, fetch, read_file

KEY = ["source", "base", "file_id"]


def frame_names(chosen: DataFrame, listing: DataFrame, k: int = SLOTS) -> DataFrame:
    """The first ``k`` frames by name of every chosen sample: (source, base, file_id, names).

    Frames of other samples go before anything is ranked, and a sample's frames beyond the
    first ``k`` before they are shuffled.
    """
    frames = listing.filter("kind = 'frame'").select(*KEY, F.element_at(F.split("path", "/"), -1).alias("name"))
    first = top_per_group(frames.join(chosen.select(*KEY).distinct(), KEY, "left_semi"), KEY, ["name"], k)
    return first.groupBy(*KEY).agg(F.array_sort(F.collect_list("name")).alias("names"))


def frame_weights(names: Column, n_frames: Column, kind: Column, weights: Column, text: Column, k: int) -> Column:
    """array<struct<frame, alpha>> of the first ``k`` frames: as a JSON map has them, in name
    order; from a vector that has a value for each frame; else equal shares of all frames."""
    from_map = F.slice(parse_weight_map(text), 1, k)
    fits = F.coalesce(F.size(weights) == n_frames, F.lit(False)) & (kind == "npy")
    shares = F.transform(names, lambda _: F.lit(1.0) / n_frames)
    alpha = F.when(fits, F.slice(weights.cast("array<double>"), 1, k)).otherwise(shares)
    named = F.zip_with(names, alpha, lambda n, a: F.struct(n.alias("frame"), a.alias("alpha")))
    return F.when(kind == "json", from_map).otherwise(named)


def prepare_samples(manifest: DataFrame, listing: DataFrame, width: int = CROP_WIDTH, k: int = SLOTS,
                    augment_seed: int | None = None, equal_weights: bool = False,
                    opener: Opener = read_file, prefix: str = "") -> DataFrame:
    """One row per manifest row that has a complete sample, ready for a model.

    The files are resolved by path alone; only those chosen are then opened, in the tasks.
    Added are base, mel (bands standardised over all cells and cut or padded to ``width``
    steps), input_ids, attention_mask, frames and alpha (the first ``k`` frames by name with
    their weights, or 1 for each with ``equal_weights``) and error.  The crop is
    the middle one, or with ``augment_seed`` a drawn one, after a drawn span of bands and one
    of steps were masked; draws depend on file id and seed only.

    A row with a file that cannot be opened or decoded keeps its place: error names the
    failure, what came from the file is null, and weights fall back to equal ones.  Frames
    themselves are not opened.  Columns of the manifest stay, but for those named as above.
    """
    carried = {c: f"_m_{c}" for c in manifest.columns if c not in ("source", "file_id")}
    chosen = complete_samples(manifest.withColumnsRenamed(carried), listing)
    rows = chosen.join(frame_names(chosen, listing, k), KEY, "left")
    paths = {"audio": "_audio", "input_ids": "_ids", "attention_mask": "_mask", "weights": "_weights"}
    got = fetch(rows, paths, opener, prefix)
    got = got.withColumn("_vector", F.when(F.col("weights_kind") == "npy", F.col("_weights")))
    for column in ("_audio", "_ids", "_mask", "_vector"):
        got = decode_arrays(got, column, column)
    failed = F.coalesce("error", "_audio.err", "_ids.err", "_mask.err",
                        F.when(F.col("weights_kind") == "npy", F.col("_vector.err")))
    cells = bands("_audio")
    mel = (center_crop_bands(zscore_bands(cells), width) if augment_seed is None else
           seeded_crop_bands(zscore_bands(span_mask(cells, "file_id", augment_seed)), width, "file_id", augment_seed))
    items = frame_weights(F.coalesce("names", F.array().cast("array<string>")), F.col("n_frames"), F.col("weights_kind"),
                          F.col("_vector.data"), F.col("_weights").cast("string"), k)
    made = {"base": F.col("base"), "mel": F.when(F.col("_audio.err").isNull(), mel), "input_ids": F.col("_ids.ints"),
            "attention_mask": F.col("_mask.ints"), "frames": items["frame"],
            "alpha": F.transform(items["alpha"], lambda _: F.lit(1.0)) if equal_weights else items["alpha"], "error": failed}
    return got.select("source", "file_id", *[F.col(held).alias(c) for c, held in carried.items() if c not in made],
                      *[value.alias(c) for c, value in made.items()])
