"""Resolve manifest rows to assets: name precedence, complete sets, coverage.

Assets are reduced to one small row per (source, base, file id) with integer
aggregates only, which combine on the map side, before anything is joined.
Paths are rebuilt from the winning name variant instead of being carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import SLOTS, uniform
from ..sources.assets import NAMES, WEIGHT_FILES
from ..session import join_summary
from .order import ranked, top_per_group

FILES = ("audio", "input_ids", "attention_mask")


def _best(kind: str) -> Column:
    """Variant * 2 + (1 if that file failed to load), minimum over the copies of a kind."""
    failed = F.when(F.col("err").isNotNull(), 1).otherwise(0)
    return F.min(F.when(F.col("kind") == kind, F.col("variant") * 2 + failed))


def summarise_assets(assets: DataFrame) -> DataFrame:
    """One row per (source, base, file id): best variant per kind and frame count.

    ``assets`` comes from ``list_assets`` / ``parse_assets``; an ``err`` column, if
    there is one, marks files that did not load.
    """
    if "err" not in assets.columns:
        assets = assets.withColumn("err", F.lit(None).cast("string"))
    kinds = (*FILES, "weights")
    grouped = assets.groupBy("source", "base", "base_rank", "file_id").agg(
        *[_best(k).alias(f"_{k}") for k in kinds],
        F.count_if(F.col("kind") == "frame").alias("n_frames"),
        F.max(F.col("kind").isin("frame", "weights", "other")).alias("has_visual_dir"))
    cols = []
    for k in kinds:
        cols.append(F.floor(F.col(f"_{k}") / 2).cast("int").alias(f"{k}_variant"))
        cols.append((F.col(f"_{k}") % 2 == 1).alias(f"{k}_failed"))
    return grouped.select("source", "base", "base_rank", "file_id", *cols, "n_frames",
                          "has_visual_dir")


def _path(kind: str) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES[kind][1]])
    return F.when(F.col(f"{kind}_variant").isNotNull(), F.concat(
        F.col("base"), F.lit(f"/{NAMES[kind][0]}/"), F.col("file_id"),
        F.get(names, F.col(f"{kind}_variant"))))


def with_paths(summary: DataFrame) -> DataFrame:
    """Rebuild the chosen paths and name the kind of weights found."""
    files = F.array(*[F.lit(n) for n in WEIGHT_FILES])
    visual = F.concat(F.col("base"), F.lit("/visual/"), F.col("file_id"))
    chosen = F.get(files, F.col("weights_variant"))
    return summary.select(
        "*",
        *[_path(k).alias(k) for k in FILES],
        F.when(F.col("n_frames") > 0, visual).alias("visual_dir"),
        F.when(chosen.isNotNull(), F.concat(visual, F.lit("/"), chosen)).alias("weights"),
        F.when(chosen.isNull(), "uniform").when(chosen.endswith(".json"), "json")
        .otherwise("npy").alias("weights_kind"))


def resolve_assets(manifest: DataFrame, assets: DataFrame) -> DataFrame:
    """Every manifest row with the preferred path of each kind, per base."""
    summary = with_paths(summarise_assets(assets)).drop(
        *[f"{k}_{s}" for k in (*FILES, "weights") for s in ("variant", "failed")])
    return manifest.join(summary, ["source", "file_id"], "left")


def _is_complete() -> Column:
    present = F.col("n_frames") > 0
    for k in FILES:
        present = present & F.col(f"{k}_variant").isNotNull()
    return present


def complete_samples(manifest: DataFrame, assets: DataFrame) -> DataFrame:
    """Manifest rows whose audio, ids, mask and frames lie in one base; the first such
    base wins and rows without one are dropped."""
    full = summarise_assets(assets).filter(_is_complete())
    first = top_per_group(full, ["source", "file_id"], ["base_rank"], 1)
    keep = with_paths(first).select("source", "file_id", "base", *FILES, "visual_dir",
                                    "weights", "weights_kind", "n_frames")
    return manifest.join(keep, ["source", "file_id"], "inner")


def usable_flags() -> list[Column]:
    audio = F.coalesce(F.col("audio_variant").isNotNull() & ~F.col("audio_failed"), F.lit(False))
    text = F.col("input_ids_variant").isNotNull() & F.col("attention_mask_variant").isNotNull()
    loaded = ~F.col("input_ids_failed") & ~F.col("attention_mask_failed")
    return [audio.alias("has_audio"), F.coalesce(text & loaded, F.lit(False)).alias("has_text"),
            (F.col("n_frames") > 0).alias("has_visual")]


def coverage(manifest: DataFrame, assets: DataFrame) -> DataFrame:
    """Manifest rows tagged full / partial / absent, judged on the first base that holds
    *any* usable modality.  That may be a partial base ahead of a complete one."""
    flags = summarise_assets(assets).select("source", "file_id", "base", "base_rank",
                                            *usable_flags())
    some = flags.filter("has_audio OR has_text OR has_visual")
    first = top_per_group(some, ["source", "file_id"], ["base_rank"], 1).drop("base_rank")
    status = (F.when(F.col("base").isNull(), "absent")
              .when(F.col("has_audio") & F.col("has_text") & F.col("has_visual"), "full")
              .otherwise("partial"))
    return (manifest.join(first, ["source", "file_id"], "left").withColumn("coverage", status)
            .na.fill(False, ["has_audio", "has_text", "has_visual"]))


def absent(manifest: DataFrame, assets: DataFrame) -> DataFrame:
    """Manifest rows with nothing usable on disk."""
    usable = summarise_assets(assets).select("source", "file_id", *usable_flags())
    some = usable.filter("has_audio OR has_text OR has_visual").select("source", "file_id")
    return manifest.join(some.distinct(), ["source", "file_id"], "left_anti")


def coverage_summary(covered: DataFrame) -> DataFrame:
    """Full / partial / absent rows per source."""
    return covered.groupBy("source").agg(
        *[F.count_if(F.col("coverage") == c).alias(f"n_{c}") for c in ("full", "partial", "absent")])


def attach_weights(frames: DataFrame, weights: DataFrame, key: str, frame: str, vector: str,
                   k: int | None = None) -> DataFrame:
    """Frames of a key in name order with the weight at their position.

    A weight vector whose length differs from the number of frames, or that is
    missing, is replaced by equal weights.  All frames are kept; ``k`` is for a later cut to
    the first ones, of which then only those are ranked and shuffled, while the full count
    still decides about the fallback.
    """
    counts = frames.groupBy(key).agg(F.count("*").alias("_n"))
    facts = counts.join(weights.select(key, F.col(vector).alias("_w")), key, "left")
    if k is None:
        rows = ranked(frames, [key], [frame], "_rank")
    else:
        over = W.partitionBy(key).orderBy(frame)
        rows = (frames.withColumn("_rank", F.row_number().over(over))
                .filter(F.col("_rank") <= k))
    fits = F.coalesce(F.size("_w") == F.col("_n"), F.lit(False))
    alpha = (F.when(fits, F.get(F.col("_w"), (F.col("_rank") - 1).cast("int")).cast("double"))
             .otherwise(F.lit(1.0) / F.greatest(F.col("_n"), F.lit(1))))
    met = join_summary(rows, facts, [key], "inner") if k is None else rows.join(facts, key)
    return (met
            .withColumn("pos", (F.col("_rank") - 1).cast("int")).withColumn("alpha", alpha)
            .drop("_rank", "_n", "_w"))


def zip_weights(frames: Column | str, weights: Column | str) -> Column:
    """Array form for rows that already hold their frame names:
    array<struct<frame, alpha>> with equal weights on a length mismatch."""
    f, w = (F.col(c) if isinstance(c, str) else c for c in (frames, weights))
    names = F.array_sort(f)
    fits = F.coalesce(F.size(w) == F.size(f), F.lit(False))
    alpha = F.when(fits, w.cast("array<double>")).otherwise(uniform(F.size(f)))
    return F.zip_with(names, alpha, lambda n, a: F.struct(n.alias("frame"), a.alias("alpha")))


def first_frames(items: Column | str, k: int = SLOTS) -> Column:
    """First ``k`` entries of a frame list in name order."""
    c = F.col(items) if isinstance(items, str) else items
    return F.slice(F.array_sort(c), 1, k)
