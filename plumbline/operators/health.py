"""Value counts, class profiles, file issues and the gates built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import as_col
from ..functions.vectors import std_pop, total
from .order import top_per_group
from .resolve import FILES, usable_flags

# Fixed value: expected number of spectrogram bands.
BANDS = 80


def value_counts(df: DataFrame, col: Column | str, default: str = "?",
                 out: str = "value") -> DataFrame:
    """Rows per value; rows without one count under ``default``."""
    value = F.coalesce(as_col(col).cast("string"), F.lit(default))
    return df.groupBy(value.alias(out)).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, col: Column | str, out: str = "value") -> DataFrame:
    return df.groupBy(as_col(col).alias(out)).agg(F.count("*").alias("n"))


def balance_report(df: DataFrame, part: str = "part", label: str = "label") -> DataFrame:
    """Genuine (0) and forged (1) rows per part."""
    return df.groupBy(part).agg(F.count_if(F.col(label) == 0).alias("n_genuine"),
                                F.count_if(F.col(label) == 1).alias("n_fake"))


def mix_report(df: DataFrame, part: str = "part", kind: str = "ptype") -> DataFrame:
    return df.groupBy(part, kind).agg(F.count("*").alias("n"))


def group_counts(df: DataFrame, by: Sequence[str], group: Column | str) -> DataFrame:
    """Distinct groups per source."""
    pairs = df.select(*by, as_col(group).alias("_g")).distinct()
    return pairs.groupBy(*by).agg(F.count("_g").alias("n_groups"))


def class_profile(df: DataFrame, label: str, value: Column | str,
                  cap: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, min and max per class, over all rows unless capped."""
    rows = df.select(label, as_col(value).cast("double").alias("_v"), *order)
    if cap is not None:
        rows = top_per_group(rows, [label], order, cap)
    return rows.groupBy(label).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"),
        F.min("_v").alias("min"), F.max("_v").alias("max"))


def array_profile(df: DataFrame, label: str, arr: Column | str) -> DataFrame:
    """Per class, the mean of each row's own deviation and maximum (rows with sum > 0)."""
    a = as_col(arr).cast("array<double>")
    rows = df.filter(total(a) > 0).select(
        label, std_pop(a).alias("_s"), F.array_max(a).alias("_m"))
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.avg("_s").alias("mean_std"),
                                   F.avg("_m").alias("mean_max"))


# -- file issues ----------------------------------------------------------------

def _issue(when: Column, modality: str, text: Column) -> Column:
    return F.when(when, F.struct(F.lit(modality).alias("modality"), text.alias("issue")))


def _value_issue(probe: Column) -> Column:
    return F.when(probe["has_nan"], F.lit("NaN")).when(probe["has_inf"], F.lit("Inf"))


def _load_error(probe: Column) -> Column:
    return F.concat(F.lit("load_error:"), probe["err"])


def _shape_text(probe: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(probe["shape"].cast("array<string>"), ", "), F.lit(")"))


def health_rows(checked: DataFrame) -> DataFrame:
    """One row per (source, base, file id) with the probe of the preferred file per kind.

    ``checked`` is an asset listing with a ``probe`` column; files that need no
    probe (frames, JSON weights) hold NULL there.
    """
    best = []
    for k in (*FILES, "weights"):
        hit = F.col("kind") == k
        best += [F.min_by(F.when(hit, F.col("probe")), F.when(hit, F.col("variant"))).alias(f"{k}_probe"),
                 F.min(F.when(hit, F.col("variant"))).alias(f"{k}_variant")]
    rows = checked.groupBy("source", "base", "base_rank", "file_id").agg(
        *best, F.count_if(F.col("kind") == "frame").alias("n_frames"),
        F.max(F.col("kind").isin("frame", "weights", "other")).alias("has_visual_dir"))
    for k in FILES:
        rows = rows.withColumn(f"{k}_failed", F.col(f"{k}_probe.err").isNotNull())
    return rows.select("*", *usable_flags())


def _row_issues() -> Column:
    audio, ids = F.col("audio_probe"), F.col("input_ids_probe")
    mask, weights = F.col("attention_mask_probe"), F.col("weights_probe")
    has_audio_file = F.col("audio_variant").isNotNull()
    has_text_files = F.col("input_ids_variant").isNotNull() & F.col("attention_mask_variant").isNotNull()
    ids_ok, mask_ok = ids["err"].isNull(), mask["err"].isNull()
    text_ok = has_text_files & ids_ok & mask_ok
    band_count = F.get(audio["shape"], F.lit(0))
    visual = F.col("has_visual_dir")
    weights_file = F.col("weights_variant")
    found = [
        _issue(has_audio_file & audio["err"].isNotNull(), "audio", _load_error(audio)),
        _issue(has_audio_file & (band_count != BANDS), "audio",
               F.concat(F.lit("mel_bands="), band_count.cast("string"))),
        _issue(has_audio_file & _value_issue(audio).isNotNull(), "audio", _value_issue(audio)),
        _issue(has_text_files & ~ids_ok, "text:input_ids", _load_error(ids)),
        _issue(has_text_files & ids_ok & ~mask_ok, "text:attention_mask", _load_error(mask)),
        _issue(text_ok & (ids["shape"] != mask["shape"]), "text",
               F.concat(F.lit("shape mismatch "), _shape_text(ids), F.lit(" vs "), _shape_text(mask))),
        _issue(text_ok & _value_issue(ids).isNotNull(), "text:input_ids", _value_issue(ids)),
        _issue(text_ok & _value_issue(mask).isNotNull(), "text:attention_mask", _value_issue(mask)),
        _issue(visual & (F.col("n_frames") == 0), "visual", F.lit("no frames")),
        _issue(visual & weights_file.isNull(), "visual", F.lit("no weights file")),
        _issue(visual & weights_file.isNotNull() & weights["err"].isNotNull(), "visual:weights",
               _load_error(weights)),
        _issue(visual & weights_file.isNotNull() & _value_issue(weights).isNotNull(),
               "visual:weights", _value_issue(weights)),
    ]
    return F.filter(F.array(*found), lambda i: i.isNotNull())


def _visited(health: DataFrame) -> DataFrame:
    """The bases that a reader would open: up to the first that holds any usable modality,
    whose rank is ``_stop`` (NULL if there is none)."""
    usable = F.col("has_audio") | F.col("has_text") | F.col("has_visual")
    # One row per base and id from here on: the window sees a handful of rows.
    stop = F.min(F.when(usable, F.col("base_rank"))).over(W.partitionBy("source", "file_id"))
    return (health.withColumn("_stop", stop)
            .filter(F.col("_stop").isNull() | (F.col("base_rank") <= F.col("_stop"))))


def issues(manifest: DataFrame, health: DataFrame) -> DataFrame:
    """(source, file_id, base, modality, issue) for the bases a reader would open.

    A reader stops at the first base that holds any usable modality, so later bases
    are not reported.
    """
    read = (_visited(health).withColumn("_i", F.explode(_row_issues()))
            .select("source", "file_id", "base", "_i.modality", "_i.issue"))
    return manifest.select("source", "file_id").join(read, ["source", "file_id"])


def judged_rows(manifest: DataFrame, health: DataFrame) -> DataFrame:
    """Every manifest row with what a reader finds, one row per opened base, or one without.

    Added are base, status (full, partial or absent; on one row of a file, else NULL), bands,
    tokens and frames (sizes of what loaded, NULL where nothing did) and issues.
    """
    rows = _visited(health)
    audio, ids, mask = F.col("audio_probe"), F.col("input_ids_probe"), F.col("attention_mask_probe")
    has_audio = F.col("audio_variant").isNotNull() & audio["err"].isNull()
    has_text = (F.col("input_ids_variant").isNotNull() & F.col("attention_mask_variant").isNotNull()
                & ids["err"].isNull() & mask["err"].isNull())
    first = F.min("base_rank").over(W.partitionBy("source", "file_id"))
    whole = F.col("has_audio") & F.col("has_text") & F.col("has_visual")
    status = F.when(F.col("base_rank") == F.coalesce("_stop", first), F.when(
        F.col("_stop").isNull(), "absent").when(whole, "full").otherwise("partial"))
    found = rows.select(
        "source", "file_id", "base", status.alias("status"), F.when(has_audio, F.get(audio["shape"], F.lit(0))).alias("bands"),
        F.when(has_text, F.try_element_at(ids["shape"], F.lit(-1))).alias("tokens"),
        F.when(F.col("has_visual_dir"), F.col("n_frames")).cast("int").alias("frames"), _row_issues().alias("issues"))
    joined = manifest.select("source", "file_id").join(found, ["source", "file_id"], "left")
    return joined.withColumn("status", F.when(F.col("base").isNull(), "absent").otherwise(F.col("status")))


def issue_summary(found: DataFrame) -> DataFrame:
    """Issue kinds with their counts, most common first."""
    return (found.groupBy("issue").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.asc("issue")))


def issue_examples(found: DataFrame, n: int = 8) -> DataFrame:
    return found.orderBy("source", "file_id", "modality", "issue").limit(n)


def assert_healthy(found: DataFrame) -> None:
    """Raise when there is any issue."""
    n = found.count()
    if n:
        raise ValueError(f"{n} integrity problems")


def assert_constant(df: DataFrame, value: Column | str) -> None:
    """Raise unless the expression has a single value over all rows."""
    low, high, empty = df.agg(F.min(as_col(value)), F.max(as_col(value)),
                              F.count_if(as_col(value).isNull())).first()
    if low != high or (empty and low is not None):
        raise ValueError(f"not constant: {low!r} to {high!r}, {empty} without value")
