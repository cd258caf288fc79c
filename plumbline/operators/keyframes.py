"""Keyframe selection on timed frame scores, and gates on given pairs."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import as_col
from ..functions.vectors import SLOTS, cosine
from ..session import join_dealt, stored
from .order import top_per_group

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Published thresholds.
MOTION_PERCENTILE = 0.8
MOTION_WINDOW_US = 500_000
MIN_CONFIDENCE = 0.7
TEMPERATURE = 5.0
SAME_IDENTITY = 0.75
OTHER_IDENTITY = 0.40
DURATION_SLACK = 0.2

#: Distinct (time, score) entries that a tile of the motion gate takes before the next begins.
TILE_ROWS = 100_000


def motion_gate(df: DataFrame, clip: str, ts_us: str, motion: str,
                window_us: int = MOTION_WINDOW_US, pct: float = MOTION_PERCENTILE,
                tile_us: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Rows whose motion reaches the percentile of the rows within +-window/2 of them.

    The threshold depends on clip and time alone, so only distinct (clip, time, score) with
    their counts go through Python; rows stay on the JVM side and meet their threshold in a
    join that spreads hot keys.  Time is cut into slots of half a window.  Slots are counted,
    and consecutive ones form a tile of about ``tile_rows`` entries, within spans of ``tile_us``;
    a tile also gets the slots next to it.  So a clip of any length or density spreads over
    tiles, and a tile holds its entries and three slots more at most.
    """
    half = max(window_us // 2, 1)
    span = max(1, (tile_us or 64 * window_us) // half)
    at, score = F.col(ts_us).cast("bigint"), F.col(motion).cast("double")
    slot = ((F.col("_at") - F.pmod(F.col("_at"), F.lit(half))) / F.lit(half)).cast("bigint")
    entries = stored(df.select(F.col(clip).alias("_clip"), at.alias("_at"), score.alias("_m")).filter("_at IS NOT NULL")
                     .groupBy("_clip", "_at", "_m").agg(F.count("*").alias("_n")).withColumn("_slot", slot))
    sizes = entries.groupBy("_clip", "_slot").agg(F.count("*").alias("_c")).withColumn(
        "_span", F.floor(F.col("_slot") / span))
    before = F.coalesce(F.sum("_c").over(W.partitionBy("_clip", "_span").orderBy("_slot").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0))
    tiles = stored(sizes.select("_clip", "_slot", F.struct("_span", F.floor(before / tile_rows).alias("part")).alias("_tile")))
    near = tiles.select("_clip", F.explode(F.array(*[F.col("_slot") + i for i in (-1, 0, 1)])).alias("_slot"), "_tile",
                        F.col("_slot").alias("_from"))
    # Up to three tiles want a slot: its own and those next to it.
    wanted = near.groupBy("_clip", "_slot").agg(
        F.collect_set("_tile").alias("_tiles"), F.max(F.when(F.col("_from") == F.col("_slot"), F.col("_tile"))).alias("_own"))
    copies = join_dealt(entries, wanted.filter("_own IS NOT NULL"), ["_clip", "_slot"]).select(
        "*", F.explode("_tiles").alias("_tile")).select("_clip", "_tile", "_at", "_m", "_n",
                                                       (F.col("_tile") == F.col("_own")).alias("_mine"))

    def limits(tile: pa.Table) -> pa.Table:
        at, count, mine = (tile.column(c).to_numpy() for c in ("_at", "_n", "_mine"))
        limit = sliding_percentile(at, tile.column("_m").to_numpy(zero_copy_only=False), half, pct, count)
        mine = np.flatnonzero(mine)
        first = mine[np.unique(at[mine], return_index=True)[1]]
        return pa.table([tile.column("_clip").take(first), pa.array(at[first]), pa.array(limit[first], pa.float64())],
                        names=["_clip", "_at", "threshold"])

    kind = df.schema[clip].dataType.simpleString()
    found = copies.groupBy("_clip", "_tile").applyInArrow(limits, f"_clip {kind}, _at bigint, threshold double")
    keyed = df.withColumn("_clip", F.col(clip)).withColumn("_at", at)
    met = join_dealt(keyed, found.filter(~F.isnan("threshold")), ["_clip", "_at"])
    return met.filter((score >= F.col("threshold")) & ~F.isnan(score)).select(*df.columns, "threshold")


def sliding_percentile(at: np.ndarray, score: np.ndarray, half: int, pct: float,
                       count: np.ndarray | None = None) -> np.ndarray:
    """The interpolated percentile of the scores within ``half`` of each entry's time, each
    counted ``count`` times; NaN where there are none.  Entries enter and leave a tree of
    counts over the ranks of the scores, in which places are found by descent."""
    order = np.argsort(at, kind="stable")
    times = at[order].tolist()
    levels, ranks = np.unique(score[order], return_inverse=True)
    fine = (score[order] == score[order]).tolist()
    counts = (np.ones(len(at), np.int64) if count is None else count[order]).tolist()
    ranks, values = ranks.tolist(), levels.tolist()
    top = 1 << max(0, len(values) - 1).bit_length()
    tree = [0] * (top + 1)

    def add(rank: int, n: int) -> None:
        rank += 1
        while rank <= top:
            tree[rank] += n
            rank += rank & -rank

    def value_at(place: int) -> float:
        """The score at a place (from 0) of the sorted window."""
        rank, step = 0, top
        while step:
            if rank + step <= top and tree[rank + step] <= place:
                rank += step
                place -= tree[rank]
            step >>= 1
        return values[rank]

    first = last = held = 0
    out = np.full(len(times), np.nan)
    before, limit = None, float("nan")
    for place, now in zip(order.tolist(), times, strict=True):
        if now != before:
            while last < len(times) and times[last] <= now + half:
                if fine[last]:
                    add(ranks[last], counts[last])
                    held += counts[last]
                last += 1
            while times[first] < now - half:
                if fine[first]:
                    add(ranks[first], -counts[first])
                    held -= counts[first]
                first += 1
            before, limit = now, float("nan")
            if held:
                spot = (held - 1) * pct
                low = int(spot)
                a, b = value_at(low), value_at(min(low + 1, held - 1))
                limit = a + (spot - low) * (b - a)
        out[place] = limit
    return out


def top_confident(df: DataFrame, clip: str, confidence: str, tie: str,
                  minimum: float = MIN_CONFIDENCE, k: int = SLOTS) -> DataFrame:
    """The ``k`` most confident rows per clip among those at or above ``minimum``."""
    sure = df.filter(F.col(confidence) >= F.lit(minimum))
    return top_per_group(sure, [clip], [F.desc(confidence), F.asc(tie)], k)


def temperature_weights(df: DataFrame, clip: str, confidence: str,
                        beta: float = TEMPERATURE, out: str = "alpha") -> DataFrame:
    """``exp(beta*c)`` scaled to sum 1 per clip.

    Meant for the few rows per clip that :func:`top_confident` keeps.
    """
    e = F.exp(F.lit(beta) * F.col(confidence))
    return df.withColumn(out, e / F.sum(e).over(W.partitionBy(clip)))


def nearest_index(frame: Column | str, fps: float, audio_rate: float) -> Column:
    """Audio index closest to a frame position."""
    return F.round(as_col(frame) * F.lit(audio_rate) / F.lit(fps)).cast("bigint")


def align(frames: DataFrame, audio: DataFrame, clip: str, frame_pos: str, audio_pos: str,
          fps: float, audio_rate: float) -> DataFrame:
    """Join frames to the audio step nearest in time."""
    at = frames.withColumn(audio_pos, nearest_index(frame_pos, fps, audio_rate))
    return at.join(audio, [clip, audio_pos], "inner")


def same_identity(df: DataFrame, a: str, b: str, minimum: float = SAME_IDENTITY) -> DataFrame:
    """Rows whose two voice vectors agree."""
    return df.withColumn("similarity", cosine(a, b)).filter(F.col("similarity") >= F.lit(minimum))


def check_pairs(pairs: DataFrame, clips: DataFrame, video: str = "video_id",
                audio: str = "audio_id", clip: str = "clip_id",
                min_own: float = SAME_IDENTITY, max_other: float = OTHER_IDENTITY,
                slack: float = DURATION_SLACK) -> DataFrame:
    """Judge listed (video, audio) pairs against the splice constraints.

    ``clips`` holds ``speaker, emotion, voice, reference, duration`` per clip.  Both
    sides are looked up by id; no pairs are generated.
    """
    def side(prefix: str, key: str) -> DataFrame:
        return clips.select(F.col(clip).alias(key), *[
            F.col(c).alias(f"{prefix}_{c}") for c in ("speaker", "emotion", "voice", "reference", "duration")])

    both = pairs.join(side("v", video), video, "left").join(side("a", audio), audio, "left")
    own, other = cosine("a_voice", "a_reference"), cosine("a_voice", "v_reference")
    ok = ((F.col("v_speaker") != F.col("a_speaker")) & (F.col("v_emotion") != F.col("a_emotion"))
          & (own >= F.lit(min_own)) & (other <= F.lit(max_other))
          & (F.abs(F.col("v_duration") - F.col("a_duration")) <= F.lit(slack)))
    return (both.withColumn("own_similarity", own).withColumn("other_similarity", other)
            .withColumn("ok", F.coalesce(ok, F.lit(False)))
            .select(*pairs.columns, "own_similarity", "other_similarity", "ok"))
