"""Splice pairs: every video gets an admissible audio, no audio is used too often.

The pairs that pass all gates grow with the square of the clips, so they are never listed.
Videos take turns in a seeded order; each takes the first audio that passes the gates and
has room, going round a ring of all audios in seeded order from the video's own place.  The
result is maximal: a video is left out only if every audio that it may have is used up.

Turns are not played one by one.  Every video proposes to its first audio, every audio keeps
the best proposals it has had so far, and who is turned down goes on round the ring.  As all
audios rank videos alike, that ends in the same pairs as the turns.  A round is a join of
unsettled videos with the arc of the ring that they stand on, within their duration bucket
and the two beside it; arcs have a bounded number of audios.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles
from ..session import is_small, join_summary, stored
from .keyframes import DURATION_SLACK, OTHER_IDENTITY, SAME_IDENTITY

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The ring has this many places.
BITS = 40
RING = 1 << BITS

#: Audios of an arc in the first round, and at most; arcs double from round to round.
ARC, LONGEST_ARC = 256, 1 << 14

#: Videos that meet an arc in one task.
MEET = 4096


def place_of(ident: Column, seed: int) -> Column:
    """A place on the ring, from 0 up to ``RING``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", ident.cast("string"), F.lit(str(seed)))), 1, BITS // 4), 16, 10).cast("bigint")


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows of a with all rows of b; NaN where a vector has no length."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :])


def _sides(clips: DataFrame, clip: str, min_own: float, width: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Videos and audios that can be in a pair at all, with their bucket and ring place."""
    bucket = F.floor(F.col("duration").cast("double") / F.lit(width)).cast("bigint")
    known = clips.filter("speaker IS NOT NULL AND emotion IS NOT NULL AND duration IS NOT NULL").select(
        F.col(clip).cast("bigint").alias("id"), F.col("speaker").cast("string").alias("speaker"),
        F.col("emotion").cast("string").alias("emotion"), F.col("duration").cast("double").alias("duration"),
        doubles("voice").alias("voice"), doubles("reference").alias("reference"),
        bucket.alias("bucket"), place_of(F.col(clip), seed + 1).alias("place")).filter("id IS NOT NULL")
    videos = known.filter("reference IS NOT NULL").select(
        "id", "speaker", "emotion", "duration", F.col("reference").alias("vector"), "bucket", "place", place_of(F.col("id"), seed).alias("turn"))
    audios = known.withColumn("own", cosine("voice", "reference")).filter(F.col("own") >= F.lit(min_own)).select(
        "id", "speaker", "emotion", "duration", F.col("voice").alias("vector"), "bucket", "place", "own")
    return videos, audios


def _in_halo(audios: DataFrame) -> DataFrame:
    """Audios in their own bucket and the two beside it."""
    return audios.withColumn("bucket", F.explode(F.array(*[F.col("bucket") + i for i in (-1, 0, 1)])))


def _proposals(going: DataFrame, videos: DataFrame, audios: DataFrame, n_audios: DataFrame, arc: int, meet: int,
               max_other: float, slack: float) -> DataFrame:
    """For every unsettled video its next proposal, or where on the ring it goes on.

    ``going`` have lap, at and after: the place, and the audio there, up to which they have
    been; ``audios`` the turn and id of the worst proposal that they keep, if they are full.
    ``n_audios`` counts all audios by bucket of their halo.  Of ``audios``, only those in arcs
    where an unsettled video stands are sent to it.
    """
    n_videos = going.groupBy("bucket").agg(F.count("*").alias("nv"))
    # One row per duration bucket that has both.
    plan = n_audios.join(n_videos, "bucket").select(
        "bucket", F.ceil(F.col("na") / arc).alias("arcs"),
        F.ceil(F.col("nv") / F.ceil(F.col("na") / arc) / meet).alias("ways"))
    plan = stored(plan)
    small = is_small(plan)
    on = F.shiftright(F.col("spot") * F.col("arcs"), BITS)
    keys = ["bucket", "arc", "way"]
    # Columns get names of their own, as both sides come from the same plan.
    keyed = join_summary(going.withColumn("spot", F.col("at")), plan, ["bucket"], "inner", small).select(
        F.col("bucket").alias("vb"), on.alias("va"), F.pmod(F.xxhash64("id"), F.col("ways")).alias("vw"),
        F.col("arcs").alias("va_all"), *[F.col(c) for c in going.columns if c != "bucket"]).toDF(
            *keys, "arcs", *[c for c in going.columns if c != "bucket"])
    left = keyed.join(videos.select("id", "speaker", "emotion", "duration", "vector"), "id")
    right = join_summary(_in_halo(audios).withColumn("spot", F.col("place")), plan, ["bucket"], "inner", small).select(
        F.col("bucket").alias("ab"), on.alias("aa"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ways") - 1)).alias("aw"),
        *[F.col(c) for c in audios.columns if c != "bucket"]).toDF(*keys, *[c for c in audios.columns if c != "bucket"])
    met = keyed.select(*keys).distinct().toDF("mb", "ma", "mw")
    right = right.join(met, (F.col("bucket") == F.col("mb")) & (F.col("arc") == F.col("ma")) & (F.col("way") == F.col("mw")), "left_semi")

    def meet_arc(key: tuple, v: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"id": v["id"], "audio": pd.array([None] * len(v), "Int64"),
                            "other": np.nan, "lap": v["lap"], "at": v["at"], "after": v["after"],
                            "place": v["place"], "turn": v["turn"], "bucket": key[0]})
        if not len(v):
            return out
        # Where the next arc begins; behind the last one the next lap does.
        arcs, here = int(v["arcs"].iloc[0]), int(key[1])
        border = -(-RING * (here + 1) // arcs)
        out["at"] = border if here + 1 < arcs else 0
        out["lap"] = v["lap"] + (0 if here + 1 < arcs else 1)
        out["after"] = -(1 << 62)
        if not len(a):
            return out
        a = a.sort_values(["place", "id"], ignore_index=True)
        place, ident = a["place"].to_numpy(), a["id"].to_numpy()
        at, after, lap, home = (v[c].to_numpy() for c in ("at", "after", "lap", "place"))
        other = _similarity(np.stack(v["vector"]), np.stack(a["vector"]))
        fits = ((other <= max_other) & (v["speaker"].to_numpy()[:, None] != a["speaker"].to_numpy()[None, :])
                & (v["emotion"].to_numpy()[:, None] != a["emotion"].to_numpy()[None, :])
                & (np.abs(v["duration"].to_numpy()[:, None] - a["duration"].to_numpy()[None, :]) <= slack))
        fits &= (place[None, :] > at[:, None]) | ((place[None, :] == at[:, None]) & (ident[None, :] > after[:, None]))
        fits &= (lap[:, None] == 0) | (place[None, :] < home[:, None])
        # A full audio takes a video only in place of a worse one.
        turn, number = v["turn"].to_numpy(), v["id"].to_numpy()
        full, worst, last = a["full"].to_numpy().astype(bool), a["worst_turn"].to_numpy(), a["worst_id"].to_numpy()
        fits &= ~full[None, :] | (turn[:, None] < worst[None, :]) | (
            (turn[:, None] == worst[None, :]) & (number[:, None] < last[None, :]))
        hit, first = fits.any(axis=1), fits.argmax(axis=1)
        rows = np.flatnonzero(hit)
        out.loc[out.index[rows], "audio"] = ident[first[rows]]
        out.loc[out.index[rows], "other"] = other[rows, first[rows]]
        out.loc[out.index[rows], "lap"] = lap[rows]
        out.loc[out.index[rows], "at"] = place[first[rows]]
        out.loc[out.index[rows], "after"] = ident[first[rows]]
        return out

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        meet_arc, "id long, audio long, other double, lap int, at long, after long, place long, turn long, bucket long")


def match_clips(clips: DataFrame, clip: str = "clip_id", quota: int = 1, min_own: float = SAME_IDENTITY,
                max_other: float = OTHER_IDENTITY, slack: float = DURATION_SLACK, seed: int = 42,
                arc: int = ARC, meet: int = MEET) -> DataFrame:
    """(video_id, audio_id, own_similarity, other_similarity): a maximal set of splice pairs.

    ``clips`` holds ``speaker, emotion, voice, reference, duration`` per clip, whose ids are
    different whole numbers.  A pair has different speakers and emotions, an audio that is like its own
    reference, unlike the video's, and durations within ``slack`` seconds.  Every clip is the
    video of one pair at most and the audio of ``quota`` at most.  Which pairs, depends on
    ids and seed only.  A clip with a null in what a gate looks at passes no gate.
    """
    videos, audios = _sides(clips, clip, min_own, slack * 1.001, seed)
    videos, audios = stored(videos), stored(audios)
    n_audios = stored(_in_halo(audios).groupBy("bucket").agg(F.count("*").alias("na")))
    # A video starts in front of the audios at its own place.  What is asked of it in each
    # round goes with it, so that only those that still go are joined with their vectors.
    own = ["id", "place", "turn", "bucket"]
    going = stored(videos.select(*own, F.lit(0).alias("lap"), F.col("place").alias("at"),
                                 F.lit(-(1 << 62)).cast("long").alias("after")))
    held = None
    rank = F.struct("turn", "id")
    while (least := going.agg(F.min(rank).alias("least")).first().least) is not None:
        worst = None
        if held is not None:
            worst = held.groupBy(F.col("audio").alias("id")).agg(
                F.count("*").alias("n"), F.max(rank).alias("worst")).filter(F.col("n") >= quota)
        free = audios.drop("own")
        if worst is None:
            free = free.select("*", F.lit(False).alias("full"), F.lit(0).cast("long").alias("worst_turn"),
                               F.lit(0).cast("long").alias("worst_id"))
        else:
            free = free.join(worst, "id", "left").select(
                *free.columns, F.col("n").isNotNull().alias("full"),
                F.coalesce("worst.turn", F.lit(0)).alias("worst_turn"), F.coalesce("worst.id", F.lit(0)).alias("worst_id"))
            # Audios that keep better videos than any that is still on its way are closed.
            best = F.struct(F.lit(least.turn).cast("long").alias("turn"), F.lit(least.id).cast("long").alias("id"))
            free = free.filter(~F.col("full") | (F.struct("worst_turn", "worst_id") > best))
        moved = stored(_proposals(going, videos, free, n_audios, arc, meet, max_other, slack))
        made = moved.filter("audio IS NOT NULL")
        every = made if held is None else held.unionByName(made)
        over = W.partitionBy("audio").orderBy("turn", "id")
        judged = stored(every.withColumn("_turn", F.row_number().over(over)))
        held = judged.filter(F.col("_turn") <= quota).drop("_turn")
        refused = judged.filter(F.col("_turn") > quota).select(*own, "lap", "at", "after")
        passed = moved.filter("audio IS NULL").select(*own, "lap", "at", "after")
        # Once round the ring, a video has met all audios that it could have.
        left = refused.unionByName(passed).filter((F.col("lap") == 0) | ((F.col("lap") == 1) & (F.col("at") < F.col("place"))))
        going = stored(left)
        arc = min(2 * arc, max(LONGEST_ARC, arc))
    if held is None:
        return clips.sparkSession.createDataFrame(
            [], "video_id long, audio_id long, own_similarity double, other_similarity double")
    return held.join(audios.select(F.col("id").alias("audio"), "own"), "audio").select(
        F.col("id").alias("video_id"), F.col("audio").alias("audio_id"), F.col("own").alias("own_similarity"),
        F.col("other").alias("other_similarity"))
