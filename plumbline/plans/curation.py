"""Composed flows: labelled single-stage samples, genuine / forged pairs, held-out
evaluation, health check and leakage audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import as_col, donor_group, pair_type_from_id, source_group
from ..functions.vectors import std_pop, total
from ..operators.binary import one_vs_reference
from ..operators.dedup import dedup_first
from ..operators.filters import keep_forged, keep_genuine
from ..operators.health import health_rows, issues, judged_rows
from ..operators.leakage import in_all, marks, mask_counts
from ..operators.resolve import complete_samples
from ..operators.splits import split_by_group
from ..session import stored
from ..sources.arrays import probe_arrays, probe_files

KIND = "forgery_type"


def labelled_samples(manifest: DataFrame, order: Sequence[Column | str], label: Column,
                     assets: DataFrame | None = None, genuine_only: bool = True,
                     kind: str = KIND) -> DataFrame:
    """Single-stage samples: keep-first per (source, id), *then* the genuine filter, then
    the label (rows without one drop out), then the complete asset set."""
    first = dedup_first(manifest, ["source", "file_id"], order)
    kept = keep_genuine(first, kind) if genuine_only else first
    out = kept.withColumn("emotion", label).filter(F.col("emotion").isNotNull())
    out = out.withColumn("group_key", source_group("file_id"))
    return complete_samples(out, assets) if assets is not None else out


def pair_samples(genuine: DataFrame, forged: DataFrame, order: Sequence[Column | str],
                 assets: DataFrame | None = None, kind: str = KIND) -> DataFrame:
    """Pair samples: filter, *then* keep-first, label 0 / 1, complete asset sets."""
    def part(df: DataFrame, keep: Callable[[DataFrame, str], DataFrame], label: int) -> DataFrame:
        first = dedup_first(keep(df, kind), ["source", "file_id"], order)
        return first.withColumn("label", F.lit(label))

    both = part(genuine, keep_genuine, 0).unionByName(
        part(forged, keep_forged, 1), allowMissingColumns=True)
    both = both.withColumn("group_key", source_group("file_id")).withColumn(
        "donor_key", donor_group("file_id"))
    return complete_samples(both, assets) if assets is not None else both


def heldout_evaluation(scores: DataFrame, group: str, dataset: str, kind: str, y: str, p: str,
                       part: str = "test", reference: str | None = None) -> DataFrame:
    """Subgroup table on the held-out groups only."""
    held = split_by_group(scores, group).filter(F.col("part") == part)
    return (one_vs_reference(held, dataset, kind, y, p, reference) if reference
            else one_vs_reference(held, dataset, kind, y, p))


def probed(listing: DataFrame) -> DataFrame:
    """An asset listing with a probe of every array file; frames and JSON weights are listed,
    not decoded.  Contents are taken from the listing; without any, the files are opened in
    the tasks, and what was read goes no further."""
    is_array = F.col("path").endswith(".npy") & (F.col("kind") != "other")
    if "content" not in listing.columns:
        return probe_files(listing, is_array)
    arrays = probe_arrays(listing.filter(is_array)).drop("content")
    kind = arrays.schema["probe"].dataType
    rest = (listing.filter(~is_array).drop("content")
            .withColumn("probe", F.lit(None).cast(kind)))
    return arrays.unionByName(rest)


def health_check(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Issues of a source from an asset listing, with or without file contents."""
    return issues(manifest, health_rows(probed(listing)))


@dataclass(frozen=True)
class HealthReport:
    """``rows``: (source, section, rank, name, n).  Sections are mel_bands, text_length and
    frame_count (histograms), issue (ranking), example, and total (files by status, and
    problems).  ``totals`` has the numbers of the last section by (source, name)."""

    rows: DataFrame
    totals: dict[tuple[str, str], int]

    def problems(self) -> int:
        return sum(n for (_, name), n in self.totals.items() if name == "problems")

    def require_healthy(self) -> None:
        """Raise when there is any problem; no job is run for it."""
        if self.problems():
            raise ValueError(f"{self.problems()} integrity problems")


def health_report(manifest: DataFrame, listing: DataFrame, sources: Sequence[str], target: str,
                  lengths: int = 5, examples: int = 8) -> HealthReport:
    """Check every file of the registered ``sources`` once and report per source.

    The judged rows are written to ``target``, and the pass that writes them also observes
    the totals, so neither these nor a gate on them read anything again.  Histograms,
    rankings and examples come from the narrow written table: counts combine on the map
    side, and what is ranked is cut to the first rows of each source before the shuffle.
    Text lengths are the ``lengths`` most common ones, examples the first ``examples``.
    """
    spark = manifest.sparkSession
    names = ("full", "partial", "absent", "problems")
    one = [(s, n) for s in sources for n in names]

    def number(source: str, name: str) -> Column:
        mine = F.col("source") == source
        value = (F.coalesce(F.size("issues"), F.lit(0)) if name == "problems"
                 else F.coalesce((F.col("status") == name).cast("int"), F.lit(0)))
        return F.coalesce(F.sum(F.when(mine, F.greatest(value, F.lit(0)))), F.lit(0))

    seen = Observation()
    judged = judged_rows(manifest, health_rows(probed(listing)))
    judged.observe(seen, *[number(s, n).alias(f"m{i}") for i, (s, n) in enumerate(one)]).write.parquet(target)
    totals = {key: int(seen.get[f"m{i}"]) for i, key in enumerate(one)}
    found = spark.read.schema(judged.schema).parquet(target)

    sizes = [F.struct(F.lit(section).alias("section"), F.col(c).cast("string").alias("name"))
             for section, c in (("mel_bands", "bands"), ("text_length", "tokens"), ("frame_count", "frames"))]
    texts = F.transform(F.coalesce("issues", F.array().cast(judged.schema["issues"].dataType)), lambda i: F.struct(
        F.lit("issue").alias("section"), i["issue"].alias("name")))
    counted = (found.select("source", F.explode(F.concat(F.array(*sizes), texts)).alias("f")).select("source", "f.*")
               .filter("name IS NOT NULL").groupBy("source", "section", "name").agg(F.count("*").alias("n")))
    common = W.partitionBy("source", "section").orderBy(F.desc("n"), "name")
    ranked = counted.withColumn("rank", F.row_number().over(common)).filter(
        (F.col("section") != "text_length") | (F.col("rank") <= lengths))
    example = found.select("source", "file_id", F.inline("issues"))
    order = W.partitionBy("source").orderBy("file_id", "modality", "issue")
    shown = example.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= examples).select(
        "source", F.lit("example").alias("section"),
        F.concat("file_id", F.lit(" ["), "modality", F.lit("] "), "issue").alias("name"), F.lit(1).cast("long").alias("n"), "rank")
    total = spark.createDataFrame([(s, "total", n, totals[s, n], names.index(n) + 1) for s, n in one],
                                  "source string, section string, name string, n long, rank int")
    rows = ranked.unionByName(shown).unionByName(total).select("source", "section", "rank", "name", "n")
    return HealthReport(rows, totals)


# Sets that a key can belong to, one bit each.
_FORGED, _GENUINE, _DONOR, _TRAIN, _VAL, _TEST, _TEST_DONOR, _SEEN = (1 << i for i in range(8))
_PARTS = {"train": _TRAIN, "val": _VAL, "test": _TEST}


def _fact(check: str, subject: Column, value: Column, limit: float | None = None, given: Column | None = None) -> Column:
    """A row of the report, or NULL where it is not given."""
    v = value.cast("double")
    row = F.struct(
        F.lit(check).alias("check"), subject.cast("string").alias("subject"), v.alias("value"),
        F.lit(limit).cast("double").alias("limit"),
        (F.lit(True) if limit is None else v <= F.lit(float(limit))).alias("ok"))
    return row if given is None else F.when(given, row)


def _facts(df: DataFrame, facts: Sequence[Column]) -> DataFrame:
    return df.select(F.inline(F.filter(F.array(*facts), lambda r: r.isNotNull())))


def audit(pairs: DataFrame, first_stage: DataFrame, length: Column | str,
          weights: str, part: str = "part") -> DataFrame:
    """Leakage and shortcut report as (check, subject, value, limit, ok).

    ``pairs`` and ``first_stage`` hold file_id, group_key and their part; ``pairs``
    also label and donor_key.  Checks that must be zero carry a limit of 0.

    Two aggregations give all of it.  Every key gets a mask of the sets that it belongs to
    (genuine, forged, donor, part, seen in the first stage), and the counts of masks answer
    the checks of groups and clips.  Sizes and profiles come from grouping sets.
    ``pairs`` is reduced to narrow columns and stored, because both read it.
    """
    a = F.col(weights).cast("array<double>")
    typed = stored(pairs.select(
        "file_id", "group_key", "donor_key", "label", F.col(part).alias("part"),
        pair_type_from_id("label", "file_id").alias("ptype"), as_col(length).cast("double").alias("length"),
        total(a).alias("w_total"), std_pop(a).alias("w_std"), F.array_max(a).alias("w_max")))
    forged, genuine, held = F.col("label") == 1, F.col("label") == 0, F.col("part") == "test"
    groups = marks("group", "group_key", {_FORGED: forged, _GENUINE: genuine,
                                          **{bit: F.col("part") == name for name, bit in _PARTS.items()}})
    donors = marks("group", "donor_key", {_DONOR: forged, _TEST_DONOR: forged & held})
    clips = marks("clip", "file_id", {_TEST: genuine & held})
    seen = first_stage.filter(F.col(part) == "train").select(F.array(
        marks("group", "group_key", {_SEEN: F.lit(True)}), marks("clip", "file_id", {_SEEN: F.lit(True)})).alias("marks"))
    counts = mask_counts([typed.select(F.array(groups, donors, clips).alias("marks")), seen])
    between = F.lit("forged-genuine")
    checks = [
        ("source_groups_shared", between, in_all("group", _FORGED, _GENUINE), None),
        ("donor_groups_shared", between, in_all("group", _DONOR, _GENUINE), None),
        *[("parts_share_groups", F.lit(f"{x}-{y}"), in_all("group", _PARTS[x], _PARTS[y]), 0)
          for x, y in combinations(_PARTS, 2)],
        ("heldout_seen_in_first_stage", F.lit("clips"), in_all("clip", _TEST, _SEEN), 0),
        ("heldout_seen_in_first_stage", F.lit("groups"), in_all("group", _TEST, _SEEN), 0),
        ("heldout_donors_seen", F.lit("donor groups"), in_all("group", _TEST_DONOR, _SEEN), None),
    ]
    shared = counts.agg(*[value.alias(f"v{i}") for i, (_, _, value, _) in enumerate(checks)])
    shared = _facts(shared, [_fact(check, subject, F.col(f"v{i}"), limit)
                             for i, (check, subject, _, limit) in enumerate(checks)])

    weighted = F.col("w_total") > 0
    sets = typed.groupingSets([["ptype"], ["part"], ["ptype", "part"], []], "ptype", "part").agg(
        F.grouping_id().alias("id"), F.count("*").alias("n"),
        F.avg(F.when(weighted, F.col("w_std"))).alias("w_std"), F.avg(F.when(weighted, F.col("w_max"))).alias("w_max"),
        F.avg("length").alias("mean"), F.stddev_pop("length").alias("std"), F.min("length").alias("min"),
        F.max("length").alias("max"), F.count_if(genuine).alias("genuine"), F.count_if(forged).alias("fake"),
        *[F.count_if(F.col("part") == name).alias(name) for name in _PARTS])
    by_kind, by_part, by_both, over_all = (F.col("id") == i for i in (1, 2, 0, 3))
    kind, where = F.col("ptype"), F.col("part")
    sizes = _facts(sets, [
        *[_fact(f"weight_{c}", kind, F.col(f"w_{c}"), None, by_kind & F.col("w_std").isNotNull()) for c in ("std", "max")],
        *[_fact(f"length_{c}", kind, F.col(c), None, by_kind) for c in ("mean", "std", "min", "max")],
        *[_fact("part_rows", F.lit(name), F.col(name), None, over_all) for name in _PARTS],
        *[_fact(f"part_{c}", where, F.col(c), None, by_part) for c in ("genuine", "fake")],
        _fact("test_mix", kind, F.col("n"), None, by_both & (where == "test"))])
    return sizes.unionByName(shared)
