"""Queries that write a corpus of files from whole tables and read it back as samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches
from ..operators.dedup import dedup_first
from ..plans.curation import health_report
from ..plans.samples import prepare_samples
from ..session import shared_dir
from ..sources.arrays import encode_array, encode_int_matrix, encode_matrix
from ..sources.assets import list_registry_assets
from ..sources.files import write_files
from ..sources.manifests import FILE_ORDER, ManifestSource, scan_registry, write_report
from .curate import ISSUES, checked_files
from .registry import query, table

#: What stands in files that must not be opened.
BROKEN = b"broken"


def _file(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def write_corpus(spark: SparkSession, sf: str) -> ManifestSource:
    """A corpus of small files from all embeddings, and its manifest.

    Even vectors lie in train, odd ones in dev.  Beside files that will be chosen stand
    broken ones that must not be: worse names, weights of lower rank, a whole second copy of
    every fifth sample that has audio in test.  Every eleventh has none, and every sixth is
    listed twice.
    """
    root = f"{shared_dir(spark).removeprefix('file://')}/corpus-{uuid.uuid4().hex}"
    v = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    ident, label = F.col("vec_id").cast("string"), F.col("label")
    base = _file(f"{root}/", F.when(F.col("vec_id") % 2 == 0, "train").otherwise("dev"))
    spare = _file(f"{root}/test")
    mel = encode_matrix("embedding", F.lit(8))
    ids = encode_int_matrix(F.array(label + 1, F.col("vec_id") % 100, F.col("vec_id") % 7, F.lit(0).cast("bigint")), F.lit(1))
    mask = encode_int_matrix(F.array(*[F.lit(x).cast("bigint") for x in (1, 1, 1, 0)]), F.lit(1))
    steps = F.sequence(F.lit(1), label + 1)
    # The map names frames backwards; a vector of weights is one too long for every fourth vector.
    entries = F.transform(F.reverse(steps), lambda i: F.format_string('"frame_%02d.jpg": {"alpha": %s}', i, (i / 10).cast("string")))
    as_map = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}")).cast("binary")
    size = label + 1 + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)
    as_vector = encode_array(F.transform(F.sequence(F.lit(1), size), lambda i: (i / 10).cast("float")))
    broken, has_audio = F.lit(BROKEN), F.col("vec_id") % 11 != 10
    preferred, copied = F.col("vec_id") % 3 == 0, has_audio & (F.col("vec_id") % 5 == 0)

    def files(*named: tuple[Column | None, Column, Column]) -> DataFrame:
        # A missing condition means every row.
        return F.filter(F.array(*[
            F.when(F.lit(True) if when is None else when, F.struct(path.alias("path"), content.alias("content")))
            for when, path, content in named]), lambda f: f.isNotNull())

    visual = _file(base, "/visual/", ident)
    each = files(
        (has_audio & preferred, _file(base, "/audio/", ident, ".flv_melspec.npy"), F.col("_mel")),
        (has_audio & preferred, _file(base, "/audio/", ident, "_melspec.npy"), broken),
        (has_audio & ~preferred, _file(base, "/audio/", ident, "_melspec.npy"), F.col("_mel")),
        (None, _file(base, "/text/", ident, "_input_ids.npy"), F.col("_ids")),
        (None, _file(base, "/text/", ident, "_attention_mask.npy"), F.col("_mask")),
        (label < 3, _file(visual, "/attention_weights.json"), as_map),
        (label.between(3, 5), _file(visual, "/keyframe_weights.npy"), F.col("_vector")),
        (label.between(3, 5), _file(visual, "/attention_weights.json"), broken),
        *[(copied, _file(spare, folder, ident, ending), broken) for folder, ending in (
            ("/audio/", "_melspec.npy"), ("/text/", "_input_ids.npy"), ("/text/", "_attention_mask.npy"),
            ("/visual/", "/frame_01.jpg"))])
    frames = F.transform(steps, lambda i: F.struct(
        _file(visual, F.format_string("/frame_%02d.jpg", i)).alias("path"), F.lit(b"jpg").alias("content")))
    packed = v.select("*", mel.alias("_mel"), ids.alias("_ids"), mask.alias("_mask"), as_vector.alias("_vector"))
    rows = packed.select(F.explode(F.concat(each, frames)).alias("f"))
    write_files(rows, F.col("f.path"), F.col("f.content"))
    listed = v.select("vec_id", F.explode(F.when(F.col("vec_id") % 6 == 0, F.array(label, label + 1)).otherwise(
        F.array(label))).alias("emotion"))
    listed = listed.orderBy("vec_id", "emotion").select(ident.alias("file_id"), "emotion")
    write_report(listed, f"{root}/manifest.csv")
    return ManifestSource("corpus", root, "manifest.csv", subdirs=("train", "dev", "test"))


def manifest_rows(spark: SparkSession, source: ManifestSource) -> DataFrame:
    """The first row of every sample in file order."""
    rows = scan_registry(spark, [source], file_order=True)
    return dedup_first(rows, ["source", "file_id"], ["source_rank", *FILE_ORDER]).select("source", "file_id", "emotion")


@query("prepare_samples", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 11 <> 10),
  m AS (SELECT vec_id, label, e, list_avg(e) AS mu, sqrt(list_avg(list_transform(e, lambda x: (x - list_avg(e)) ** 2))) AS sd FROM v),
  w AS (SELECT vec_id, label, unnest(range(1, least(label + 1, 8) + 1)) AS i FROM v)
  SELECT vec_id::VARCHAR AS file_id, 'mel' AS part, p::INTEGER AS pos, round((e[(p // 4) * 8 + p % 4 + 3] - mu) / (sd + 1e-6), 6) AS value
    FROM (SELECT *, unnest(range(32)) AS p FROM m)
  UNION ALL SELECT vec_id::VARCHAR, 'input_ids', p::INTEGER, ([label + 1, vec_id % 100, vec_id % 7, 0])[p + 1]::DOUBLE
    FROM (SELECT *, unnest(range(4)) AS p FROM v)
  UNION ALL SELECT vec_id::VARCHAR, 'attention_mask', p::INTEGER, (p < 3)::INTEGER::DOUBLE FROM (SELECT *, unnest(range(4)) AS p FROM v)
  UNION ALL SELECT vec_id::VARCHAR, 'frames', (i - 1)::INTEGER, i::DOUBLE FROM w
  UNION ALL SELECT vec_id::VARCHAR, 'alpha', (i - 1)::INTEGER,
    round(CASE WHEN label < 3 OR (label < 6 AND vec_id % 4 <> 0) THEN i / 10.0 ELSE 1.0 / (label + 1) END, 6)::DOUBLE FROM w
  UNION ALL SELECT vec_id::VARCHAR, 'emotion', 0, label::DOUBLE FROM v""")
def _(spark, sf):
    """From a manifest and a tree of files to arrays, in long form; no broken file is opened."""
    source = write_corpus(spark, sf)
    out = prepare_samples(manifest_rows(spark, source), list_registry_assets(spark, [source]), width=4)

    def cells(part: str, values: Column) -> Column:
        return F.transform(values, lambda x, i: F.struct(
            F.lit(part).alias("part"), i.alias("pos"), F.round(x.cast("double"), 6).alias("value")))

    numbers = F.transform("frames", lambda f: F.regexp_extract(f, r"\d+", 0))
    every = F.concat(cells("mel", F.flatten("mel")), cells("input_ids", F.col("input_ids")),
                     cells("attention_mask", F.col("attention_mask")), cells("frames", numbers),
                     cells("alpha", F.col("alpha")), cells("emotion", F.array("emotion")))
    return out.select("file_id", F.explode(every).alias("c")).select("file_id", "c.*")


def write_faulty(spark: SparkSession, sf: str) -> list[ManifestSource]:
    """Two sources of files with faults, even and odd vectors; every fiftieth row of a
    manifest names a file that is not there."""
    root = f"{shared_dir(spark).removeprefix('file://')}/faulty-{uuid.uuid4().hex}"
    rows = checked_files(spark, sf)
    number = F.regexp_extract("path", r"^/corpus/train/(?:audio|text|visual)/(\d+)", 1).cast("long")
    place = F.concat(F.lit(f"{root}/"), F.when(number % 2 == 0, "even").otherwise("odd"),
                     F.regexp_replace("path", "^/corpus", ""))
    write_files(rows, place, "content")
    sources = []
    for rest, name in enumerate(("even", "odd")):
        ids = table(spark, sf, "embeddings").filter(F.col("vec_id") % 2 == rest).select(F.explode(F.array(
            F.col("vec_id").cast("string"),
            F.when(F.col("vec_id") % 50 < 2, F.concat(F.lit("gone"), F.col("vec_id").cast("string"))))).alias("file_id"))
        write_report(ids.filter("file_id IS NOT NULL"), f"{root}/{name}/manifest.csv")
        sources.append(ManifestSource(name, f"{root}/{name}", "manifest.csv", subdirs=("train",)))
    return sources


def report_on(spark: SparkSession, sources: list[ManifestSource]):
    rows = scan_registry(spark, sources)
    listing = list_registry_assets(spark, sources)
    return health_report(rows, listing, [s.name for s in sources], f"{shared_dir(spark)}/health-{uuid.uuid4().hex}")


@query("health_report", f"""WITH {ISSUES}, e AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM embeddings),
  p AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, * FROM i),
  f AS (SELECT source, 'mel_bands' AS section, (CASE WHEN label = 4 THEN 65 ELSE 64 END)::VARCHAR AS name FROM e WHERE label <> 3
    UNION ALL SELECT source, 'text_length', '32' FROM e
    UNION ALL SELECT source, 'frame_count', (CASE WHEN label = 6 THEN 0 ELSE 1 END)::VARCHAR FROM e
    UNION ALL SELECT source, 'issue', issue FROM p),
  c AS (SELECT source, section, name, count(*) AS n FROM f GROUP BY ALL),
  t AS (SELECT source, unnest(['full', 'partial', 'absent', 'problems']) AS name, unnest(range(1, 5)) AS rank,
          unnest([count_if(label NOT IN (3, 6)), count_if(label IN (3, 6)), count_if(vec_id % 50 < 2),
                  (SELECT count(*) FROM p WHERE p.source = e.source)]) AS n FROM e GROUP BY source)
  SELECT source, section, (row_number() OVER (PARTITION BY source, section ORDER BY n DESC, name))::INTEGER AS rank, name, n FROM c
    QUALIFY section <> 'text_length' OR rank <= 5
  UNION ALL SELECT source, 'example', rank::INTEGER, name, 1 FROM (SELECT source, vec_id || ' [' || modality || '] ' || issue AS name,
    row_number() OVER (PARTITION BY source ORDER BY vec_id::VARCHAR, modality, issue) AS rank FROM p) WHERE rank <= 8
  UNION ALL SELECT source, 'total', rank::INTEGER, name, n::BIGINT FROM t""")
def _(spark, sf):
    """Both sources checked from the files that were written for them."""
    return report_on(spark, write_faulty(spark, sf)).rows


@query("list_assets", """WITH f AS (
    SELECT vec_id, 'audio' AS kind FROM embeddings UNION ALL SELECT vec_id, 'input_ids' FROM embeddings
    UNION ALL SELECT vec_id, 'attention_mask' FROM embeddings UNION ALL SELECT vec_id, 'frame' FROM embeddings WHERE label <> 6
    UNION ALL SELECT vec_id, 'weights' FROM embeddings WHERE label <> 7)
  SELECT CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, vec_id::VARCHAR AS file_id, kind,
    CASE WHEN kind = 'weights' OR kind = 'frame' THEN 0 ELSE 1 END AS variant FROM f""")
def _(spark, sf):
    """What a listing of both sources' files finds."""
    return list_registry_assets(spark, write_faulty(spark, sf)).select("source", "file_id", "kind", "variant")


# -- batches -------------------------------------------------------------------------------

_BATCHES = """t AS (SELECT conv_id, turn, [length(w)::DOUBLE for w in string_split(text, ' ')] AS v FROM conversations),
  l AS (SELECT *, least(len(v), 256) AS l, greatest(ceil(least(len(v), 256) / 8.0), 1)::BIGINT * 8 AS wide FROM t),
  r AS (SELECT *, 2048 // wide AS per, row_number() OVER (PARTITION BY wide ORDER BY md5(concat_ws(':', conv_id, turn, '42')),
          conv_id || ':' || turn) AS rk FROM l),
  o AS (SELECT wide, coalesce(sum(b) OVER (ORDER BY wide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f
        FROM (SELECT wide, ceil(count(*) / any_value(per)::DOUBLE) AS b FROM r GROUP BY wide)),
  b AS (SELECT conv_id, turn, v, l, f + (rk - 1) // per AS batch FROM r JOIN o USING (wide))"""


def _turns(spark, sf):
    lengths = F.transform(F.split("text", " "), lambda w: F.length(w).cast("double"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", lengths.alias("v"))
    return batches.length_batches(turns, F.size("v"), ["conv_id", "turn"], budget=2048)


@query("length_batches", f"WITH {_BATCHES} SELECT conv_id, turn, batch FROM b")
def _(spark, sf):
    """Turns in batches of at most 2 048 padded words."""
    return _turns(spark, sf).select("conv_id", "turn", "batch")


@query("batch_report", f"""WITH {_BATCHES}, g AS (SELECT count(*) AS n, sum(l) AS r, count(*) * max(l) AS c FROM b GROUP BY batch)
  SELECT count(*)::BIGINT AS n_batches, sum(n)::BIGINT AS n_rows, sum(r)::BIGINT AS real_cells, sum(c)::BIGINT AS cells,
    max(c)::BIGINT AS largest, round((sum(c) - sum(r)) / sum(c)::DOUBLE, 6) AS padding FROM g""")
def _(spark, sf):
    out = batches.batch_report(_turns(spark, sf), F.size("v"))
    return out.withColumn("padding", F.round("padding", 6))


@query("collate", f"""WITH {_BATCHES}, w AS (SELECT batch, max(l) AS width FROM b GROUP BY batch),
  c AS (SELECT b.*, width, unnest(range(width)) AS pos FROM b JOIN w USING (batch))
  SELECT batch, conv_id, turn, l::INTEGER AS length, pos::INTEGER AS pos, CASE WHEN pos < l THEN v[pos + 1] ELSE 0 END::DOUBLE AS value FROM c""")
def _(spark, sf):
    out = batches.collate(_turns(spark, sf), "v", ["conv_id", "turn"]).select("batch", F.inline("items"))
    return out.select("batch", "conv_id", "turn", "length", F.posexplode("values").alias("pos", "value"))
