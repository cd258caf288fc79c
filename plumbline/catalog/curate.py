"""Filters, keys, labels, deduplication, asset resolution, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import keys, scores, vectors
from ..operators import compare, dedup, filters, health, leakage, resolve, sampling
from ..plans import curation
from ..session import shared_dir, stored
from ..sources import arrays, assets, manifests
from . import frames
from .registry import query, table

STATUS = {"O": "genuine", "F": "forged"}


def _orders(spark, sf):
    kind = keys.display_name("o_orderstatus", STATUS)
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"))


_ORDERS = ("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'genuine' WHEN 'F' THEN 'forged' END"
           " AS kind FROM orders")


@query("keep_genuine", f"SELECT * FROM ({_ORDERS}) WHERE kind = 'genuine'")
def _(spark, sf):
    return filters.keep_genuine(_orders(spark, sf), "kind")


@query("keep_forged", f"SELECT * FROM ({_ORDERS}) WHERE kind IS DISTINCT FROM 'genuine'")
def _(spark, sf):
    return filters.keep_forged(_orders(spark, sf), "kind")


def _counted(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = (F.when(F.col("event_id") % 5 == 0, F.concat(k, F.lit(".0")))
            .when(F.col("event_id") % 5 == 1, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(k))
    return table(spark, sf, "events").select("event_id", "event_type", text.alias("n_text"))


_COUNTED = """t AS (SELECT event_id, event_type, props->>'$.k' AS k FROM events),
 c AS (SELECT event_id, event_type,
   CASE event_id % 5 WHEN 0 THEN k || '.0' WHEN 1 THEN ' ' || k || ' ' ELSE k END AS n_text FROM t),
 r AS (SELECT *, CASE WHEN (CASE WHEN regexp_full_match(trim(n_text), '[+-]?[0-9]+')
        THEN trim(n_text)::BIGINT ELSE 0 END) >= 50 THEN 'kept' ELSE 'disregarded' END AS route FROM c)"""


@query("route_min_count", f"WITH {_COUNTED} SELECT * FROM r")
def _(spark, sf):
    return filters.route_min_count(_counted(spark, sf), "n_text", 50)


@query("route_summary", f"""WITH {_COUNTED}
  SELECT route, event_type, count(*)::BIGINT AS n FROM r GROUP BY ALL""")
def _(spark, sf):
    routed = filters.route_min_count(_counted(spark, sf), "n_text", 50)
    return filters.route_summary(routed, ["route", "event_type"])


@query("write_routed", f"WITH {_COUNTED} SELECT event_id, event_type, trim(n_text) AS n_text, route FROM r")
def _(spark, sf):
    out = f"{shared_dir(spark)}/routed-{uuid.uuid4().hex}"
    routed = filters.route_min_count(_counted(spark, sf), "n_text", 50)
    manifests.write_routed(routed.withColumn("n_text", F.trim("n_text")), "route", out)
    back = manifests.scan_manifest(spark, out, multi_line=False)
    return back.withColumn("event_id", F.col("event_id").cast("bigint"))


def _ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", frames.file_id().alias("file_id"))


_IDS = f"ids AS (SELECT doc_id, {frames.FILE_ID} AS file_id FROM documents)"
_SOURCE = "split_part(split_part(file_id, '___', 1), '_', 1)"
_DONOR = f"""CASE WHEN contains(file_id, '___') THEN split_part(split_part(file_id, '___', 2), '_', 1)
  ELSE {_SOURCE} END"""


@query("source_group", f"WITH {_IDS} SELECT doc_id, {_SOURCE} AS group_key FROM ids")
def _(spark, sf):
    return _ids(spark, sf).select("doc_id", keys.source_group("file_id").alias("group_key"))


@query("donor_group", f"WITH {_IDS} SELECT doc_id, {_DONOR} AS donor_key FROM ids")
def _(spark, sf):
    return _ids(spark, sf).select("doc_id", keys.donor_group("file_id").alias("donor_key"))


CODES = ["AUT", "BUI", "HOU"]
_CODE = "CASE code WHEN 'AUT' THEN 0 WHEN 'BUI' THEN 1 WHEN 'HOU' THEN 2 END"


@query("label_from_token", f"""SELECT c_custkey, {_CODE} AS label
  FROM (SELECT c_custkey, CASE WHEN c_nationkey >= 20 THEN NULL ELSE left(c_mktsegment, 3) END AS code
        FROM customer)""")
def _(spark, sf):
    # Nations from 20 up get an id with too few tokens.
    tokens = F.when(F.col("c_nationkey") < 20, F.concat_ws(
        "_", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"),
        F.substring("c_mktsegment", 1, 3))).otherwise(F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select(
        "c_custkey", keys.label_from_token(tokens, CODES).alias("label"))


LEVELS = ["1-urgent", "2-high", "3-medium", "5-low"]


@query("label_from_text", """SELECT o_orderkey, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 0
  WHEN '2-high' THEN 1 WHEN '3-medium' THEN 2 WHEN '5-low' THEN 3 END AS label FROM orders""")
def _(spark, sf):
    padded = F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit("\n"))
    return table(spark, sf, "orders").select(
        "o_orderkey", keys.label_from_text(padded, LEVELS).alias("label"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
_SEGMENTS = str(SEGMENTS)


@query("encode_decode_labels", f"""SELECT c_custkey,
    nullif(list_position({_SEGMENTS}, c_mktsegment), 0) - 1 AS code,
    CASE WHEN list_contains({_SEGMENTS}, c_mktsegment) THEN c_mktsegment END AS name FROM customer""")
def _(spark, sf):
    coded = table(spark, sf, "customer").select(
        "c_custkey", keys.encode_labels("c_mktsegment", SEGMENTS).alias("code"))
    return coded.withColumn("name", keys.decode_labels("code", SEGMENTS))


@query("dataset_of", """SELECT page_id, CASE WHEN contains(lower(url), 'example.com') THEN 'COM'
  WHEN contains(lower(url), 'example.net') THEN 'NET' ELSE 'OTHER' END AS dataset FROM pages""")
def _(spark, sf):
    rules = [("example.com", "COM"), ("example.net", "NET")]
    return table(spark, sf, "pages").select(
        "page_id", keys.dataset_of(F.upper("url"), rules, "OTHER").alias("dataset"))


@query("pair_type", f"""WITH {frames.SCORES} SELECT doc_id, ptype,
  CASE WHEN y = 0 THEN '{keys.GENUINE}' WHEN doc_id % 3 = 0 THEN '{keys.SPLICED}'
       ELSE '{keys.TAMPERED}' END AS ptype_from_id FROM s""")
def _(spark, sf):
    s = frames.scores(spark, sf)
    return s.select("doc_id", "ptype",
                    keys.pair_type_from_id("y", frames.file_id()).alias("ptype_from_id"))


@query("verdict_band", f"""WITH {frames.SCORES} SELECT doc_id,
    CASE WHEN p >= 0.5 THEN 'FAKE' ELSE 'GENUINE' END AS verdict,
    CASE WHEN abs(p - 0.5) < 0.05 THEN 'low' WHEN abs(p - 0.5) < 0.15 THEN 'moderate'
         ELSE 'high' END AS band,
    round(1 / (1 + exp(-p)), 6) AS sig, round(abs(round(p, 4) - round(1 - p, 4)), 4) AS delta FROM s""")
def _(spark, sf):
    p = F.col("p")
    return frames.scores(spark, sf).select(
        "doc_id", scores.verdict("p").alias("verdict"),
        scores.band(F.abs(p - 0.5)).alias("band"),
        F.round(scores.sigmoid("p"), 6).alias("sig"),
        scores.rounded_delta(p, 1 - p, 4).alias("delta"))


@query("text_or_default", """SELECT conv_id, turn,
  CASE WHEN role = 'system' OR trim(text, e' \\t\\n\\r') = '' THEN '[inaudible]'
       ELSE trim(text, e' \\t\\n\\r') END AS transcript FROM conversations""")
def _(spark, sf):
    raw = F.when(F.col("role") == "system", F.lit(" \n")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", keys.text_or_default(raw).alias("transcript"))


@query("clean_transcript", """SELECT conv_id, turn,
  regexp_replace(lower(text), '[[:punct:]]', '', 'g') AS transcript FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", keys.clean_transcript("text").alias("transcript"))


@query("pad_tokens", """WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
  g AS (SELECT *, unnest(range(128)) AS pos FROM t)
  SELECT conv_id, turn, pos, CASE WHEN pos < len(w) THEN length(w[pos + 1]) ELSE 0 END::BIGINT AS token,
         CASE WHEN pos < len(w) THEN 1 ELSE 0 END::BIGINT AS attention, pos >= len(w) AS is_pad FROM g""")
def _(spark, sf):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint"))
    padded = table(spark, sf, "conversations").select(
        "conv_id", "turn", vectors.pad_tokens(ids).alias("t"))
    rows = F.arrays_zip(F.col("t.input_ids").alias("token"),
                        F.col("t.attention_mask").alias("attention"),
                        vectors.pad_mask(F.col("t.attention_mask")).alias("is_pad"))
    long = padded.select("conv_id", "turn", F.posexplode(rows).alias("pos", "r"))
    return long.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"),
                       "r.token", "r.attention", "r.is_pad")


@query("admit", """WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'clip.MP4' WHEN 1 THEN 'a.b.webm'
    WHEN 2 THEN 'clip' ELSE 'clip.txt' END AS name, length(html)::BIGINT * 100000 AS size FROM pages)
  SELECT page_id, CASE WHEN page_id % 4 >= 2 THEN 'unsupported format'
    WHEN size / 1e6 > 500 THEN 'file too large' END AS reject_reason FROM f""")
def _(spark, sf):
    m = F.col("page_id") % 4
    name = (F.when(m == 0, "clip.MP4").when(m == 1, "a.b.webm").when(m == 2, "clip")
            .otherwise("clip.txt"))
    files = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("/in.box/"), name).alias("path"),
        (F.length("html").cast("bigint") * 100000).alias("length"))
    return filters.admit(files, "path", "length").select("page_id", "reject_reason")


# -- deduplication -------------------------------------------------------------------

_LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE_OUT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "kind"]


def _lines(spark, sf):
    kind = F.when(F.col("l_returnflag") == "N", "genuine").otherwise("forged")
    return table(spark, sf, "lineitem").withColumn("kind", kind)


def _lines_sql(inner: str, outer: str) -> str:
    return f"""WITH l AS (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'genuine' ELSE 'forged' END AS kind
        FROM lineitem),
      d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY {', '.join(_LINE_ORDER)}) AS rn FROM l WHERE {inner})
      SELECT {', '.join(_LINE_OUT)} FROM d WHERE rn = 1 AND {outer}"""


@query("dedup_then_filter", _lines_sql("true", "kind = 'genuine'"))
def _(spark, sf):
    return dedup.dedup_then_filter(
        _lines(spark, sf), ["l_orderkey", "l_linenumber"], _LINE_ORDER,
        lambda d: filters.keep_genuine(d, "kind")).select(*_LINE_OUT)


@query("filter_then_dedup", _lines_sql("kind = 'genuine'", "true"))
def _(spark, sf):
    return dedup.filter_then_dedup(
        _lines(spark, sf), ["l_orderkey", "l_linenumber"], _LINE_ORDER,
        lambda d: filters.keep_genuine(d, "kind")).select(*_LINE_OUT)


def _line_manifest(spark, sf):
    """Line items as a manifest in which ids repeat; the flag is the label token."""
    code = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                       F.col("l_returnflag"))
    kind = F.when(F.col("l_linestatus") == "O", "genuine").otherwise("forged")
    return table(spark, sf, "lineitem").select(
        F.lit("lines").alias("source"), code.alias("file_id"), kind.alias("forgery_type"), *_LINE_ORDER)


_LINE_MANIFEST = f"""m AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_returnflag AS file_id,
    l_orderkey::VARCHAR AS group_key, CASE WHEN l_linestatus = 'O' THEN 'genuine' ELSE 'forged' END AS forgery_type,
    {', '.join(_LINE_ORDER)} FROM lineitem)"""


@query("labelled_samples", f"""WITH {_LINE_MANIFEST}, d AS (SELECT *, row_number() OVER (PARTITION BY file_id
    ORDER BY {', '.join(_LINE_ORDER)}) AS rn FROM m)
  SELECT file_id, group_key, l_partkey, CASE l_returnflag WHEN 'A' THEN 0 ELSE 1 END AS emotion FROM d
  WHERE rn = 1 AND forgery_type = 'genuine' AND l_returnflag IN ('A', 'N')""")
def _(spark, sf):
    out = curation.labelled_samples(_line_manifest(spark, sf), _LINE_ORDER,
                                    keys.label_from_token("file_id", ["A", "N"]))
    return out.select("file_id", "group_key", "l_partkey", "emotion")


@query("pair_samples", f"""WITH {_LINE_MANIFEST}, d AS (SELECT *, row_number() OVER (PARTITION BY file_id, forgery_type
    ORDER BY {', '.join(_LINE_ORDER)}) AS rn FROM m)
  SELECT file_id, group_key, group_key AS donor_key, l_partkey,
    CASE forgery_type WHEN 'genuine' THEN 0 ELSE 1 END AS label FROM d WHERE rn = 1""")
def _(spark, sf):
    m = _line_manifest(spark, sf)
    out = curation.pair_samples(m, m, _LINE_ORDER)
    return out.select("file_id", "group_key", "donor_key", "l_partkey", "label")


# -- assets ----------------------------------------------------------------------------

def _assets(spark, sf):
    return assets.parse_assets(frames.listing(spark, sf), frames.CORPUS)


_BASE = "CASE r WHEN 0 THEN '/corpus/train' ELSE '/corpus/dev' END"
_WEIGHTS = """CASE WHEN label < 3 THEN base || '/visual/' || id || '/attention_weights.json'
  WHEN label < 6 THEN base || '/visual/' || id || '/keyframe_weights.npy' END AS weights,
  CASE WHEN label < 3 THEN 'json' WHEN label < 6 THEN 'npy' ELSE 'uniform' END AS weights_kind"""


@query("complete_samples", f"""WITH {frames.ASSETS},
  c AS (SELECT *, {_BASE} AS base, row_number() OVER (PARTITION BY id ORDER BY r) AS rn FROM af
        WHERE has_audio AND has_text AND has_visual)
  SELECT id::VARCHAR AS file_id, base, base || '/audio/' || id || suffix AS audio,
         base || '/text/' || id || '_input_ids.npy' AS input_ids,
         base || '/text/' || id || '_attention_mask.npy' AS attention_mask,
         base || '/visual/' || id AS visual_dir, {_WEIGHTS}, (label + 1)::BIGINT AS n_frames
  FROM c JOIN documents ON id = doc_id WHERE rn = 1""")
def _(spark, sf):
    return resolve.complete_samples(frames.manifest(spark, sf), _assets(spark, sf)).drop("source")


@query("resolve_assets", f"""WITH {frames.ASSETS}, b AS (SELECT *, {_BASE} AS base FROM af)
  SELECT id::VARCHAR AS file_id, base, CASE WHEN has_audio THEN base || '/audio/' || id || suffix END AS audio,
         CASE WHEN has_text THEN base || '/text/' || id || '_input_ids.npy' END AS input_ids,
         coalesce(label + 1, 0)::BIGINT AS n_frames FROM b JOIN documents ON id = doc_id""")
def _(spark, sf):
    out = resolve.resolve_assets(frames.manifest(spark, sf), _assets(spark, sf))
    return out.select("file_id", "base", "audio", "input_ids", "n_frames")


def _thin(spark, sf):
    """Listing without audio, so that coverage varies."""
    return _assets(spark, sf).filter(F.col("kind") != "audio")


_COVER = f"""{frames.ASSETS},
  g AS (SELECT id, r, has_text, has_visual, row_number() OVER (PARTITION BY id ORDER BY r) AS rn
        FROM af WHERE has_text OR has_visual),
  cov AS (SELECT d.doc_id, {_BASE.replace('r WHEN', 'g.r WHEN')} AS b, g.id,
                 coalesce(has_text, false) AS has_text, coalesce(has_visual, false) AS has_visual
          FROM documents d LEFT JOIN g ON g.id = d.doc_id AND g.rn = 1)"""


@query("coverage", f"""WITH {_COVER} SELECT doc_id::VARCHAR AS file_id,
  CASE WHEN id IS NOT NULL THEN b END AS base, false AS has_audio, has_text, has_visual,
  CASE WHEN id IS NULL THEN 'absent' ELSE 'partial' END AS coverage FROM cov""")
def _(spark, sf):
    return resolve.coverage(frames.manifest(spark, sf), _thin(spark, sf)).drop("source")


@query("coverage_summary", f"""WITH {frames.ASSETS},
  g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS rn FROM af)
  SELECT 'corpus' AS source, count_if(has_audio AND has_text AND has_visual)::BIGINT AS n_full,
    count_if(NOT (has_audio AND has_text AND has_visual))::BIGINT AS n_partial, 0::BIGINT AS n_absent
  FROM g JOIN documents ON id = doc_id WHERE rn = 1""")
def _(spark, sf):
    return resolve.coverage_summary(
        resolve.coverage(frames.manifest(spark, sf), _assets(spark, sf)))


@query("absent", f"WITH {_COVER} SELECT doc_id::VARCHAR AS file_id FROM cov WHERE id IS NULL")
def _(spark, sf):
    return resolve.absent(frames.manifest(spark, sf), _thin(spark, sf)).drop("source")


@query("inventory", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING' ELSE 'present' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(spark, sf):
    return assets.inventory(table(spark, sf, "documents").select("doc_id"),
                            table(spark, sf, "labels"), ["doc_id"])


@query("attach_weights", """WITH f AS (SELECT user_id, lpad(event_id::VARCHAR, 12, '0') AS frame FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS pos,
          count(*) OVER (PARTITION BY user_id) AS n FROM f)
  SELECT user_id, frame, pos::INTEGER AS pos,
    round(CASE WHEN len(embedding) = n THEN embedding[pos + 1]::DOUBLE ELSE 1.0::DOUBLE / n END, 6) AS alpha
  FROM n LEFT JOIN embeddings ON vec_id = user_id WHERE pos < 8""")
def _(spark, sf):
    f = table(spark, sf, "events").select(
        "user_id", F.lpad(F.col("event_id").cast("string"), 12, "0").alias("frame"))
    w = table(spark, sf, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    return frames.rounded(resolve.attach_weights(f, w, "user_id", "frame", "embedding", resolve.SLOTS), "alpha")


@query("zip_weights", """WITH t AS (SELECT conv_id, turn, list_sort(list_distinct(string_split(text, ' '))) AS f
    FROM conversations),
  g AS (SELECT *, len(f) % 3 = 0 AS fits, unnest(range(len(f))) AS pos FROM t)
  SELECT conv_id, turn, pos, f[pos + 1] AS frame,
    round(CASE WHEN fits THEN (pos + 1) / 10.0::DOUBLE ELSE 1.0::DOUBLE / len(f) END, 6) AS alpha FROM g""")
def _(spark, sf):
    words = F.array_distinct(F.split("text", " "))
    ramp = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: i / F.lit(10.0))
    w = F.when(F.size(words) % 3 == 0, ramp).otherwise(F.array(F.lit(1.0)).cast("array<double>"))
    # A lone weight only fits one word, where it equals the fallback.
    z = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(resolve.zip_weights(words, w)).alias("pos", "z"))
    return z.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"),
                    F.col("z.frame").alias("frame"), F.round("z.alpha", 6).alias("alpha"))


# -- sources -----------------------------------------------------------------------------

@query("scan_manifest", "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role, text FROM conversations")
def _(spark, sf):
    out = f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    (table(spark, sf, "conversations").write.option("quoteAll", "true").option("escape", '"')
     .csv(out, header=True))
    return manifests.scan_manifest(spark, out)


@query("scan_registry", """SELECT source, file_id, label, group_key FROM (
    SELECT 'genuine' AS source, c_custkey::VARCHAR || '_' || c_nationkey AS file_id, 0 AS label,
           c_custkey::VARCHAR AS group_key FROM customer
    UNION ALL SELECT 'forged', s_suppkey::VARCHAR || '_' || s_nationkey, 1, s_suppkey::VARCHAR FROM supplier)""")
def _(spark, sf):
    root = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    for name, key, nation in (("customer", "c_custkey", "c_nationkey"),
                              ("supplier", "s_suppkey", "s_nationkey")):
        ids = F.concat_ws("_", F.col(key).cast("string"), F.col(nation).cast("string"))
        table(spark, sf, name).select(ids.alias("file_id")).write.csv(
            f"{root}/{name}/manifest", header=True)
    registered = [manifests.ManifestSource("genuine", f"{root}/customer", "manifest", label=0),
                  manifests.ManifestSource("not_delivered", f"{root}/none", "manifest", label=0),
                  manifests.ManifestSource("forged", f"{root}/supplier", "manifest", label=1)]
    rows = manifests.scan_registry(spark, registered)
    return rows.select("source", "file_id", "label", keys.source_group("file_id").alias("group_key"))


@query("decode_arrays", f"""WITH {frames.ELEMENTS} SELECT vec_id, 1 AS n_dims, 64 AS width,
   round(sum(x), 4) AS total, count(*)::BIGINT AS n FROM e GROUP BY vec_id""")
def _(spark, sf):
    files = table(spark, sf, "embeddings").select(
        "vec_id", arrays.encode_array("embedding").alias("content"))
    a = arrays.decode_arrays(files)
    return a.select("vec_id", F.size("array.shape").alias("n_dims"),
                    F.get("array.shape", F.lit(0)).alias("width"),
                    F.round(vectors.total(vectors.doubles("array.data")), 4).alias("total"),
                    F.size("array.data").cast("bigint").alias("n"))


@query("decode_ints", """SELECT event_id, pos::INTEGER AS pos,
   CASE pos WHEN 0 THEN event_id ELSE 1099511627776 + event_id * 3 END AS value
   FROM events, range(2) r(pos)""")
def _(spark, sf):
    """Whole numbers beyond what floats hold come back as they were."""
    ids = F.array(F.col("event_id"), F.lit(1 << 40) + F.col("event_id") * 3)
    files = table(spark, sf, "events").select("event_id", arrays.encode_ints(ids).alias("content"))
    return arrays.decode_arrays(files).select("event_id", F.posexplode("array.ints").alias("pos", "value"))


@query("parse_weight_map", """SELECT event_id, unnest(range(2)) AS pos, unnest(['frame_1', 'frame_2']) AS frame,
   unnest([0.0::DOUBLE, (props->>'$.k')::DOUBLE]) AS alpha FROM events""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"frame_2": {"alpha": '), k, F.lit('}, "frame_1": {}}'))
    rows = table(spark, sf, "events").select(
        "event_id", F.posexplode(arrays.parse_weight_map(text)).alias("pos", "w"))
    return rows.select("event_id", F.col("pos").cast("bigint").alias("pos"), "w.frame", "w.alpha")


# -- health --------------------------------------------------------------------------------

def checked_files(spark, sf):
    """(path, content) of array files made from the embeddings; the label decides what is
    wrong with them."""
    e = table(spark, sf, "embeddings").withColumn("id", F.col("vec_id").cast("string"))
    lab = F.col("label")
    junk = F.lit("junk").cast("binary")
    nan = F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))
    audio = F.when(lab == 3, junk).otherwise(
        arrays.encode_array(F.when(lab == 4, nan).otherwise(F.col("embedding"))))
    mask_len = F.when(lab == 5, 16).otherwise(32)
    inf = F.concat("embedding", F.array(F.lit(float("inf")).cast("float")))

    def file(where, folder, ending, content):
        # A missing condition means every row.
        made = F.struct(F.concat(F.lit(f"/corpus/train/{folder}/"), "id", F.lit(ending)).alias("path"), content.alias("content"))
        return made if where is None else F.when(where, made)

    # All files of a vector are made in one step, from one read of the table.
    made = e.select("id", "label", audio.alias("_audio"), arrays.encode_array(F.slice("embedding", 1, 32)).alias("_ids"),
                    arrays.encode_array(F.slice("embedding", F.lit(1), mask_len)).alias("_mask"),
                    arrays.encode_array(F.when(lab == 8, inf).otherwise(F.col("embedding"))).alias("_weights"))
    each = F.array(
        file(None, "audio", "_melspec.npy", F.col("_audio")),
        file(None, "text", "_input_ids.npy", F.col("_ids")),
        file(None, "text", "_attention_mask.npy", F.col("_mask")),
        file(lab != 6, "visual", "/frame_1.jpg", junk),
        file(lab != 7, "visual", "/keyframe_weights.npy", F.col("_weights")))
    return made.select(F.explode(each).alias("f")).filter("f IS NOT NULL").select("f.path", "f.content")


def _checked(spark, sf):
    e = table(spark, sf, "embeddings")
    manifest = e.select(F.lit("corpus").alias("source"), F.col("vec_id").cast("string").alias("file_id"))
    # Stored, so that a task does not make files in one Python worker while it probes them in another.
    return manifest, assets.parse_assets(stored(checked_files(spark, sf)), frames.CORPUS)


ISSUES = """i AS (
  SELECT vec_id, 'audio' AS modality, 'load_error:ValueError' AS issue FROM embeddings WHERE label = 3
  UNION ALL SELECT vec_id, 'audio', 'mel_bands=' || CASE WHEN label = 4 THEN 65 ELSE 64 END
    FROM embeddings WHERE label <> 3
  UNION ALL SELECT vec_id, 'audio', 'NaN' FROM embeddings WHERE label = 4
  UNION ALL SELECT vec_id, 'text', 'shape mismatch (32) vs (16)' FROM embeddings WHERE label = 5
  UNION ALL SELECT vec_id, 'visual', 'no frames' FROM embeddings WHERE label = 6
  UNION ALL SELECT vec_id, 'visual', 'no weights file' FROM embeddings WHERE label = 7
  UNION ALL SELECT vec_id, 'visual:weights', 'Inf' FROM embeddings WHERE label = 8)"""


@query("issues", f"WITH {ISSUES} SELECT vec_id::VARCHAR AS file_id, modality, issue FROM i")
def _(spark, sf):
    found = curation.health_check(*_checked(spark, sf))
    return found.select("file_id", "modality", "issue")


@query("issue_summary", f"WITH {ISSUES} SELECT issue, count(*)::BIGINT AS n FROM i GROUP BY issue")
def _(spark, sf):
    return health.issue_summary(curation.health_check(*_checked(spark, sf)))


@query("issue_examples", f"""WITH {ISSUES} SELECT vec_id::VARCHAR AS file_id, modality, issue FROM i
   ORDER BY 1, 2, 3 LIMIT 8""")
def _(spark, sf):
    found = curation.health_check(*_checked(spark, sf))
    return health.issue_examples(found).select("file_id", "modality", "issue")


@query("write_report", """SELECT lang, count(DISTINCT source)::VARCHAR AS n_groups FROM documents GROUP BY lang""")
def _(spark, sf):
    """A summary written as one CSV file and read back; CSV cells are strings."""
    out = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    manifests.write_report(health.group_counts(table(spark, sf, "documents"), ["lang"], "source"), out)
    return manifests.scan_manifest(spark, out)


def _outcome(check) -> str:
    try:
        check()
    except ValueError:
        return "raised"
    return "passed"


@query("gates", """SELECT * FROM (VALUES ('columns', 'passed'), ('columns_missing', 'raised'),
   ('constant_crop', 'passed'), ('constant_label', CASE WHEN (SELECT count(DISTINCT label) FROM embeddings) > 1
   THEN 'raised' ELSE 'passed' END), ('healthy', CASE WHEN (SELECT count(*) FROM embeddings) > 0
   THEN 'raised' ELSE 'passed' END), ('disjoint', CASE WHEN EXISTS (SELECT source FROM documents
   GROUP BY source HAVING count(DISTINCT lang) > 1) THEN 'raised' ELSE 'passed' END)) g(gate, outcome)""")
def _(spark, sf):
    """The gates on whole tables, each with the outcome that the data call for."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    checks = {
        "columns": lambda: filters.require_columns(d, ["doc_id", "text"]),
        "columns_missing": lambda: filters.require_columns(d, ["doc_id", "label"]),
        "constant_crop": lambda: health.assert_constant(e, F.size(vectors.center_crop("embedding", 50))),
        "constant_label": lambda: health.assert_constant(e, "label"),
        "healthy": lambda: health.assert_healthy(curation.health_check(*_checked(spark, sf))),
        "disjoint": lambda: leakage.assert_disjoint(d, "source", "lang"),
    }
    return spark.createDataFrame([(k, _outcome(v)) for k, v in checks.items()], "gate string, outcome string")


@query("value_counts", """SELECT coalesce(CASE o_orderstatus WHEN 'O' THEN 'genuine' WHEN 'F' THEN 'forged' END, '?')
   AS value, count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def _(spark, sf):
    return health.value_counts(_orders(spark, sf), "kind")


@query("histogram", """SELECT n AS value, count(*)::BIGINT AS n FROM
   (SELECT len(string_split(text, ' '))::INTEGER AS n FROM conversations) GROUP BY 1""")
def _(spark, sf):
    words = F.size(F.split("text", " "))
    return health.histogram(table(spark, sf, "conversations"), words)


@query("top_values", """SELECT p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY 1
   ORDER BY n DESC, value LIMIT 5""")
def _(spark, sf):
    return sampling.top_values(table(spark, sf, "part"), "p_brand", 5)


@query("class_profile", f"""WITH {frames.SCORES} SELECT ptype, count(*)::BIGINT AS n, round(avg(n_chars), 6) AS mean,
   round(stddev_pop(n_chars), 6) AS std, min(n_chars)::DOUBLE AS min, max(n_chars)::DOUBLE AS max
   FROM s GROUP BY ptype""")
def _(spark, sf):
    out = health.class_profile(frames.scores(spark, sf), "ptype", "n_chars")
    return frames.rounded(out, "mean", "std")


@query("array_profile", f"""WITH {frames.ELEMENTS},
  r AS (SELECT vec_id, label, sum(x) AS t, stddev_pop(x) AS s, max(x) AS m FROM e GROUP BY ALL)
  SELECT label, count(*)::BIGINT AS n, round(avg(s), 6) AS mean_std, round(avg(m), 6) AS mean_max
  FROM r WHERE t > 0 GROUP BY label""")
def _(spark, sf):
    out = health.array_profile(table(spark, sf, "embeddings"), "label", "embedding")
    return frames.rounded(out, "mean_std", "mean_max")


@query("constant_width", """SELECT label, 50 AS narrowest, 50 AS widest, 0.0::DOUBLE AS weight_std
   FROM embeddings GROUP BY label""")
def _(spark, sf):
    """After the crop every row has one width, and equal weights have no spread."""
    e = table(spark, sf, "embeddings").select(
        "label", F.size(vectors.center_crop("embedding", 50)).alias("w"),
        vectors.std_pop(vectors.uniform(8)).alias("s"))
    return e.groupBy("label").agg(F.min("w").alias("narrowest"), F.max("w").alias("widest"),
                                  F.round(F.max("s"), 6).alias("weight_std"))


@query("group_counts", """SELECT lang, count(DISTINCT source)::BIGINT AS n_groups FROM documents GROUP BY lang""")
def _(spark, sf):
    return health.group_counts(table(spark, sf, "documents"), ["lang"], "source")


@query("sufficient_detection", """SELECT user_id, count(*)::BIGINT AS n, count_if(event_type = 'error')::BIGINT AS n_failed,
   count_if(event_type = 'error') <= count(*) * 0.1::DOUBLE AS ok FROM events GROUP BY user_id""")
def _(spark, sf):
    return filters.sufficient_detection(
        table(spark, sf, "events"), "user_id", F.col("event_type") == "error")


@query("compare_published", """SELECT n_regionkey, n_name, ours, published, round(ours - published, 2) AS diff FROM (
   SELECT n.n_regionkey, n.n_name, round(sum(c_acctbal), 2) AS ours FROM customer c
   JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2) LEFT JOIN
   (SELECT n_name, round(sum(s_acctbal), 2) AS published FROM supplier s
   JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY 1) USING (n_name)""")
def _(spark, sf):
    # Sums of cents round to cents in any engine; averages may fall on a tie.
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    ours = (table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("ours"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))
    theirs = (table(spark, sf, "supplier").groupBy("s_nationkey")
              .agg(F.round(F.sum("s_acctbal"), 2).alias("published"))
              .join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "published"))
    return compare.compare(ours.select("n_regionkey", "n_name", "ours"), theirs, ["n_name"])
