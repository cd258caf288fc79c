"""Splits, balancing, ranks, group selections, leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import GENUINE, SPLICED, TAMPERED, donor_group, source_group
from ..operators import balance as balancing
from ..operators import binary, health, keyframes, leakage, order, pairing, sampling, splits
from ..plans import curation
from . import frames
from .frames import SCORES, named_parts, one_vs_sql
from .registry import query, table


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


_MD5 = "md5(concat_ws(':', {}, '42'))"

_GROUPS = f"""g AS (SELECT user_id, row_number() OVER (ORDER BY {_MD5.format('user_id')}, user_id) AS rk,
    count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events)),
  gp AS (SELECT user_id, {named_parts('part', 'rk', 'n', 'round_even')} FROM g)"""


@query("stratified_split", f"""SELECT event_id, event_type, {named_parts('part', 'rk', 'n')} FROM (
  SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n,
    row_number() OVER (PARTITION BY event_type ORDER BY {_MD5.format('event_id')}, event_id) AS rk FROM events)""")
def _(spark, sf):
    out = splits.stratified_split(_events(spark, sf), ["event_type"], ["event_id"])
    return out.select("event_id", "event_type", "part")


@query("group_partition", f"WITH {_GROUPS} SELECT * FROM gp")
def _(spark, sf):
    return splits.group_partition(_events(spark, sf), "user_id")


@query("split_by_group", f"WITH {_GROUPS} SELECT event_id, user_id, part FROM events JOIN gp USING (user_id)")
def _(spark, sf):
    return splits.split_by_group(_events(spark, sf), "user_id").select("event_id", "user_id", "part")


@query("apply_partition", f"WITH {_GROUPS} SELECT event_id, user_id, part FROM events JOIN gp USING (user_id)")
def _(spark, sf):
    ev = _events(spark, sf).select("event_id", "user_id")
    return splits.apply_partition(ev, splits.group_partition(ev, "user_id"), "user_id")


@query("group_aware_split", f"""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
  w AS (SELECT user_id, coalesce(sum(n) OVER (ORDER BY {_MD5.format('user_id')}, user_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS t FROM c)
  SELECT event_id, user_id, CASE WHEN before < floor(t * 0.8::DOUBLE) THEN 'train'
    WHEN before < floor(t * 0.8::DOUBLE) + floor(t * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS part
  FROM events JOIN w USING (user_id)""")
def _(spark, sf):
    out = splits.group_aware_split(_events(spark, sf), "user_id")
    return out.select("event_id", "user_id", "part")


@query("fold_of", f"""SELECT event_id, (SELECT count(*) FROM range(1, 10) t(i) WHERE rk > floor(n * i / 10.0::DOUBLE))::INTEGER
    AS fold FROM (SELECT event_id, count(*) OVER () AS n,
      row_number() OVER (ORDER BY {_MD5.format('event_id')}, event_id) AS rk FROM events)""")
def _(spark, sf):
    return splits.fold_of(_events(spark, sf).select("event_id"), ["event_id"])


@query("balance", f"""WITH k AS (SELECT o_orderkey, o_orderstatus,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_MD5.format('o_orderkey')}, o_orderkey) AS rk FROM orders),
  c AS (SELECT count_if(o_orderstatus = 'O') AS g, least(count_if(o_orderstatus = 'F'),
          count_if(o_orderstatus = 'P')) AS m FROM orders),
  f AS (SELECT k.*, row_number() OVER (ORDER BY md5(concat_ws(':', o_orderkey, '43')), o_orderkey) AS mix
        FROM k, c WHERE o_orderstatus IN ('F', 'P') AND rk <= m)
  SELECT o_orderkey, o_orderstatus FROM f, c WHERE mix <= least(g, 2 * m)
  UNION ALL SELECT o_orderkey, o_orderstatus FROM k, c WHERE o_orderstatus = 'O' AND rk <= least(g, 2 * m)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return balancing.balance(o, "o_orderstatus", ["o_orderkey"], "O", ["F", "P"])


@query("ranked", """SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)::BIGINT AS rank FROM events""")
def _(spark, sf):
    ev = _events(spark, sf).select("event_id", "event_type", "value")
    return order.ranked(ev, ["event_type"], [F.desc("value"), "event_id"]).drop("value")


@query("cap", f"SELECT event_id FROM events ORDER BY {_MD5.format('event_id')}, event_id LIMIT 100")
def _(spark, sf):
    ids = table(spark, sf, "events").select("event_id")
    return order.cap(ids, 100, [order.order_key(["event_id"], 42)])


@query("cap_seeded", f"SELECT event_id FROM events ORDER BY {_MD5.format('event_id')}, event_id LIMIT 5000")
def _(spark, sf):
    return order.cap_seeded(table(spark, sf, "events").select("event_id"), 5000, ["event_id"], 42)


@query("first_k", """SELECT user_id, event_id FROM (SELECT user_id, event_id,
   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events) WHERE rk <= 8""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return sampling.first_k(ev, "user_id", ["ts", "event_id"]).drop("ts")


@query("uniform_k", """WITH r AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
  k AS (SELECT DISTINCT user_id, n FROM r), s AS (SELECT *, unnest(range(8)) AS slot FROM k)
  SELECT s.user_id, s.slot::INTEGER AS slot, r.pos::BIGINT AS pos, r.event_id
  FROM s JOIN r ON r.user_id = s.user_id AND r.pos = floor(s.slot * (s.n - 1) / 7.0)""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return sampling.uniform_k(ev, "user_id", ["ts", "event_id"]).select("user_id", "slot", "pos", "event_id")


@query("balanced_evaluation", one_vs_sql("h", f"""{SCORES},
  g AS (SELECT source, row_number() OVER (ORDER BY {_MD5.format('source')}, source) AS rk,
          count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
  gp AS (SELECT source, {named_parts('part', 'rk', 'n', 'round_even')} FROM g),
  k AS (SELECT *, row_number() OVER (PARTITION BY ptype ORDER BY {_MD5.format('doc_id')}, doc_id) AS rk FROM s),
  c AS (SELECT count_if(ptype = '{GENUINE}') AS g, least(count_if(ptype = '{TAMPERED}'),
          count_if(ptype = '{SPLICED}')) AS m FROM s),
  f AS (SELECT k.*, row_number() OVER (ORDER BY md5(concat_ws(':', doc_id, '43')), doc_id) AS mix
        FROM k, c WHERE ptype <> '{GENUINE}' AND rk <= m),
  b AS (SELECT doc_id FROM f, c WHERE mix <= least(g, 2 * m)
        UNION ALL SELECT doc_id FROM k, c WHERE ptype = '{GENUINE}' AND rk <= least(g, 2 * m)),
  h AS (SELECT s.* FROM s JOIN b USING (doc_id) JOIN gp USING (source) WHERE part <> 'train')"""))
def _(spark, sf):
    """Balance, join the partition that was made once from all groups, score what is held out."""
    parts = splits.group_partition(table(spark, sf, "documents"), "source")
    even = balancing.balance(frames.scores(spark, sf), "ptype", ["doc_id"], GENUINE, [TAMPERED, SPLICED])
    held = splits.apply_partition(even, parts, "source").filter("part <> 'train'")
    out = binary.one_vs_reference(held, "lang", "ptype", "y", "p")
    return frames.rounded(out, "acc", "precision", "recall", "f1", "auc")


# -- leakage ---------------------------------------------------------------------------

@query("overlap", """SELECT (SELECT count(DISTINCT c_custkey) FROM customer)::BIGINT AS n_a,
  (SELECT count(DISTINCT o_custkey) FROM orders)::BIGINT AS n_b,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders))::BIGINT AS n_both""")
def _(spark, sf):
    return leakage.overlap(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")),
                           table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("same_set", """SELECT NOT EXISTS (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)
    AND NOT EXISTS (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) AS equal,
  NOT EXISTS (SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer) AS disjoint""")
def _(spark, sf):
    return leakage.same_set(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")),
                            table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), "k")


@query("missing", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    return leakage.missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def _rows_split(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return splits.stratified_split(ev, ["event_type"], ["event_id"])


_ROWS_SPLIT = f"""sp AS (SELECT event_id, user_id, event_type, {named_parts('part', 'rk', 'n')} FROM (
  SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY event_type) AS n,
    row_number() OVER (PARTITION BY event_type ORDER BY {_MD5.format('event_id')}, event_id) AS rk FROM events))"""


@query("disjoint_check", f"""WITH {_ROWS_SPLIT}, u AS (SELECT DISTINCT user_id, part FROM sp),
  p AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) t(part_a, part_b))
  SELECT part_a, part_b, (SELECT count(*) FROM u a JOIN u b USING (user_id)
    WHERE a.part = part_a AND b.part = part_b)::BIGINT AS n_shared FROM p""")
def _(spark, sf):
    return leakage.disjoint_check(_rows_split(spark, sf), "user_id")


@query("disjoint_groups", """SELECT * FROM (VALUES ('train', 'val', 0::BIGINT), ('train', 'test', 0::BIGINT),
   ('val', 'test', 0::BIGINT)) t(part_a, part_b, n_shared)""")
def _(spark, sf):
    return leakage.disjoint_check(splits.split_by_group(_events(spark, sf), "user_id"), "user_id")


@query("part_sizes", f"""WITH {_ROWS_SPLIT} SELECT p AS part, (SELECT count(*) FROM sp WHERE part = p)::BIGINT AS n
  FROM (VALUES ('train'), ('val'), ('test'), ('extra')) t(p)""")
def _(spark, sf):
    return leakage.part_sizes(_rows_split(spark, sf), expected=("train", "val", "test", "extra"))


def _staged(spark, sf):
    """First stage split by rows, second stage split by groups."""
    first = _rows_split(spark, sf)
    second = splits.split_by_group(_events(spark, sf), "user_id").withColumn(
        "label", (F.col("event_type") == "error").cast("int"))
    return first, second


@query("cross_stage_overlap", f"""WITH {_ROWS_SPLIT}, {_GROUPS},
  held AS (SELECT event_id, user_id, event_type FROM events JOIN gp USING (user_id) WHERE part = 'test'),
  tr AS (SELECT * FROM sp WHERE part = 'train')
  SELECT 'clips' AS subject, count(*)::BIGINT AS n_heldout,
    count_if(event_id IN (SELECT event_id FROM tr))::BIGINT AS n_seen FROM held WHERE event_type <> 'error'
  UNION ALL SELECT 'groups', count(*)::BIGINT, count_if(user_id IN (SELECT user_id FROM tr))::BIGINT
  FROM (SELECT DISTINCT user_id FROM held)""")
def _(spark, sf):
    return leakage.cross_stage_overlap(*_staged(spark, sf), "event_id", "user_id")


@query("balance_report", f"""WITH {_GROUPS} SELECT part, count_if(event_type <> 'error')::BIGINT AS n_genuine,
  count_if(event_type = 'error')::BIGINT AS n_fake FROM events JOIN gp USING (user_id) GROUP BY part""")
def _(spark, sf):
    return health.balance_report(_staged(spark, sf)[1])


@query("mix_report", f"""WITH {_GROUPS} SELECT part, event_type, count(*)::BIGINT AS n
  FROM events JOIN gp USING (user_id) GROUP BY part, event_type""")
def _(spark, sf):
    return health.mix_report(_staged(spark, sf)[1], kind="event_type")


def _audited(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", frames.file_id().alias("file_id"), "n_chars", "source")
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    keyed = docs.withColumn("group_key", source_group("file_id")).withColumn(
        "donor_key", donor_group("file_id"))
    pairs = keyed.join(table(spark, sf, "labels"), "doc_id").join(vec, "doc_id").withColumn(
        "label", F.col("quality"))
    pairs = splits.split_by_group(pairs, "group_key")
    first = splits.stratified_split(keyed.select("doc_id", "file_id", "group_key", "source"),
                                    ["source"], ["doc_id"])
    return pairs, first


_AUDIT = f"""
 k AS (SELECT doc_id, {frames.FILE_ID} AS file_id, source AS group_key, n_chars,
         CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS donor_key FROM documents),
 g AS (SELECT group_key, row_number() OVER (ORDER BY {_MD5.format('group_key')}, group_key) AS rk,
         count(*) OVER () AS n FROM (SELECT DISTINCT group_key FROM k JOIN labels USING (doc_id)
         JOIN embeddings ON vec_id = doc_id)),
 gp AS (SELECT group_key, {named_parts('part', 'rk', 'n', 'round_even')} FROM g),
 w AS (SELECT vec_id, stddev_pop(x) AS s, max(x) AS m, sum(x) AS t FROM (
         SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id),
 pa AS (SELECT k.*, quality AS label, part, s, m, t,
          CASE WHEN quality = 0 THEN 'Genuine Pairs' WHEN k.doc_id % 3 = 0 THEN 'Cross-Identity Spliced'
               ELSE 'Emotion Tampering' END AS ptype
        FROM k JOIN labels USING (doc_id) JOIN w ON vec_id = doc_id JOIN gp USING (group_key)),
 fs AS (SELECT file_id, group_key, {named_parts('part', 'rk', 'n')} FROM (
   SELECT file_id, group_key, count(*) OVER (PARTITION BY group_key) AS n, row_number() OVER (
     PARTITION BY group_key ORDER BY {_MD5.format('doc_id')}, doc_id) AS rk FROM k)),
 tr AS (SELECT * FROM fs WHERE part = 'train'), te AS (SELECT * FROM pa WHERE part = 'test'),
 r AS (
  SELECT 'weight_std' AS c, ptype AS s, avg(s) AS v, NULL::DOUBLE AS l FROM pa WHERE t > 0 GROUP BY ptype
  UNION ALL SELECT 'weight_max', ptype, avg(m), NULL FROM pa WHERE t > 0 GROUP BY ptype
  UNION ALL SELECT 'length_mean', ptype, avg(n_chars), NULL FROM pa GROUP BY ptype
  UNION ALL SELECT 'length_std', ptype, stddev_pop(n_chars), NULL FROM pa GROUP BY ptype
  UNION ALL SELECT 'length_min', ptype, min(n_chars), NULL FROM pa GROUP BY ptype
  UNION ALL SELECT 'length_max', ptype, max(n_chars), NULL FROM pa GROUP BY ptype
  UNION ALL SELECT 'source_groups_shared', 'forged-genuine', count(*), NULL FROM (
    SELECT group_key FROM pa WHERE label = 1 INTERSECT SELECT group_key FROM pa WHERE label = 0)
  UNION ALL SELECT 'donor_groups_shared', 'forged-genuine', count(*), NULL FROM (
    SELECT donor_key FROM pa WHERE label = 1 INTERSECT SELECT group_key FROM pa WHERE label = 0)
  UNION ALL SELECT 'parts_share_groups', p, 0, 0 FROM (VALUES ('train-val'), ('train-test'), ('val-test')) t(p)
  UNION ALL SELECT 'part_rows', p, (SELECT count(*) FROM pa WHERE part = p), NULL
    FROM (VALUES ('train'), ('val'), ('test')) t(p)
  UNION ALL SELECT 'part_genuine', part, count_if(label = 0), NULL FROM pa GROUP BY part
  UNION ALL SELECT 'part_fake', part, count_if(label = 1), NULL FROM pa GROUP BY part
  UNION ALL SELECT 'test_mix', ptype, count(*), NULL FROM te GROUP BY ptype
  UNION ALL SELECT 'heldout_seen_in_first_stage', 'clips', count(*), 0 FROM (
    SELECT file_id FROM te WHERE label = 0 INTERSECT SELECT file_id FROM tr)
  UNION ALL SELECT 'heldout_seen_in_first_stage', 'groups', count(*), 0 FROM (
    SELECT group_key FROM te INTERSECT SELECT group_key FROM tr)
  UNION ALL SELECT 'heldout_donors_seen', 'donor groups', count(*), NULL FROM (
    SELECT donor_key FROM te WHERE label = 1 INTERSECT SELECT group_key FROM tr))
"""


@query("audit", f"""WITH {_AUDIT} SELECT c AS "check", s AS subject, round(v::DOUBLE, 6) AS value, l AS "limit",
  (l IS NULL OR v <= l) AS ok FROM r""")
def _(spark, sf):
    pairs, first = _audited(spark, sf)
    return frames.rounded(curation.audit(pairs, first, "n_chars", "embedding"), "value")


# -- keyframes -------------------------------------------------------------------------

def _motion(spark, sf):
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", "event_type", ts.alias("t"), "value")


_WINDOW = 3_600_000_000


@query("motion_gate", f"""SELECT event_id, event_type, round(threshold, 6) AS threshold FROM (
  SELECT event_id, event_type, value, quantile_cont(value, 0.8) OVER (PARTITION BY event_type ORDER BY epoch_us(ts)
    RANGE BETWEEN {_WINDOW // 2} PRECEDING AND {_WINDOW // 2} FOLLOWING) AS threshold FROM events)
  WHERE value >= threshold""")
def _(spark, sf):
    out = keyframes.motion_gate(_motion(spark, sf), "event_type", "t", "value", _WINDOW)
    return frames.rounded(out.select("event_id", "event_type", "threshold"), "threshold")


_CONF = "value / (value + 20)"


@query("top_confident", f"""WITH c AS (SELECT user_id, event_id, {_CONF} AS c FROM events WHERE {_CONF} >= 0.7),
  k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_id) AS rk FROM c)
  SELECT user_id, event_id, round(exp(5 * c) / sum(exp(5 * c)) OVER (PARTITION BY user_id), 6) AS alpha
  FROM k WHERE rk <= 8""")
def _(spark, sf):
    c = F.col("value") / (F.col("value") + 20)
    ev = table(spark, sf, "events").select("user_id", "event_id", c.alias("c"))
    kept = keyframes.top_confident(ev, "user_id", "c", "event_id")
    return frames.rounded(keyframes.temperature_weights(kept, "user_id", "c"), "alpha").drop("c")


@query("align", """WITH f AS (SELECT vec_id, round(label * 100 / 30.0::DOUBLE)::BIGINT AS a, label FROM embeddings)
  SELECT f.vec_id, f.label AS frame, a AS step, round(embedding[a + 1]::DOUBLE, 6) AS value
  FROM f JOIN embeddings e USING (vec_id) WHERE a < 64""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    audio = e.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("bigint").alias("step"),
        F.round(F.col("value").cast("double"), 6).alias("value"))
    video = e.select("vec_id", F.col("label").alias("frame"))
    return keyframes.align(video, audio, "vec_id", "frame", "step", 30.0, 100.0)


_COS = """list_sum(list_transform(range(1, 33), lambda i: v[i] * v[i + 32]))
  / (sqrt(list_sum(list_transform(range(1, 33), lambda i: v[i] * v[i])))
     * sqrt(list_sum(list_transform(range(33, 65), lambda i: v[i] * v[i]))))"""


@query("same_identity", f"""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
   c AS (SELECT vec_id, {_COS} AS similarity FROM x)
   SELECT vec_id, round(similarity, 6) AS similarity FROM c WHERE similarity >= 0.1""")
def _(spark, sf):
    out = keyframes.same_identity(frames.vectors(spark, sf), "a", "b", 0.1)
    return frames.rounded(out.select("vec_id", "similarity"), "similarity")


@query("check_pairs", """WITH x AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v,
    list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE + 0.5::DOUBLE * embedding[32 + i]) AS ref FROM embeddings),
  n AS (SELECT count(*) AS n FROM x),
  p AS (SELECT a.id AS video_id, (a.id * 7 + 1) % n AS audio_id FROM x a, n),
  j AS (SELECT p.*, s.label AS vl, d.label AS al, list_cosine_similarity(d.v[1:32], d.ref) AS own,
          list_cosine_similarity(d.v[1:32], s.ref) AS other
        FROM p JOIN x s ON s.id = video_id JOIN x d ON d.id = audio_id)
  SELECT video_id, audio_id, round(own, 6) AS own_similarity, round(other, 6) AS other_similarity,
    vl <> al AND abs(vl / 10.0::DOUBLE - al / 10.0::DOUBLE) <= 0.2::DOUBLE
     AND video_id % 5 <> audio_id % 5 AND own >= 0.75 AND other <= 0.4 AS ok FROM j""")
def _(spark, sf):
    """All gates on; a clip's reference is its voice with half of another vector on top."""
    n = table(spark, sf, "embeddings").count()
    pairs = frames.vectors(spark, sf).select(F.col("vec_id").alias("video_id"), ((F.col("vec_id") * 7 + 1) % n).alias("audio_id"))
    out = keyframes.check_pairs(pairs, _clips(spark, sf))
    return frames.rounded(frames.rounded(out, "own_similarity"), "other_similarity")


def _clips(spark, sf):
    reference = F.zip_with("a", "b", lambda x, y: x + F.lit(0.5) * y)
    return frames.vectors(spark, sf).select(
        F.col("vec_id").alias("clip_id"), (F.col("vec_id") % 5).alias("speaker"), F.col("label").alias("emotion"),
        F.col("a").alias("voice"), reference.alias("reference"), (F.col("label") / 10).alias("duration"))


def _ring(column: str, seed: int) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {column}, '{seed}')), 1, 10))::BIGINT"


@query("match_clips", f"""WITH RECURSIVE x AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v, {_ring('vec_id', 42)} AS turn,
      {_ring('vec_id', 43)} AS place,
      list_transform(range(1, 33), lambda i: embedding[i]::DOUBLE + 0.5::DOUBLE * embedding[32 + i]) AS ref FROM embeddings),
    g AS (SELECT s.id AS video_id, d.id AS audio_id, list_cosine_similarity(d.v[1:32], d.ref) AS own,
        list_cosine_similarity(d.v[1:32], s.ref) AS other, d.place < s.place AS lap, d.place
      FROM x s JOIN x d ON s.label <> d.label AND s.id % 5 <> d.id % 5
        AND abs(s.label / 10.0::DOUBLE - d.label / 10.0::DOUBLE) <= 0.2::DOUBLE WHERE own >= 0.75 AND other <= 0.4),
    l AS (SELECT video_id, list(audio_id ORDER BY lap, place, audio_id) AS wish FROM g GROUP BY video_id),
    o AS (SELECT x.id, row_number() OVER (ORDER BY turn, id) AS k, wish FROM x JOIN l ON x.id = l.video_id),
    t AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS video_id, NULL::BIGINT AS audio_id, []::BIGINT[] AS used
      UNION ALL
      SELECT k, video_id, audio_id, CASE WHEN audio_id IS NULL THEN used ELSE list_append(used, audio_id) END FROM (
        SELECT o.k, o.id AS video_id, t.used, list_filter(o.wish, lambda a: len(list_filter(t.used, lambda u: u = a)) < 2)[1] AS audio_id
        FROM t JOIN o ON o.k = t.k + 1))
  SELECT video_id, audio_id, round(own, 6) AS own_similarity, round(other, 6) AS other_similarity
  FROM t JOIN g USING (video_id, audio_id)""")
def _(spark, sf):
    """Every clip as a video, and as an audio for two videos at most; the SQL plays the turns."""
    out = pairing.match_clips(_clips(spark, sf), quota=2)
    return frames.rounded(frames.rounded(out, "own_similarity"), "other_similarity")
