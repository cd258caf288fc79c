"""Array functions on the embeddings, compared element by element."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.arrays import pad_to_max, pool_long
from .frames import ELEMENTS, long_form, vectors
from .registry import query, table

_MOMENTS = f"""{ELEMENTS}, m AS (SELECT vec_id, avg(x) AS mu, stddev_pop(x) AS sd FROM e GROUP BY vec_id)"""
_AB = """ab AS (SELECT vec_id, label, unnest(range(32)) AS pos, unnest(embedding[1:32])::DOUBLE AS a,
  unnest(embedding[33:64])::DOUBLE AS b FROM embeddings)"""


@query("zscore", f"""WITH {_MOMENTS} SELECT vec_id, pos::INTEGER AS pos, round((x - mu) / (sd + 1e-6), 6) AS value
  FROM e JOIN m USING (vec_id)""")
def _(spark, sf):
    return long_form(table(spark, sf, "embeddings"), "vec_id", V.zscore("embedding"))


@query("zscore_bands", f"""WITH {_MOMENTS} SELECT vec_id, (pos // 8)::INTEGER AS band, (pos % 8)::INTEGER AS pos,
  round((x - mu) / (sd + 1e-6), 6) AS value FROM e JOIN m USING (vec_id)""")
def _(spark, sf):
    bands = V.zscore_bands(_bands())
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(bands).alias("band", "row"))
    return (rows.select("vec_id", "band", F.posexplode("row").alias("pos", "value"))
            .withColumn("value", F.round("value", 6)))


def _bands(col="embedding"):
    """The 64 elements as 8 bands of 8 steps."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col(col), i * 8 + 1, 8))


@query("center_crop", f"""WITH {ELEMENTS}, c AS (SELECT vec_id, (pos - 7)::INTEGER AS pos, round(x, 6) AS value FROM e
  WHERE pos >= 7 AND pos < 57) SELECT * FROM c""")
def _(spark, sf):
    return long_form(table(spark, sf, "embeddings"), "vec_id", V.center_crop("embedding", 50))


@query("center_crop_pad", f"""WITH {ELEMENTS} SELECT vec_id, pos::INTEGER AS pos, round(x, 6) AS value FROM e
  UNION ALL SELECT vec_id, unnest(range(64, 70))::INTEGER, 0.0 FROM embeddings""")
def _(spark, sf):
    return long_form(table(spark, sf, "embeddings"), "vec_id", V.center_crop("embedding", 70))


def _draw(slot: int, below: str) -> str:
    return f"(('0x' || substr(md5(vec_id || ':7'), {8 * slot + 1}, 8))::BIGINT % ({below}))"


@query("seeded_crop", f"""WITH {ELEMENTS}, s AS (SELECT *, {_draw(0, '45')} AS st FROM e)
  SELECT vec_id, (pos - st)::INTEGER AS pos, round(x, 6) AS value FROM s WHERE pos >= st AND pos < st + 20""")
def _(spark, sf):
    return long_form(table(spark, sf, "embeddings"), "vec_id", V.seeded_crop("embedding", 20, "vec_id", 7))


@query("span_mask", f"""WITH e AS (SELECT vec_id, unnest(range(256)) AS pos,
    unnest(embedding || embedding || embedding || embedding)::DOUBLE AS x FROM embeddings),
  w AS (SELECT vec_id, {_draw(0, '2')} AS fw, {_draw(2, '2')} AS tw FROM embeddings),
  f AS (SELECT vec_id, fw, tw, {_draw(1, 'greatest(1, 16 - fw)')} AS f0, {_draw(3, 'greatest(1, 16 - tw)')} AS t0 FROM w)
  SELECT vec_id, (pos // 16)::INTEGER AS band, (pos % 16)::INTEGER AS pos, round(CASE WHEN
    (pos // 16 >= f0 AND pos // 16 < f0 + fw) OR (pos % 16 >= t0 AND pos % 16 < t0 + tw) THEN -80.0 ELSE x END, 6) AS value
  FROM e JOIN f USING (vec_id)""")
def _(spark, sf):
    """Four copies of the elements as 16 bands of 16 steps, so that both spans can have width."""
    many = F.concat("embedding", "embedding", "embedding", "embedding")
    rows = table(spark, sf, "embeddings").select("vec_id", many.alias("x"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("x", i * 16 + 1, 16))
    return _cells(rows.select("vec_id", F.posexplode(V.span_mask(grid, "vec_id", 7)).alias("band", "row")))


def _cells(rows):
    return (rows.select("vec_id", "band", F.posexplode("row").alias("pos", "value"))
            .withColumn("value", F.round("value", 6)))


@query("center_crop_bands", f"""WITH {ELEMENTS} SELECT vec_id, (pos // 8)::INTEGER AS band, (pos % 8 - 1)::INTEGER AS pos,
  round(x, 6) AS value FROM e WHERE pos % 8 >= 1 AND pos % 8 < 6""")
def _(spark, sf):
    cut = V.center_crop_bands(_bands(), 5)
    return _cells(table(spark, sf, "embeddings").select("vec_id", F.posexplode(cut).alias("band", "row")))


@query("seeded_crop_bands", f"""WITH {ELEMENTS}, s AS (SELECT *, {_draw(0, '4')} AS st FROM e)
  SELECT vec_id, (pos // 8)::INTEGER AS band, (pos % 8 - st)::INTEGER AS pos, round(x, 6) AS value
  FROM s WHERE pos % 8 >= st AND pos % 8 < st + 5""")
def _(spark, sf):
    cut = V.seeded_crop_bands(_bands(), 5, "vec_id", 7)
    return _cells(table(spark, sf, "embeddings").select("vec_id", F.posexplode(cut).alias("band", "row")))


@query("pad_bands", f"""WITH {ELEMENTS} SELECT vec_id, (pos // 8)::INTEGER AS band, (pos % 8)::INTEGER AS pos,
  round(x, 6) AS value, 8 AS length FROM e
  UNION ALL SELECT vec_id, band::INTEGER, pos::INTEGER, 0.0, 8
  FROM embeddings, range(8) b(band), range(8, 11) p(pos)""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", V.pad_bands(_bands(), 11).alias("p"))
    each = rows.select("vec_id", "p.length", F.posexplode("p.values").alias("band", "row"))
    return (each.select("vec_id", "band", "length", F.posexplode("row").alias("pos", "value"))
            .withColumn("value", F.round("value", 6)))


@query("pad_to_max", """WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
  m AS (SELECT conv_id, least(max(len(w)), 256) AS width FROM t GROUP BY conv_id),
  g AS (SELECT t.*, width, unnest(range(width)) AS pos FROM t JOIN m USING (conv_id))
  SELECT conv_id, turn, pos::INTEGER AS pos, least(len(w), width)::INTEGER AS length,
    (CASE WHEN pos < len(w) THEN length(w[pos + 1]) ELSE 0 END)::DOUBLE AS value FROM g""")
def _(spark, sf):
    lens = F.transform(F.split("text", " "), lambda w: F.length(w).cast("double"))
    t = table(spark, sf, "conversations").select("conv_id", "turn", lens.alias("w"))
    out = pad_to_max(t, "w", "conv_id", V.MAX_WIDTH)
    return out.select("conv_id", "turn", F.col("padded.length").alias("length"),
                      F.posexplode("padded.values").alias("pos", "value"))


@query("pad_with_mask", """WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
  g AS (SELECT *, unnest(range(8)) AS pos FROM t)
  SELECT conv_id, turn, pos::INTEGER AS pos, pos < len(w) AS mask,
    (CASE WHEN pos < len(w) THEN length(w[pos + 1]) ELSE 0 END)::DOUBLE AS value FROM g""")
def _(spark, sf):
    lens = F.transform(F.split("text", " "), lambda w: F.length(w).cast("double"))
    t = table(spark, sf, "conversations").select("conv_id", "turn", V.pad_with_mask(lens).alias("s"))
    z = F.arrays_zip(F.col("s.values").alias("value"), F.col("s.mask").alias("mask"))
    rows = t.select("conv_id", "turn", F.posexplode(z).alias("pos", "z"))
    return rows.select("conv_id", "turn", "pos", "z.value", "z.mask")


@query("renorm", f"""WITH {_AB}, k AS (SELECT *, CASE WHEN b > 0 THEN abs(a) ELSE 0 END AS w FROM ab)
  SELECT vec_id, pos::INTEGER AS pos, round(w / greatest(sum(w) OVER (PARTITION BY vec_id), 1e-8), 6) AS value FROM k""")
def _(spark, sf):
    v = vectors(spark, sf)
    w = V.renorm(F.transform("a", F.abs), F.transform("b", lambda x: x > 0))
    return long_form(v, "vec_id", w)


_STEPS = f"""{ELEMENTS}, q AS (SELECT vec_id, pos // 16 AS k, pos % 16 AS j, x FROM e)"""


def _steps():
    """Four vectors of 16 elements each."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("v", i * 16 + 1, 16))


@query("weighted_pool", f"""WITH {_STEPS} SELECT vec_id, j::INTEGER AS pos, round(sum(x * (k + 1) / 10.0), 6) AS value
  FROM q GROUP BY vec_id, j""")
def _(spark, sf):
    w = F.array(*[F.lit(i / 10) for i in range(1, 5)])
    return long_form(vectors(spark, sf), "vec_id", V.weighted_pool(_steps(), w))


@query("weighted_pool_long", f"""WITH {ELEMENTS} SELECT label, pos::INTEGER AS pos, round(sum(x * vec_id / 1000.0), 6) AS value
  FROM e GROUP BY label, pos""")
def _(spark, sf):
    out = pool_long(table(spark, sf, "embeddings"), "label", "embedding", F.col("vec_id") / 1000)
    return out.withColumn("value", F.round("value", 6))


@query("masked_mean", f"""WITH {_STEPS} SELECT vec_id, j::INTEGER AS pos, round(coalesce(sum(CASE WHEN k < label % 5 THEN x END), 0)
  / greatest(count_if(k < label % 5), 1), 6) AS value FROM q JOIN embeddings USING (vec_id) GROUP BY vec_id, j""")
def _(spark, sf):
    pad = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: k >= F.col("label") % 5)
    out = long_form(vectors(spark, sf), "vec_id", V.masked_mean(_steps(), pad))
    return out.withColumn("value", F.col("value") + F.lit(0.0))


@query("vsum", f"WITH {_AB} SELECT vec_id, pos::INTEGER AS pos, round(a + b, 6) AS value FROM ab")
def _(spark, sf):
    return long_form(vectors(spark, sf), "vec_id", V.vsum("a", "b"))


@query("fuse", f"""WITH {_AB} SELECT vec_id, (pos + 32 * q)::INTEGER AS pos, round(CASE q WHEN 0 THEN a WHEN 1 THEN b
  WHEN 2 THEN abs(a - b) ELSE a * b END, 6) AS value FROM ab, range(4) t(q)""")
def _(spark, sf):
    return long_form(vectors(spark, sf), "vec_id", V.fuse("a", "b"))


@query("l2", f"WITH {_AB} SELECT vec_id, round(sqrt(sum((a - b) ** 2)), 6) AS value FROM ab GROUP BY vec_id")
def _(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(V.l2("a", "b"), 6).alias("value"))


@query("softmax", f"""WITH {ELEMENTS} SELECT vec_id, pos::INTEGER AS pos, round(exp(5 * x) /
  sum(exp(5 * x)) OVER (PARTITION BY vec_id), 6) AS value FROM e""")
def _(spark, sf):
    return long_form(table(spark, sf, "embeddings"), "vec_id", V.softmax("embedding", 5.0))


_NAMES = ["n0", "n1", "n2", "n3", "n4", "n5"]


@query("class_delta", f"""WITH {_AB}, d AS (SELECT vec_id, pos, abs(round(a, 4) - round(b, 4)) AS v FROM ab WHERE pos < 6)
  SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY round(v, 4) DESC, pos) - 1)::INTEGER AS pos,
    'n' || pos AS key, round(v, 4) AS value FROM d""")
def _(spark, sf):
    v = vectors(spark, sf)
    delta = V.class_delta(V.score_map(F.slice("a", 1, 6), _NAMES), V.score_map(F.slice("b", 1, 6), _NAMES))
    rows = v.select("vec_id", F.posexplode(V.entries_desc(delta, _NAMES)).alias("pos", "e"))
    return rows.select("vec_id", "pos", "e.key", "e.value")


@query("argmax", """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS top,
  'n' || (list_position(embedding[1:6], list_max(embedding[1:6])) - 1) AS key FROM embeddings""")
def _(spark, sf):
    scores = V.score_map(F.slice("embedding", 1, 6), _NAMES, None)
    return table(spark, sf, "embeddings").select(
        "vec_id", V.argmax("embedding").alias("top"), V.argmax_key(scores, _NAMES).alias("key"))


@query("bad_value", """SELECT vec_id, CASE WHEN label IN (1, 3) THEN 'NaN' WHEN label = 2 THEN 'Inf' END AS issue
  FROM embeddings""")
def _(spark, sf):
    nan, inf = F.lit(float("nan")), F.lit(float("-inf"))
    extra = (F.when(F.col("label") == 1, F.array(nan)).when(F.col("label") == 2, F.array(inf))
             .when(F.col("label") == 3, F.array(inf, nan)).otherwise(F.array(F.lit(0.0))))
    arr = F.concat(V.doubles("embedding"), extra)
    return table(spark, sf, "embeddings").select("vec_id", V.bad_value(arr).alias("issue"))


@query("uniform", """SELECT vec_id, count(*)::BIGINT AS n, round(max(w), 6) AS w, round(sum(w), 6) AS total FROM (
  SELECT vec_id, 1.0::DOUBLE / (label + 1) AS w, unnest(range(label + 1)) FROM embeddings) GROUP BY vec_id""")
def _(spark, sf):
    u = V.uniform(F.col("label") + 1)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size(u).cast("bigint").alias("n"), F.round(F.array_max(u), 6).alias("w"),
        F.round(V.total(u), 6).alias("total"))


@query("flatten_cast", f"""WITH {ELEMENTS} SELECT vec_id, pos::INTEGER AS pos, trunc(x * 1000)::BIGINT AS value FROM e""")
def _(spark, sf):
    scaled = F.transform(_bands(), lambda r: F.transform(r, lambda x: x.cast("double") * 1000))
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.flat_long(scaled)).alias("pos", "value"))
    return rows
