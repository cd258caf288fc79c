"""How the tables stand in for manifests, assets and scores, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import GENUINE, SPLICED, TAMPERED, pair_type
from ..functions.vectors import argmax, doubles
from ..sources.manifests import ManifestSource
from .registry import table

CORPUS = ManifestSource("corpus", "/corpus", "manifest.csv", "file_id", ("train", "dev", "test"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Binary score table: labelled documents; the score grows with their length."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf, "labels")
    n = F.col("n_chars").cast("double")
    return docs.join(labels, "doc_id").select(
        "doc_id", "source", "lang", "toxic", F.col("quality").alias("y"),
        (n / (n + 1000.0)).alias("p"), "n_chars",
        pair_type("quality", "toxic", 0).alias("ptype"))


SCORES = f"""s AS (
  SELECT d.doc_id, d.source, d.lang, l.toxic, l.quality AS y, d.n_chars,
         d.n_chars::DOUBLE / (d.n_chars::DOUBLE + 1000) AS p,
         CASE WHEN l.quality = 0 THEN '{GENUINE}' WHEN l.toxic = 0 THEN '{TAMPERED}'
              ELSE '{SPLICED}' END AS ptype
  FROM documents d JOIN labels l USING (doc_id))"""


def file_id() -> Column:
    """Document id in manifest form; every third document is a splice."""
    donor = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(
        "", F.lit("___"), F.concat_ws("_", F.col("lang"), F.col("n_chars").cast("string"))))
    return F.concat(F.concat_ws("_", "source", F.col("doc_id").cast("string")),
                    F.coalesce(donor, F.lit("")))


FILE_ID = ("source || '_' || doc_id || CASE WHEN doc_id % 3 = 0 "
           "THEN '___' || lang || '_' || n_chars ELSE '' END")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-class predictions: the first ten dimensions are class scores."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").alias("y"),
                    F.slice("embedding", 1, 10).alias("logits"),
                    argmax(F.slice("embedding", 1, 10)).alias("pred"),
                    F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("dataset"))


PREDICTIONS = """pr AS (
  SELECT vec_id, label AS y, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred,
         embedding[1:10] AS logits,
         CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset FROM embeddings)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as doubles, with the halves that stand for two modalities."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", doubles("embedding").alias("v"))
    return e.select("vec_id", "label", "v", F.slice("v", 1, 32).alias("a"),
                    F.slice("v", 33, 32).alias("b"))


ELEMENTS = """e AS (
  SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


def long_form(df: DataFrame, key: str, arr: Column | str, digits: int = 6) -> DataFrame:
    """(key, pos, value) of an array column, rounded for comparison."""
    return (df.select(key, F.posexplode(arr).alias("pos", "value"))
            .withColumn("value", F.round("value", digits)))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """A file listing: documents have audio, labels text, embeddings frames.

    Audio lies in train or dev, text in train and for toxic rows also in dev, frames
    in dev for every third vector and otherwise in train.
    """
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels")
    vecs = table(spark, sf, "embeddings").select("vec_id", "label")
    audio = docs.select(F.concat(
        F.when(F.col("doc_id") % 2 == 0, "/corpus/train").otherwise("/corpus/dev"),
        F.lit("/audio/"), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 5 == 0, ".flv_melspec.npy").otherwise("_melspec.npy")).alias("path"))
    both = F.when(F.col("toxic") == 1, F.array(F.lit("train"), F.lit("dev"))).otherwise(
        F.array(F.lit("train")))
    where = labels.withColumn("base", F.explode(both))
    text = where.select(F.explode(F.array(*[
        F.concat(F.lit("file:///corpus/"), F.col("base"), F.lit("/text/"),
                 F.col("doc_id").cast("string"), F.lit(f"_{k}.npy"))
        for k in ("input_ids", "attention_mask")])).alias("path"))
    folder = F.concat(F.when(F.col("vec_id") % 3 == 0, "/corpus/dev").otherwise("/corpus/train"),
                      F.lit("/visual/"), F.col("vec_id").cast("string"))
    files = F.concat(
        F.transform(F.sequence(F.lit(1), F.col("label") + 1),
                    lambda i: F.concat(F.lit("frame_"), i.cast("string"), F.lit(".jpg"))),
        F.when(F.col("label") < 3, F.array(F.lit("attention_weights.json")))
        .when(F.col("label") < 6, F.array(F.lit("attention_weights.json"),
                                          F.lit("keyframe_weights.npy")))
        .otherwise(F.array().cast("array<string>")))
    visual = vecs.select(F.explode(F.transform(
        files, lambda f: F.concat(folder, F.lit("/"), f))).alias("path"))
    return audio.unionByName(text).unionByName(visual)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.lit("corpus").alias("source"), F.col("doc_id").cast("string").alias("file_id"))


#: The listing reduced to (base, rank, id) with one flag per modality.
ASSETS = """
au AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS r,
              CASE WHEN doc_id % 5 = 0 THEN '.flv_melspec.npy' ELSE '_melspec.npy' END AS suffix
       FROM documents),
tx AS (SELECT doc_id AS id, 0 AS r FROM labels
       UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1),
vi AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS r, label FROM embeddings),
al AS (SELECT id, r FROM au UNION SELECT id, r FROM tx UNION SELECT id, r FROM vi),
af AS (SELECT al.id, al.r, au.id IS NOT NULL AS has_audio, tx.id IS NOT NULL AS has_text,
              vi.id IS NOT NULL AS has_visual, vi.label, au.suffix
       FROM al LEFT JOIN au USING (id, r) LEFT JOIN tx USING (id, r) LEFT JOIN vi USING (id, r))"""


def named_parts(key: str, rank: str, n: str, rounding: str = "floor") -> str:
    """SQL CASE for train / val / test from a 1-based rank and a total."""
    first = f"{rounding}({n} * 0.8::DOUBLE{', 0' if rounding == 'round_even' else ''})"
    second = f"{rounding}({n} * 0.1::DOUBLE{', 0' if rounding == 'round_even' else ''})"
    return (f"CASE WHEN {rank} <= {first} THEN 'train' "
            f"WHEN {rank} <= {first} + {second} THEN 'val' ELSE 'test' END AS {key}")


def auc_sql(cte: str, by: str = "") -> str:
    """Mid-rank AUC of a CTE with columns y, p (and group columns)."""
    part = f"PARTITION BY {by}" if by else ""
    tie = f"PARTITION BY {by}, p" if by else "PARTITION BY p"
    cols, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {cols}
      (sum(CASE WHEN y = 1 THEN rk END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
        / nullif(count_if(y = 1)::DOUBLE * count_if(y = 0)::DOUBLE, 0) AS auc,
      count_if(y = 1)::BIGINT AS n_pos, count_if(y = 0)::BIGINT AS n_neg
    FROM (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER ({tie}) - 1) / 2.0 AS rk
          FROM {cte}) {group}"""


RATES = """count(*)::BIGINT AS n,
  avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END) AS acc,
  count_if(p >= 0.5 AND y = 1) / greatest(count_if(p >= 0.5), 1) AS precision,
  count_if(p >= 0.5 AND y = 1) / greatest(count_if(y = 1), 1) AS recall"""


def f1_sql(pr: str = "precision", rc: str = "recall") -> str:
    return f"2 * {pr} * {rc} / greatest({pr} + {rc}, 1e-8)"


def one_vs_sql(cte: str, ctes: str) -> str:
    """Subgroup table of a CTE with doc_id, lang, ptype, y, p."""
    return f"""WITH {ctes},
    kinds AS (SELECT DISTINCT lang, ptype FROM {cte} WHERE ptype <> '{GENUINE}'),
    x AS (SELECT k.lang, k.ptype, c.y, c.p FROM kinds k JOIN {cte} c
            ON c.lang = k.lang AND (c.ptype = k.ptype OR c.y = 0)),
    m AS (SELECT lang, ptype, {RATES} FROM x GROUP BY lang, ptype),
    a AS ({auc_sql('x', 'lang, ptype')}),
    tm AS (SELECT {RATES} FROM {cte}), ta AS ({auc_sql(cte)})
    SELECT lang, ptype, n, round(acc, 6) AS acc, round(precision, 6) AS precision,
           round(recall, 6) AS recall, round({f1_sql()}, 6) AS f1, round(auc, 6) AS auc
    FROM m JOIN a USING (lang, ptype)
    UNION ALL
    SELECT lang, ptype, count(*)::BIGINT, round(avg(CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END), 6),
           NULL, NULL, NULL, NULL
    FROM {cte} WHERE ptype = '{GENUINE}' GROUP BY lang, ptype
    UNION ALL
    SELECT 'OVERALL', 'all pairs', n, round(acc, 6), round(precision, 6), round(recall, 6),
           round({f1_sql()}, 6), round(auc, 6) FROM tm, ta"""


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df
