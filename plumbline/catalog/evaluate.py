"""Multi-class and binary evaluation, scoring, verdicts, held-out subgroup tables."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F

from ..functions.scores import verdict
from ..operators import binary, classify, scoring
from ..plans import curation
from ..session import shared_dir
from ..streaming import intake
from . import frames
from .frames import PREDICTIONS, RATES, SCORES, auc_sql, f1_sql, named_parts, one_vs_sql, rounded
from .registry import query, table

_HELD = f"""{SCORES},
  g AS (SELECT source, row_number() OVER (ORDER BY md5(concat_ws(':', source, '42')), source) AS rk,
          count(*) OVER () AS n FROM (SELECT DISTINCT source FROM s)),
  gp AS (SELECT source, {named_parts('part', 'rk', 'n', 'round_even')} FROM g),
  h AS (SELECT s.* FROM s JOIN gp USING (source) WHERE part = 'test')"""
_FIGURES = ("acc", "precision", "recall", "f1", "auc")


@query("heldout_by_subgroup", one_vs_sql("h", _HELD))
def heldout_by_subgroup(spark, sf):
    """Leakage-free evaluation: held-out sources only, every forged kind against genuine."""
    out = curation.heldout_evaluation(frames.scores(spark, sf), "source", "lang", "ptype", "y", "p")
    return rounded(out, *_FIGURES)


@query("one_vs_genuine", one_vs_sql("s", SCORES))
def _(spark, sf):
    return rounded(binary.one_vs_reference(frames.scores(spark, sf), "lang", "ptype", "y", "p"), *_FIGURES)


@query("binary_metrics", f"""WITH {SCORES}, m AS (SELECT lang, count_if(p >= 0.5 AND y = 1)::BIGINT AS tp,
   count_if(p < 0.5 AND y = 0)::BIGINT AS tn, count_if(p >= 0.5 AND y = 0)::BIGINT AS fp,
   count_if(p < 0.5 AND y = 1)::BIGINT AS fn, {RATES} FROM s GROUP BY lang)
   SELECT lang, tp, tn, fp, fn, n, round(acc, 6) AS acc, round(precision, 6) AS precision,
     round(recall, 6) AS recall, round({f1_sql()}, 6) AS f1 FROM m""")
def _(spark, sf):
    out = binary.binary_metrics(frames.scores(spark, sf), "y", "p", by=["lang"])
    return rounded(out, "acc", "precision", "recall", "f1")


@query("auc", f"WITH {SCORES} SELECT round(auc, 9) AS auc, n_pos, n_neg FROM ({auc_sql('s')})")
def _(spark, sf):
    return rounded(binary.auc(frames.scores(spark, sf), "y", "p"), "auc", digits=9)


@query("auc_by", f"WITH {SCORES} SELECT source, round(auc, 9) AS auc, n_pos, n_neg FROM ({auc_sql('s', 'source')})")
def _(spark, sf):
    return rounded(binary.auc(frames.scores(spark, sf), "y", "p", ["source"]), "auc", digits=9)


def _roc_sql(cte: str) -> str:
    # A rate without rows to divide by is NULL, as in the operator.
    return f"""SELECT ptype, p AS threshold, round(cn / nullif(n_neg, 0), 6) AS fpr,
      round(cp / nullif(n_pos, 0), 6) AS tpr FROM (
      SELECT ptype, p, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY ptype) AS n_pos,
        sum(neg) OVER (PARTITION BY ptype) AS n_neg FROM (SELECT ptype, p, count_if(y = 1)::DOUBLE AS pos,
          count_if(y = 0)::DOUBLE AS neg FROM {cte} GROUP BY ptype, p)
      WINDOW w AS (PARTITION BY ptype ORDER BY p DESC))
    UNION ALL SELECT DISTINCT ptype, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM {cte}"""


@query("roc_points", f"WITH {SCORES}, x AS (SELECT lang AS ptype, y, p FROM s) SELECT ptype AS lang, * EXCLUDE ptype "
       f"FROM ({_roc_sql('x')})")
def _(spark, sf):
    return rounded(binary.roc_points(frames.scores(spark, sf), "y", "p", ["lang"]), "fpr", "tpr")


@query("roc_by_kind", f"""WITH {SCORES}, k AS (SELECT DISTINCT ptype FROM s WHERE y = 1),
  x AS (SELECT k.ptype, s.y, s.p FROM k JOIN s ON s.ptype = k.ptype OR s.y = 0
        UNION ALL SELECT 'all pairs', y, p FROM s) {_roc_sql('x')}""")
def _(spark, sf):
    return rounded(binary.roc_by_kind(frames.scores(spark, sf), "ptype", "y", "p"), "fpr", "tpr")


@query("confusion_by", f"""WITH {SCORES} SELECT ptype, count_if(p < 0.5)::BIGINT AS pred_genuine,
  count_if(p >= 0.5)::BIGINT AS pred_fake, round(count_if(p < 0.5) / count(*), 6) AS share_genuine,
  round(count_if(p >= 0.5) / count(*), 6) AS share_fake FROM s GROUP BY ptype""")
def _(spark, sf):
    out = binary.confusion_by(frames.scores(spark, sf), "ptype", "p")
    return rounded(out, "share_genuine", "share_fake")


@query("log_loss", f"""WITH {SCORES}, x AS (SELECT lang, y, ln(p / (1 - p)) AS x FROM s)
  SELECT lang, round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS loss, count(*)::BIGINT AS n
  FROM x GROUP BY lang""")
def _(spark, sf):
    logit = F.log(F.col("p") / (1 - F.col("p")))
    s = frames.scores(spark, sf).withColumn("logit", logit)
    return rounded(binary.log_loss(s, "y", "logit", ["lang"]), "loss")


# -- multi-class -----------------------------------------------------------------------

_GRID = "SELECT unnest(range(10))::INTEGER AS c"


@query("confusion", f"""WITH {PREDICTIONS}, g AS (SELECT a.c AS y, b.c AS pred FROM ({_GRID}) a, ({_GRID}) b)
  SELECT g.y, g.pred, count(vec_id)::BIGINT AS n FROM g LEFT JOIN pr ON pr.y = g.y AND pr.pred = g.pred GROUP BY ALL""")
def _(spark, sf):
    return classify.confusion(frames.predictions(spark, sf), "y", "pred", 10)


@query("confusion_normalized", f"""WITH {PREDICTIONS}, d AS (SELECT DISTINCT dataset FROM pr),
  g AS (SELECT dataset, a.c AS y, b.c AS pred FROM d, ({_GRID}) a, ({_GRID}) b),
  n AS (SELECT g.*, count(vec_id)::BIGINT AS n FROM g LEFT JOIN pr USING (dataset, y, pred) GROUP BY ALL)
  SELECT *, round(n / greatest(sum(n) OVER (PARTITION BY dataset, y), 1), 6) AS share FROM n""")
def _(spark, sf):
    out = classify.confusion(frames.predictions(spark, sf), "y", "pred", 10, ["dataset"], True)
    return rounded(out, "share")


@query("accuracy", f"""WITH {PREDICTIONS} SELECT dataset, round(avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END), 6) AS acc,
  count(*)::BIGINT AS n FROM pr GROUP BY dataset""")
def _(spark, sf):
    return rounded(classify.accuracy(frames.predictions(spark, sf), "y", "pred", ["dataset"]), "acc")


def _prf_sql(classes: int, by: bool = False) -> str:
    d = "dataset" if by else "'all'"
    return f"""{PREDICTIONS}, b AS (SELECT {d} AS dataset, y, pred FROM pr),
      g AS (SELECT dataset, unnest(range({classes}))::INTEGER AS class FROM (SELECT DISTINCT dataset FROM b)),
      f0 AS (SELECT g.dataset, g.class, count_if(b.y = class AND b.pred = class) AS tp,
        count_if(b.pred = class) AS pp, count_if(b.y = class)::BIGINT AS support
        FROM g JOIN b USING (dataset) GROUP BY ALL),
      f AS (SELECT *, tp / greatest(pp, 1) AS precision, tp / greatest(support, 1) AS recall FROM f0),
      prf AS (SELECT *, {f1_sql()} AS f1 FROM f)"""


@query("per_class_prf", f"""WITH {_prf_sql(11)} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM prf""")
def _(spark, sf):
    out = classify.per_class_prf(frames.predictions(spark, sf), "y", "pred", 11)
    return rounded(out, "precision", "recall", "f1")


@query("per_class_accuracy", f"""WITH {_prf_sql(11, True)} SELECT dataset, class, round(recall, 6) AS acc,
  greatest(support, 1)::BIGINT AS n FROM prf""")
def _(spark, sf):
    out = classify.per_class_accuracy(frames.predictions(spark, sf), "y", "pred", 11, ["dataset"])
    return rounded(out, "acc")


@query("f1_scores", f"""WITH {_prf_sql(11)} SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
  round(avg(f1), 6) AS macro_f1, round(sum(tp) / sum(support), 6) AS acc, sum(support)::BIGINT AS n FROM prf""")
def _(spark, sf):
    out = classify.f1_scores(frames.predictions(spark, sf), "y", "pred", 11)
    return rounded(out, "weighted_f1", "macro_f1", "acc")


@query("count_unscored", """SELECT lang, 0::BIGINT AS n_no_score, count_if(l.doc_id IS NULL)::BIGINT AS n_no_label,
  count_if(l.doc_id IS NULL)::BIGINT AS n_dropped, count(*)::BIGINT AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def _(spark, sf):
    """Documents that have no label are what score tables of all documents would leave out."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") / 1000).alias("p"))
    return binary.count_unscored(docs.join(labels, "doc_id", "left"), "quality", "p", ["lang"])


@query("summary", f"""WITH {_prf_sql(10, True)}, m AS (SELECT dataset, 100 * sum(tp) / sum(support) AS acc_pct,
    sum(f1 * support) / sum(support) AS weighted_f1, sum(support)::BIGINT AS n FROM prf GROUP BY dataset)
  SELECT r_name AS dataset, NULL::DOUBLE AS acc_pct, NULL::DOUBLE AS weighted_f1, 0::BIGINT AS n FROM region
  UNION ALL SELECT dataset, round(acc_pct, 6), round(weighted_f1, 6), n FROM m""")
def _(spark, sf):
    pr = frames.predictions(spark, sf)
    # Regions are expected datasets without any scored rows.
    expected = pr.select("dataset").unionByName(
        table(spark, sf, "region").select(F.col("r_name").alias("dataset")))
    return rounded(classify.summary(pr, "y", "pred", 10, ["dataset"], expected), "acc_pct", "weighted_f1")


@query("cross_entropy", f"""WITH {PREDICTIONS}, l AS (SELECT dataset, y, logits::DOUBLE[] AS v FROM pr)
  SELECT dataset, round(avg(ln(list_sum(list_transform(v, lambda x: exp(x)))) - v[y + 1]), 6) AS loss,
    count(*)::BIGINT AS n FROM l GROUP BY dataset""")
def _(spark, sf):
    return rounded(classify.cross_entropy(frames.predictions(spark, sf), "y", "logits", ["dataset"]), "loss")


# -- scoring -----------------------------------------------------------------------------

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _load_mean_model():
    """A stand-in model: the mean of a vector, squashed."""
    import numpy as np
    import pandas as pd

    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        m = np.array([np.asarray(v, dtype=np.float64).mean() for v in batch["embedding"]])
        return pd.DataFrame({"vec_id": batch["vec_id"], "y": (batch["label"] >= 5).astype("int32"),
                             "p": 1.0 / (1.0 + np.exp(-8.0 * m))})
    return predict


_SCORE_SCHEMA = "vec_id bigint, y int, p double"
_SCORED = """m AS (SELECT vec_id, label, list_sum(embedding::DOUBLE[]) / 64 AS m FROM embeddings),
  sc AS (SELECT vec_id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, 1 / (1 + exp(-8 * m)) AS p FROM m)"""


@query("score", f"WITH {_SCORED} SELECT vec_id, y, round(p, 6) AS p FROM sc")
def _(spark, sf):
    out = scoring.score(table(spark, sf, "embeddings"), "mean", _load_mean_model, _SCORE_SCHEMA,
                        ["vec_id", "embedding", "label"])
    return rounded(out, "p")



@query("verdict_record", """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  z AS (SELECT vec_id, v, list_transform(v[1:6], lambda q: exp(q)) AS ea, list_transform(v[33:38], lambda q: exp(q)) AS eb
        FROM x),
  s AS (SELECT vec_id, v, list_transform(ea, lambda q: round(q / list_sum(ea), 4)) AS a,
               list_transform(eb, lambda q: round(q / list_sum(eb), 4)) AS b FROM z),
  d AS (SELECT *, list_transform(range(1, 7), lambda i: round(abs(a[i] - b[i]), 4)) AS dl FROM s),
  n AS (SELECT *, ['Angry', 'Disgust', 'Fearful', 'Happy', 'Neutral', 'Sad'] AS names,
          1 / (1 + exp(-v[1])) AS p FROM d)
  SELECT vec_id, round(p, 4) AS fake_prob, CASE WHEN p >= 0.5 THEN 'FAKE' ELSE 'GENUINE' END AS verdict,
    names[list_position(dl, list_max(dl))] AS emotion, list_max(dl) AS delta,
    names[list_position(a, list_max(a))] AS audio_dominant, names[list_position(b, list_max(b))] AS visual_dominant,
    round(sqrt(list_sum(list_transform(range(1, 33), lambda i: (v[i] - v[i + 32]) ** 2))), 4) AS discrepancy_l2,
    a[4] AS happy FROM n""")
def _(spark, sf):
    v = frames.vectors(spark, sf)
    rec = scoring.verdict_record(
        v.withColumn("logit", F.get("v", F.lit(0))).withColumn("la", F.slice("a", 1, 6))
        .withColumn("lb", F.slice("b", 1, 6)), "logit", "la", "lb", "a", "b")
    return rec.select("vec_id", "fake_prob", "verdict", "dominant_mismatch.*", "discrepancy_l2",
                      F.try_element_at("audio_emotion", F.lit("Happy")).alias("happy"))


def _load_heads():
    """A stand-in model with two heads: the halves of a vector, and a logit from their mean."""
    import numpy as np
    import pandas as pd

    def predict(batch: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(batch["embedding"]).astype(np.float64) if len(batch) else np.zeros((0, 64))
        a, b = v[:, :32], v[:, 32:]
        return pd.DataFrame({"vec_id": batch["vec_id"], "logit": 8.0 * v.mean(axis=1), "la": list(a[:, :6]),
                             "lb": list(b[:, :6]), "za": list(a), "zb": list(b)})
    return predict


_HEADS_SCHEMA = "vec_id bigint, logit double, la array<double>, lb array<double>, za array<double>, zb array<double>"
_MAPS = (("audio_emotion", "a"), ("visual_emotion", "b"), ("per_class_delta", "dl"))
_MAP_COLUMNS = ", ".join(f"{c}[{i}] AS {name}_{e.lower()}" for name, c in _MAPS
                         for i, e in enumerate(scoring.EMOTIONS, 1))


@query("intake_stream", f"""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label < 5),
  z AS (SELECT vec_id, v, list_transform(v[1:6], lambda q: exp(q)) AS ea, list_transform(v[33:38], lambda q: exp(q)) AS eb
        FROM x),
  s AS (SELECT vec_id, v, list_transform(ea, lambda q: round(q / list_sum(ea), 4)) AS a,
               list_transform(eb, lambda q: round(q / list_sum(eb), 4)) AS b FROM z),
  d AS (SELECT *, list_transform(range(1, 7), lambda i: round(abs(a[i] - b[i]), 4)) AS dl,
          {scoring.EMOTIONS} AS names, 1 / (1 + exp(-8 * list_sum(v) / 64)) AS p FROM s)
  SELECT vec_id, round(p, 4) AS fake_prob, CASE WHEN p >= 0.5 THEN 'FAKE' ELSE 'GENUINE' END AS verdict, {_MAP_COLUMNS},
    names[list_position(dl, list_max(dl))] AS emotion, list_max(dl) AS delta,
    names[list_position(a, list_max(a))] AS audio_dominant, names[list_position(b, list_max(b))] AS visual_dominant,
    round(sqrt(list_sum(list_transform(range(1, 33), lambda i: (v[i] - v[i + 32]) ** 2))), 4) AS discrepancy_l2,
    CASE WHEN vec_id % 3 = 0 THEN '[inaudible]' ELSE 'clip ' || vec_id END AS transcript, NULL AS reject_reason FROM d
  UNION ALL BY NAME SELECT vec_id, 'unsupported format' AS reject_reason FROM embeddings WHERE label >= 5""")
def _(spark, sf):
    """The whole embeddings table as a file stream; rows of labels from 5 up are not clips.
    Each row is answered from one read: with the full verdict record, or with the reason why
    it was refused."""
    root = f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}"
    schema = table(spark, sf, "embeddings").schema
    # A pattern, as a stream takes no single file as its path: it finds the table as one file
    # and as a folder of part files alike.
    stream = spark.readStream.schema(schema).parquet(f"{sf}/embeddings.parque[t]")
    name = F.when(F.col("label") < 5, F.lit("clip.mp4")).otherwise(F.lit("notes.txt"))
    arrivals = stream.withColumn("path", name).withColumn("length", F.size("embedding") * 4)

    def judge(df):
        heads = scoring.score(df, "heads", _load_heads, _HEADS_SCHEMA, ["vec_id", "embedding"])
        spoken = heads.withColumn("spoken", F.when(F.col("vec_id") % 3 != 0, F.concat(
            F.lit("clip "), F.col("vec_id").cast("string"))).otherwise(F.lit(" ")))
        record = scoring.verdict_record(spoken, "logit", "la", "lb", "za", "zb", "spoken")
        return record.drop("logit", "la", "lb", "za", "zb", "spoken")

    intake.route_stream(arrivals, judge, root, f"{root}/state", ["vec_id"]).awaitTermination()
    answered = intake.routed(spark, root)
    maps = [F.try_element_at(F.col(c), F.lit(e)).alias(f"{c}_{e.lower()}") for c, _ in _MAPS for e in scoring.EMOTIONS]
    return answered.select("vec_id", "fake_prob", "verdict", *maps, "dominant_mismatch.*", "discrepancy_l2",
                           "transcript", "reject_reason")
