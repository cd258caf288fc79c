"""Model scoring over tables, verdict records, and a consistency head on fused vectors."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import DISPLAY_NAMES, SIX_CLASSES, text_or_default
from ..functions.scores import sigmoid, verdict
from ..functions.vectors import (
    argmax_key,
    class_delta,
    fuse,
    l2,
    score_map,
    softmax,
)

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Models loaded by this Python worker.
_MODELS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def _worker_models() -> dict[str, Callable[[pd.DataFrame], pd.DataFrame]]:
    """The model cache of this worker; it outlives a task where the package is installed."""
    try:
        from plumbline.operators import scoring
        return scoring._MODELS
    except ImportError:
        return _MODELS


EMOTIONS = [DISPLAY_NAMES[c] for c in SIX_CLASSES]


def score(df: DataFrame, name: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
          schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Score batches with a user model, on static and streaming frames alike.

    ``load`` builds the model; it runs once per Python worker for a ``name`` and the code and
    data of ``load`` itself, so another loader under the same name is another model, or once
    per task on executors without this package.  The model maps a pandas batch to one with the given ``schema``.  Only ``columns`` are
    sent to Python; ``spark.sql.execution.arrow.maxRecordsPerBatch`` is the batch size.
    """
    key = f"{name}:{hashlib.sha256(cloudpickle.dumps(load)).hexdigest()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = _worker_models()
        if key not in models:
            models[key] = load()
        model = models[key]
        for batch in batches:
            yield model(batch)

    sent = df.select(*columns) if columns else df
    return sent.mapInPandas(run, schema)


def verdict_record(df: DataFrame, logit: str, audio_logits: str, visual_logits: str,
                   z_a: str, z_v: str, transcript: str | None = None,
                   names: Sequence[str] = tuple(EMOTIONS), digits: int = 4) -> DataFrame:
    """Per-row verdict: probability, score maps, largest mismatch, embedding distance.

    The delta is taken between the rounded score maps; the verdict looks at the
    probability before rounding.
    """
    text = text_or_default(transcript) if transcript else F.lit("")
    base = (df.withColumn("_p", sigmoid(logit))
            .withColumn("audio_emotion", score_map(softmax(audio_logits), names, digits))
            .withColumn("visual_emotion", score_map(softmax(visual_logits), names, digits))
            .withColumn("per_class_delta", class_delta("audio_emotion", "visual_emotion", digits))
            .withColumn("_top", argmax_key("per_class_delta", names)))
    mismatch = F.struct(
        F.col("_top").alias("emotion"),
        F.try_element_at(F.col("per_class_delta"), F.col("_top")).alias("delta"),
        argmax_key("audio_emotion", names).alias("audio_dominant"),
        argmax_key("visual_emotion", names).alias("visual_dominant"))
    return (base.withColumn("fake_prob", F.round("_p", digits))
            .withColumn("verdict", verdict("_p"))
            .withColumn("dominant_mismatch", mismatch)
            .withColumn("discrepancy_l2", F.round(l2(z_a, z_v), digits))
            .withColumn("transcript", text).drop("_p", "_top"))


def fused_features(a: Column | str, b: Column | str) -> Column:
    return array_to_vector(fuse(a, b))


def fit_head(train: DataFrame, a: str, b: str, label: str, layers: Sequence[int] = (),
             seed: int = 42, max_iter: int = 50):
    """Fit a binary head on the fused pair of vectors.

    ``layers`` are the hidden sizes of a multilayer perceptron; without any, a
    logistic regression is fitted.  The width is read from one row.
    """
    data = train.select(fused_features(a, b).alias("features"),
                        F.col(label).cast("double").alias("label"))
    if not layers:
        return LogisticRegression(maxIter=max_iter, regParam=1e-5).fit(data)
    width = 4 * train.select(F.size(a)).first()[0]
    return MultilayerPerceptronClassifier(
        layers=[width, *layers, 2], seed=seed, maxIter=max_iter).fit(data)


def score_head(model, df: DataFrame, a: str, b: str, out: str = "p") -> DataFrame:
    """Probability of the forged class for every row."""
    scored = model.transform(df.withColumn("features", fused_features(a, b)))
    return (scored.withColumn(out, F.get(vector_to_array("probability"), F.lit(1)))
            .drop("features", "rawPrediction", "probability", "prediction"))
