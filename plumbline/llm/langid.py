"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters per language in a fixed number of hash
buckets.  The matrix of log probabilities has (languages x buckets) entries, a size that
the parameters bound, and is broadcast.  Scoring works on batches: a text becomes the
bucket numbers of its n-grams, and its log likelihoods are sums over the rows of the
matrix that these numbers name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared, trim

# Ship the functions themselves, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages in order, and for each bucket a row of their log probabilities."""

    langs: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray


@dataclass(frozen=True)
class Training:
    """Bounds of the fit: about ``max_docs`` labelled documents are counted, chosen by a hash
    of the text.  Every language is learned; more than ``max_langs`` are an error, since the
    model would be too large to broadcast."""

    max_docs: int = 20_000
    max_langs: int = 500
    buckets: int = 1 << 14
    longest: int = 3
    smoothing: float = 0.5


def grams(text: str, buckets: int, longest: int) -> np.ndarray:
    """Bucket numbers of all character n-grams of the lower-cased text, repeats included."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out, hashed = [], np.zeros(len(codes), np.uint64)
    for n in range(1, longest + 1):
        if len(codes) < n:
            break
        hashed = hashed[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(n)
        mixed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(40)).astype(np.int64) & (buckets - 1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(labelled: DataFrame, training: Training = Training()) -> Model:  # noqa: B008
    """Fit the model on the text and lang of all given rows, within the training bounds.

    Rows with a null text or lang and texts without letters teach nothing.  No rows give a
    model without languages.
    """
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    n = rows.count()
    if n > training.max_docs:
        share = int(training.max_docs / n * (1 << 20))
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share)
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(training.max_langs + 1).collect())
    if len(langs) > training.max_langs:
        raise ValueError(f"more than {training.max_langs} languages")
    size, longest = training.buckets, training.longest

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        known = set(langs)
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(),
                                  strict=True):
                if lang in known and has_letter(text):
                    total = sums.setdefault(lang, np.zeros(size + 1, np.int64))
                    total[:size] += np.bincount(grams(text, size, longest), minlength=size)
                    total[size] += 1
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at])],
                ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket long, n long")
    # At most max_langs * (buckets + 1) rows, whatever the corpus.
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    index = {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((size + 1, len(langs)))
    at = np.array([index[x] for x in sums.column("lang").to_pylist()], dtype=np.int64)
    table[sums.column("bucket").to_numpy(), at] = sums.column("n").to_numpy()
    docs, table = table[size], table[:size] + training.smoothing
    return Model(tuple(langs), np.log((docs + 1) / (docs.sum() + len(langs))) if langs else docs,
                 np.log(table / table.sum(axis=0)).astype(np.float32))


def predict(model: Model, text: str | None, longest: int) -> tuple[str, float]:
    """The likeliest language, of equally likely ones the first by name, and its posterior.

    Null, a text without a letter, and a model without languages give ``und`` and 0.
    """
    if text is None or not model.langs or not has_letter(text):
        return UNKNOWN, 0.0
    found = grams(text, len(model.weights), longest)
    scores = model.prior + np.take(model.weights, found, axis=0).sum(axis=0, dtype=np.float64)
    best = int(scores.argmax())
    return model.langs[best], float(1.0 / np.exp(scores - scores[best]).sum())


def identify(docs: DataFrame, model: Model, training: Training = Training()) -> DataFrame:  # noqa: B008
    """All columns of ``docs`` with lang_pred and lang_score from the whole text alone.

    Repeated rows get equal results.  Columns named lang_pred or lang_score are replaced.
    """
    get, longest = shared(docs.sparkSession, model), training.longest
    rest = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = get()
        for batch in batches:
            found = [predict(known, t, longest) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())],
                [*batch.schema.names, "lang_pred", "lang_score"])
        trim()

    kept = docs.select(*rest)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, lang_score double")
