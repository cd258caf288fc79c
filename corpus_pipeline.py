"""A corpus pipeline from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a table that the next one reads.  All
but the last keep the columns of ``documents``:

1. language ID: documents whose language cannot be told go, all others stay;
2. SimHash near-duplicates, which share four fifths of their five-word shingles: one
   document of each group stays;
3. secrets are replaced by a mark, no document goes;
4. sources are mixed to their target weights: documents come as often as the mix takes
   them, in training order;
5. texts are encoded with a SentencePiece vocabulary; decoding gives the same text.

Nulls, empty texts, ties and repeated rows are treated as the operators say: a null or
letterless text has no language and goes in the first stage; of equal rows one stays in the
second.  Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, pieces, secret_scan, sketches
from plumbline.llm.catalog import VOCABULARY
from plumbline.llm.common import table
from plumbline.session import stored

#: Documents whose likeliest language has a posterior below this are rejected.
LEAST_SCORE = 0.5



def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told; learned from those that name theirs."""
    # Columns of the documents stay as they are, whatever their names.
    named = {c: f"doc_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    judged = langid.identify(docs.withColumnsRenamed(named), langid.train(docs.select("text", "lang")))
    told = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE)
    return judged.filter(told).select(*[F.col(named.get(c, c)).alias(c) for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one with the least doc_id."""
    return sketches.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark."""
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the documents into training order, each as often as the mix takes it."""
    return mixing.mix_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text: doc_id, source, n_tokens, ids, round_trip."""
    vocabulary = pieces.read_vocabulary(VOCABULARY)
    rows = docs.select("doc_id", "source", "text")
    coded = pieces.encode_decode(rows, vocabulary)
    return coded.select("doc_id", "source", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                        "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("simhash_dedup", simhash_dedup), ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources), ("encode_texts", encode_texts)]

#: Language ID, fingerprints and encoding cannot be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs)
    return docs
