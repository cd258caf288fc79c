"""The queries of this package on the test tables, with the SQL they agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, langid, licenses, mixing, negatives, pieces, quality, secret_scan, simhash, substring, trie, urls
from .common import table
from .sql import LICENSES_SQL, MIXING_SQL, NEGATIVES_SQL, QUALITY_SQL, SECRETS_SQL, TRIE_SQL, URLS_SQL

#: The vocabulary file that ``op9_sentencepiece`` and the pipeline read.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

RULES = (urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"),
         urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/"),
         urls.Rule("block", "com", "/de/"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, in the order of their first training position."""
    placed = mixing.assign_positions(table(spark, sf_dir, "documents"), keep=["doc_id"])
    first = placed.withColumn("first_position", F.get("mix_positions", F.lit(0)))
    ordered = (first.repartitionByRange(F.col("first_position").asc_nulls_last(), "mix_key")
               .sortWithinPartitions(F.col("first_position").asc_nulls_last(), "mix_key"))
    return ordered.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").cast("long").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).cast("long").alias("taken"), "first_position")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by the rules, else by their host; a page is bad if its label says so."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), outcomes, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.train(docs.filter(~held_out).select("text", "lang"))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.identify(rows, model).select("doc_id", "held_out", "lang_pred",
                                               F.col("lang_score").alias("score"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"))
    return judged.drop("class_distance", "word_distance")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = pieces.read_vocabulary(VOCABULARY)
    coded = pieces.encode_decode(docs, vocabulary)
    return coded.select("doc_id", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
                        "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes that they decode to, as digests."""
    import public_tokenizers

    codec = bpe.read_codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), codec)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(rows.select("vec_id", label.alias("label"), "embedding"), lambda i: i % 100 == 0)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that groups of a hundred share heads."""
    return trie.prefix_trie(*trie.share_heads(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_simhash, op3_substring, op4_secrets, op5_urls, op6_language,
                            op7_quality, op8_licenses, op9_sentencepiece, op10_embeddings, op11_bpe,
                            op12_negatives, op13_trie)}

ORACLES: dict[str, str] = {
    "op1_mixing": MIXING_SQL, "op4_secrets": SECRETS_SQL, "op5_urls": URLS_SQL,
    "op7_quality": QUALITY_SQL, "op8_licenses": LICENSES_SQL,
    "op12_negatives": NEGATIVES_SQL, "op13_trie": TRIE_SQL,
}
