"""Quality rules with a distribution test against language references.

The base rules look at one document: its length and how much of it repeats.  The method
compares two histograms of a document with those of its language: the share of character
classes, and the share of each of the language's most common words.  Both distances are
Jensen-Shannon distances (square root of the divergence in bits, 0 to 1).  Documents
below a minimum length are not judged by them, as their histograms are mostly noise.

References cover all documents: word counts are combined on the map side, and only the
top of each language's list leaves the count.  Everything about one document is computed
inside its row by array functions, so a document is never exploded over a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import join_summary, stored
from .common import words

#: Counted character classes.  White space follows from the words; the rest are letters.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "mark": r"[!-/:-@\[-`{-~]"}
#: Bins of the class histogram: the classes, white space, all other characters, and the
#: bytes that characters beyond ASCII take on top of one each.
N_CLASSES = len(CLASSES) + 3
#: Documents without a language are compared with each other.
NO_LANG = ""


@dataclass(frozen=True)
class Limits:
    """Parameters of the verdict."""

    min_words: int = 10
    max_repeat_pct: int = 20
    guard_words: int = 50
    common_words: int = 24
    max_class_distance: float = 0.25
    max_word_distance: float = 0.32


def repeat_words(w: Column, width: int = 5) -> Column:
    """Words covered by windows of ``width`` words that start at two or more places.

    Windows are compared by a 64-bit hash.  Only if some are equal are they sorted
    together with their positions.
    """
    starts = F.sequence(F.lit(0), F.size(w) - width)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return F.when(F.size(w) <= width, F.lit(0)).otherwise(
        F.when(F.size(F.array_distinct(hashes)) == F.size(w) - (width - 1), F.lit(0))
        .otherwise(_covered(hashes, width)))


def _covered(hashes: Column, width: int) -> Column:
    at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before = F.get(pairs, i - 1)["h"]
            after = F.get(pairs, i + 1)["h"]
            return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

        hits = F.sort_array(F.transform(F.filter(pairs, twice), lambda x: x["i"]))
        # A window adds the words up to the next repeated window, at most its own width.
        return F.transform(F.array(hits), lambda a: F.aggregate(
            F.transform(a, lambda x, i: F.least(
                F.lit(width), F.coalesce(F.get(a, i + 1) - x, F.lit(width)))),
            F.lit(0), lambda acc, x: acc + x))[0]

    # A one-element array binds the sorted pairs to a name, so that they are sorted once.
    return F.transform(F.array(at), covered)[0]


def top_words(docs: DataFrame, k: int) -> DataFrame:
    """The ``k`` most common words of each language with ties in word order: lang, common."""
    each = docs.select("lang", F.explode(words(F.col("text"))).alias("word"))
    counts = each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return top.groupBy("lang").agg(F.transform(ranked, lambda x: x["word"]).alias("common"))


def features(docs: DataFrame, limits: Limits) -> DataFrame:
    """One narrow row per document: base measures and the two histograms.

    ``classes`` counts the characters of each class, all others last; ``common`` counts
    the language's common words in order of their rank, all other words last.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang"),
                        text.alias("text"))
    rows = join_summary(known, top_words(known, limits.common_words), ["lang"])
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "lang", "text", words(F.col("text")).alias("w"),
                       F.coalesce("common", F.array().cast("array<string>")).alias("top"))
    hits = [F.coalesce(F.size("w") - F.size(F.array_remove("w", F.get("top", F.lit(i)))), F.lit(0))
            for i in range(limits.common_words)]
    rows = rows.select(
        "doc_id", "lang", F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("bigint").alias("n_repeat_words"),
        F.array(F.char_length("text"), F.octet_length("text"),
                *[F.regexp_count("text", F.lit(c)) for c in CLASSES.values()]).alias("c"),
        F.array(*hits).alias("common"))
    chars, size, *counted = [F.get("c", F.lit(i)) for i in range(len(CLASSES) + 2)]
    space = (chars - F.col("word_chars")).cast("int")
    common = F.aggregate("common", F.lit(0), lambda a, x: a + x)
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*counted, space, chars - space - sum(counted), size - chars).alias("classes"),
        F.concat("common", F.array((F.col("n_words") - common).cast("int"))).alias("common"))


def references(rows: DataFrame, limits: Limits) -> DataFrame:
    """Summed histograms of each language over all its documents: lang, ref_classes, ref_common."""
    sums = {"ref_classes": ("classes", N_CLASSES), "ref_common": ("common", limits.common_words + 1)}
    each = [F.sum(F.get(c, F.lit(i))).alias(f"{out}_{i}")
            for out, (c, n) in sums.items() for i in range(n)]
    total = rows.groupBy("lang").agg(*each)
    return total.select("lang", *[F.array(*[f"{out}_{i}" for i in range(n)]).alias(out)
                                  for out, (_, n) in sums.items()])


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null if either holds no counts."""
    zero = F.lit(0.0)
    total_p = F.aggregate(p, zero, lambda a, x: a + x)
    total_q = F.aggregate(q, zero, lambda a, x: a + x)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(zero)

    def both(x: Column, y: Column) -> Column:
        a, b = x / total_p, y / total_q
        return (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2

    divergence = F.aggregate(F.zip_with(p, q, both), zero, lambda a, x: a + x)
    return F.when((total_p > 0) & (total_q > 0), F.sqrt(F.greatest(divergence, zero)))


def judge_quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Base measures, distances and the verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept.  Null and empty texts have zero
    words and fail the base rule; their distances are null, as are those of documents
    without letters for the words.  A null lang is a language of its own.  Repeated rows
    are each returned and each counts in the references.  Other columns are not looked at.
    """
    rows = stored(features(docs, limits))
    judged = join_summary(rows, references(rows, limits), ["lang"])
    judged = judged.withColumn("class_distance", distance(F.col("classes"), F.col("ref_classes"))) \
                   .withColumn("word_distance", distance(F.col("common"), F.col("ref_common")))
    failed = ((F.col("n_words") < limits.min_words)
              | (100 * F.col("n_repeat_words") > limits.max_repeat_pct * F.col("n_words")))
    far = ((F.coalesce("class_distance", F.lit(0.0)) > limits.max_class_distance)
           | (F.coalesce("word_distance", F.lit(0.0)) > limits.max_word_distance))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "class_distance", "word_distance",
        (~failed & ~(far & (F.col("n_words") >= limits.guard_words))).alias("kept"))
