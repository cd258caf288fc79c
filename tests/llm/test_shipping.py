"""Tasks of this package must run where the package is not installed."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_tasks_run_without_the_package(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import functions as F
        from plumbline.session import local_session
        from plumbline.llm import (bpe, embeddings, langid, negatives, pieces, secret_scan, simhash, sketches,
                                   substring, trie)
        from plumbline.llm.catalog import VOCABULARY
        spark = local_session("ship", cpus="2")
        text = F.concat(F.lit("token=abcdefghij "), F.repeat(F.lit("some words in a row "), 20))
        docs = spark.range(4).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
        langid.identify(docs, langid.train(docs)).collect()
        secret_scan.scan_secrets(docs).collect()
        secret_scan.mask_secrets(docs).collect()
        vocabulary = pieces.read_vocabulary(VOCABULARY)
        pieces.decode(pieces.encode(docs, vocabulary), vocabulary).collect()
        simhash.near_duplicates(docs).collect()
        assert sketches.keep_one(docs).count() == 1
        assert {{r.n_removed for r in substring.remove_repeats(docs).collect()}} == {{101}}
        vectors = spark.range(4).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
        embeddings.near_duplicate_vectors(vectors).collect()
        bpe.encode_decode(docs, bpe.Codec({{bytes([i]): i for i in range(256)}}, r"\\S+|\\s+")).collect()
        both = vectors.withColumn("label", F.col("vec_id") % 2)
        assert negatives.mine_negatives(both, lambda i: i == 0, negatives.Mining(high=100)).count() == 2
        turns = spark.range(6).selectExpr("id % 2 AS conv_id", "id AS turn", "'user' AS role", "'hello' AS text")
        assert trie.prefix_trie(*trie.share_heads(turns)).count() == 4
        print("done")
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, timeout=600,
                         capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert "done" in run.stdout, run.stderr[-3000:]
