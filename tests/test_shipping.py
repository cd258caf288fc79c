"""Functions that run in Python workers must not need the package there."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_udfs_run_where_the_package_is_not_installed(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {REPO!r})
        import pandas as pd
        from pyspark.sql import functions as F
        from plumbline.session import local_session
        from plumbline.operators import scoring
        from plumbline.sources import arrays
        spark = local_session("ship", cpus="2")
        df = spark.range(4).select("id", F.array(F.col("id").cast("float")).alias("v"))
        df = arrays.decode_arrays(df.withColumn("content", arrays.encode_array("v")))
        assert [r.array["data"] for r in df.orderBy("id").collect()] == [[0], [1], [2], [3]]
        out = scoring.score(df, "m", lambda: lambda b: pd.DataFrame({{"id": b["id"], "p": b["id"] / 4}}),
                            "id long, p double", ["id"])
        assert sorted(r.p for r in out.collect()) == [0, .25, .5, .75]
        print("done")
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, timeout=300,
                         capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert "done" in run.stdout, run.stderr[-2000:]
