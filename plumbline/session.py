"""Session helpers: a local session for tests and benches, reliable lineage cuts,
and joins against summary tables whose size is checked before they are broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest summary table (rows) that is broadcast; anything bigger is joined by shuffle.
BROADCAST_ROWS = 200_000

#: Replicas of a summary table in the salted fallback join.
SALTS = 16


def local_session(app: str = "plumbline", cpus: str = "*", **conf: str) -> SparkSession:
    """A local-mode session with the settings the tests and the bench use."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local-mode session
    without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        sc.setCheckpointDir(named)
    return named or current


def settle(df: DataFrame) -> DataFrame:
    """Compute a small ``df`` once and cut its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read that.

    For intermediates that may be large and are read several times: columns are
    compressed and pruned, and the planner knows their size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashable(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Columns ``xxhash64`` accepts (everything that holds no map)."""
    return [f.name for f in df.schema.fields
            if f.name not in skip and "map<" not in f.dataType.simpleString()]


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a settled table has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_summary(rows: DataFrame, summary: DataFrame, on: Sequence[str], how: str = "left",
                 small: bool | None = None, salts: int = SALTS) -> DataFrame:
    """Attach a per-key summary table to row data without shuffling the rows if possible.

    ``small`` states that the caller has proven or refuted the size bound; without
    it the summary is settled and counted here.  A small summary is broadcast.
    Beyond the bound both sides are shuffled on the keys plus a salt, with the
    summary replicated once per salt, so that a key holding a third of all rows
    still spreads over ``salts`` tasks; ``salts=1`` is for keys that cannot be hot.
    Keys compare null-safe.
    """
    if small is None:
        summary = settle(summary)
        small = is_small(summary)
    right = summary.select(*[F.col(k).alias(f"_s_{k}") for k in on],
                           *[c for c in summary.columns if c not in on])
    match = F.lit(True)
    drop = [f"_s_{k}" for k in on]
    if small:
        left, right = rows, F.broadcast(right)
    elif salts == 1:
        left = rows
    else:
        salt = F.pmod(F.xxhash64(*hashable(rows)), F.lit(salts)).cast("int")
        left = rows.withColumn("_salt", salt)
        right = right.withColumn("_s_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        match = F.col("_salt") == F.col("_s_salt")
        drop += ["_salt", "_s_salt"]
    for k in on:
        match = match & left[k].eqNullSafe(F.col(f"_s_{k}"))
    return left.join(right, match, how).drop(*drop)


def join_dealt(rows: DataFrame, summary: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 256) -> DataFrame:
    """Attach a per-key table of any size to rows whose keys may be hot.

    Rows of a key are dealt over up to ``salts`` sub-keys.  Only sub-keys that occur get a
    copy of the key's summary, so a table of rare keys is not multiplied, and a key with a
    third of all rows is spread.  Keys compare null-safe.
    """
    salt = F.pmod(F.xxhash64(*hashable(rows)), F.lit(salts)).cast("int")
    dealt = rows.withColumn("_salt", salt)
    keys = dealt.select(*[F.col(k).alias(f"_d_{k}") for k in on], F.col("_salt").alias("_d_salt")).distinct()
    right = summary.select(*[F.col(k).alias(f"_s_{k}") for k in on], *[c for c in summary.columns if c not in on])
    match = F.lit(True)
    for k in on:
        match = match & F.col(f"_d_{k}").eqNullSafe(F.col(f"_s_{k}"))
    spread = keys.join(right, match, "inner").drop(*[f"_s_{k}" for k in on])
    match = F.col("_salt") == F.col("_d_salt")
    for k in on:
        match = match & dealt[k].eqNullSafe(F.col(f"_d_{k}"))
    return dealt.join(spread, match, how).drop("_salt", "_d_salt", *[f"_d_{k}" for k in on])
