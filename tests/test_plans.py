"""What the physical plans must and must not contain."""

import os
import re

import pytest
from pyspark.sql import functions as F

from plumbline.catalog import QUERIES, frames
from plumbline.catalog.registry import table
from plumbline.operators import dedup, keyframes, splits

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["keep_genuine"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text
    text = plan(keyframes.top_confident(table(spark, SF, "events"), "user_id", "value", "event_id")
                .select("user_id", "value"))
    assert "GreaterThanOrEqual(value,0.7)" in text
    assert "props" not in text


def test_dedup_cuts_groups_before_the_shuffle(spark):
    text = plan(dedup.dedup_first(table(spark, SF, "lineitem"), ["l_orderkey"], ["l_partkey"]))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_group_split_does_not_shuffle_or_join_rows(spark):
    df = splits.split_by_group(table(spark, SF, "events"), "user_id")
    main = plan(df).split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main


def test_group_split_windows_see_buckets_or_one_bucket(spark):
    df = splits.split_by_group(table(spark, SF, "events"), "user_id")
    text = df._jdf.queryExecution().optimizedPlan().toString()
    # The only window without a real partition key runs over the md5-prefix histogram.
    for line in re.findall(r"Window .*", text):
        assert "_b#" in line or "_cut#" in line or "_bw#" in line


def test_stratified_split_keeps_rows_in_place(spark):
    df = splits.stratified_split(table(spark, SF, "events"), ["event_type"], ["event_id"])
    text = plan(df)
    top = text[:text.index("FileScan")]
    assert "BroadcastHashJoin" in top and "SortMergeJoin" not in text


def test_score_counts_combine_before_the_shuffle(spark):
    s = frames.scores(spark, SF)
    text = plan(s.groupBy("lang", "p").agg(F.count_if(F.col("y") == 1)))
    assert "partial_count" in text
