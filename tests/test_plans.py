"""Plans: filters and columns reach the scan, aggregation is partial first, nothing runs as a cross join."""

import re

import pytest

from tidemark.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_are_pushed(spark):
    text = plan(QUERIES["range_key"](spark, DATA))
    assert "GreaterThanOrEqual(event_id,100)" in text and "LessThanOrEqual(event_id,799)" in text
    assert set(re.search(r"ReadSchema: struct<(.*?)>", text)[1].split(",")) == {"event_id:bigint", "value:double"}


def test_aggregates_are_partial(spark):
    assert "partial_min" in plan(QUERIES["b1_daily_min_max_avg"](spark, DATA))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_monotone", "page_file_roundtrip", "ingest_table"}))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
