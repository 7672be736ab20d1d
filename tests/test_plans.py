"""Every query outside llm at the smallest scale: against its SQL, where there is one."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from docloom.plans import formats
from docloom.plans.oracle import ORACLE as WRITTEN
from docloom.plans.queries import QUERIES
from tests import compare

ORACLE = WRITTEN | formats.ORACLE

pytestmark = pytest.mark.skipif(not compare.has_data(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return compare.duck()


def test_every_sql_has_a_query():
    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows(spark, con, name):
    compare.assert_same(spark, con, QUERIES[name], ORACLE[name])


def test_entry(spark):
    pages = entry.entry(spark).collect()
    assert len(pages) > 0 and all(p.state == "done" and p.bytes == len(p.markdown.encode()) and "track(" not in p.markdown for p in pages)


def test_files_are_built_where_keys_are_dealt_out(spark):
    """A table of narrow rows is one split; its files are built and converted in as many tasks as there is room for, in one stage."""
    rows = spark.range(1, 301).coalesce(1).selectExpr("id AS p_partkey", "901.5D AS p_retailprice", "7 AS p_size")
    done = formats._convert(rows, "p_partkey", formats._styled, "p_retailprice", "p_size")
    assert done.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert done._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert {(r.state, r.markdown.count("901.50")) for r in done.collect()} == {("done", 1)} and done.count() == 300


def test_error_rates_are_dealt_out_and_take_long_texts(spark):
    """Not in the few splits of a scan of short rows, and not by a table of all pairs of letters."""
    from pyspark.sql import functions as F

    from docloom.functions import markdown, scalars

    plan = QUERIES["nfkc_error_rate_conversations"](spark, compare.DATA)
    assert plan.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert "levenshtein(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    long = "ab " * 100_000
    rows = spark.createDataFrame([(long + "\ufb01", long + "fo"), ("a  b", "a b"), ("abcd", None), (None, "x")], "a string, b string")
    for rate, first in ((scalars.character_error_rate, 1 / 300_002), (markdown.error_rate, 2 / 300_001)):
        assert [r.r for r in rows.select(rate(F.col("a"), F.col("b")).alias("r")).collect()] == [first, 0.0, None, None]
