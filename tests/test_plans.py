"""The plans that keep queries fit for large tables."""

import re

import pytest

from weftline import suite

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = suite.queries()[name](spark, SF)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_a_condition_on_an_id_reaches_the_scan(spark):
    assert "EqualTo(c_custkey,5)" in plan(spark, "filter_id") and "EqualTo(o_custkey,7)" in plan(spark, "filter_link_id")


def test_a_policy_reaches_the_scan(spark):
    assert "EqualTo(c_mktsegment,AUTOMOBILE)" in plan(spark, "policy_filtered_select")


def test_only_used_columns_are_read(spark):
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "order_offset_limit")) == ["c_custkey:bigint,c_name:string"]


def test_a_condition_on_the_type_removes_the_other_scans(spark):
    text = plan(spark, "filter_type_name")
    assert "supplier.parquet" in text and "customer.parquet" not in text and "Union" not in text


@pytest.mark.parametrize("name", ["order_limit_topk"])
def test_topk(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_a_multi_link_is_gathered_with_one_shuffle_of_its_rows(spark):
    text = plan(spark, "multi_link_junction")
    assert text.count("lineitem.parquet") == 1 and len(re.findall(r"hashpartitioning\(_x\ds#", text)) == 1


def test_links_with_properties_need_no_ranks_and_targets_are_not_broadcast(spark):
    text = plan(spark, "link_properties")
    assert "Window" not in text and re.search(r"SortMergeJoin[^\n]*\n(?:[^\n]+\n)*Left keys \[1\]: \[_t#", text)


def test_no_python_on_the_executors(spark):
    for name in suite.queries():
        assert not re.search("EvalPython|MapIn|FlatMapGroups", plan(spark, name)), name
