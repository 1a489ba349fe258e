import pytest

import __spark_entry__
from filinglake.plans import catalogue
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_its_sql(spark, name):
    assert differences(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_returns_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_k_is_planned_as_a_group_limit(spark):
    plan = catalogue.QUERIES["manifest_select"](spark, SF)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan  # html is never read
