import pytest

from quillon import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, same):
    same(catalogue.QUERIES[name](spark, sf_dir), catalogue.ORACLE[name])


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = [r["revenue"] for r in e.entry(spark).collect()]
    assert len(rows) == 5 and rows == sorted(rows, reverse=True)


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    plan = catalogue.QUERIES["filter_gt"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan and "GreaterThan(l_quantity,25.0)" in plan


def test_top_k_keeps_k_rows_a_task(spark, sf_dir):
    assert "TakeOrderedAndProject" in catalogue.QUERIES["topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
