from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import same
from tidelog.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLES:
        same(df, plans.ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_batch_close_fold_is_the_whole_log(spark):
    from tidelog.plans import fixture

    where = "/root/testdata/sf0.01"
    rows = sorted((r.partition, r.offset, r.size) for r in fixture.log(spark, where).select("partition", "offset", "size").collect())
    want, total, no, last = [], 0, 0, None
    for part, offset, size in rows:
        if part != last:
            last, total, no = part, 0, 0
        want.append((part, offset, no))
        total += size
        if total >= 1000:
            total, no = 0, no + 1
    got = sorted((r.part, r.nth, r.no) for r in plans.QUERIES["batch_close_fold"](spark, where).collect())
    assert len(got) == spark.read.parquet(f"{where}/events.parquet").count() and got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_reaches_the_scan(spark, tmp_path):
    from tidelog.operators import visibility
    from tidelog.plans import fixture

    where = f"file://{tmp_path}/log"
    fixture.log(spark, SF).write.partitionBy("topic", "partition").parquet(where)
    plan = visibility.fetch(spark.read.parquet(where), "events", 1, 100, end=150)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(offset,100)" in plan and "LessThan(offset,150)" in plan and "PartitionFilters: [isnotnull(topic" in plan


def test_log_is_written_once_and_again_if_it_is_gone(spark):
    import shutil

    from tidelog.plans import fixture

    rows = fixture.log(spark, SF).count()
    kept = dict(fixture._stored)
    assert fixture.log(spark, SF).count() == rows and fixture._stored == kept
    plan = fixture.log(spark, SF).where("partition = 1 AND offset < 9")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition" in plan and "LessThan(offset,9)" in plan and "Exchange" not in plan
    for where in fixture._stored.values():
        shutil.rmtree(where.removeprefix("file://"))
    assert fixture.log(spark, SF).count() == rows and fixture._stored != kept


def test_no_python_and_no_product_in_hot_plans(spark):
    for name in ("read_committed", "compact_latest", "assign_offsets", "retain_both", "consumer_lag"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
