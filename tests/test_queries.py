"""Registered queries against SQL on another engine, and the shape of their plans."""

import re
from pathlib import Path

import pytest
from check import connect, differences
from conftest import SF

import __spark_entry__ as entry
from claimweave.plans.oracle import ORACLE as SQL
from claimweave.plans.queries import QUERIES
from claimweave.sources.lines import read_lines


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    assert differences(spark, duck, name, QUERIES[name], SQL[name], SF) == ""


def test_every_query_has_sql_and_entry_runs(spark):
    assert QUERIES.keys() == SQL.keys()
    assert entry.queries().items() >= QUERIES.items() and entry.oracle_sql().items() >= SQL.items()
    rows = entry.entry(spark).collect()
    assert len(rows) == 3 and all(len(r["line"]) == 48 for r in rows)


def plan_of(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


# Queries whose plans hold base rows; the others end in rows made from a collected model.
PLANNED = [q for q in QUERIES if not q.startswith(("q15", "q27"))]


def test_lines_are_numbered_without_a_shuffle_of_text(spark, capsys, folder):
    (Path(folder) / "a.txt").write_text("x\n" * 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        plan = plan_of(read_lines(spark, folder), capsys)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # What is shuffled are counts of splits, never lines.
    for part in plan.split("\n\n"):
        if re.search(r"^\(\d+\) Exchange", part.strip()):
            assert "value" not in part


@pytest.mark.parametrize("name", PLANNED)
def test_plans_stay_in_the_jvm_and_pair_no_rows(spark, capsys, name):
    plan = plan_of(QUERIES[name](spark, SF), capsys)
    for node in ("BatchEvalPython", "ArrowEvalPython", "InPandas", "InArrow"):
        assert node not in plan
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
    assert not re.search(r"Exchange\nInput.*\nArguments: SinglePartition", plan) or "HashAggregate" in plan


def test_scans_read_only_what_is_used(spark, capsys):
    plan = plan_of(QUERIES["q12_generate_claims"](spark, SF), capsys)
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    plan = plan_of(QUERIES["q24_metadata_versions"](spark, SF), capsys)
    assert "ReadSchema: struct<p_brand:string,p_size:int>" in plan


def test_windows_over_rows_are_partitioned(spark, capsys):
    for name in ("q14_copula_marginals", "q18_shape_numeric"):
        plan = plan_of(QUERIES[name](spark, SF), capsys)
        assert "SinglePartition" not in plan
