"""Every registered query against its SQL, and the shape of the plans."""

import re

import pytest

import __spark_entry__
from __spark_entry__ import entry
from billsift.plans.oracles import oracle_sql
from billsift.plans.queries import queries
from check import compare, connect

NO_SQL = {"scan_files"}


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", queries())
def test_same_rows_as_sql(spark, con, small, name):
    assert compare(spark, con, small, name) == ""


def test_every_query_has_sql():
    assert set(queries()) - set(oracle_sql()) == NO_SQL
    assert set(oracle_sql()) <= set(queries())


def test_registered_names():
    assert set(queries()) <= set(__spark_entry__.queries())
    assert set(oracle_sql()) <= set(__spark_entry__.oracle_sql())


def initial(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name, table", [
    ("extract_record", "lineitem"), ("normalize_currency", "lineitem"), ("vendor_baseline", "orders"),
    ("fold_pages", "conversations"), ("route_short_text", "conversations"),
])
def test_tables_are_scanned_once(spark, small, name, table):
    text = initial(queries()[name](spark, small))
    assert len(re.findall(rf"Location: [^\n]*/{table}\.parquet", text)) == (3 if name == "vendor_baseline" else 1)


def test_every_document_has_an_error_row_or_a_record(spark, small):
    every = queries()["extract_record"](spark, small).count()
    assert queries()["error_rows"](spark, small).count() == every
    assert queries()["vendor_baseline"](spark, small).count() == every


def test_entry(spark):
    got = entry(spark)
    assert got.columns == ["doc_id", "grand_total", "items_sum", "reconciles"] and got.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = [n for n in queries() if not n.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_cross_join(spark, small, name):
    text = plan(queries()[name](spark, small))
    for bad in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


@pytest.mark.parametrize("name", [
    "text_lines", "redact_text", "quality_score", "content_hash", "audit_log", "safe_path",
    "run_stamp", "param_grid", "candidate_parse", "variant_slug", "encrypt_roundtrip",
])
def test_row_wise_queries_do_not_shuffle(spark, small, name):
    assert "Exchange" not in plan(queries()[name](spark, small))


def test_columns_are_pruned_at_the_scan(spark, small):
    text = plan(queries()["content_hash"](spark, small))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


def test_documents_are_hashed_once_per_branch(spark, small):
    assert plan(queries()["first_by_hash"](spark, small)).count("sha2(") == 1


def test_baseline_reuses_its_shuffle(spark, small):
    df = queries()["vendor_baseline"](spark, small)
    df.collect()
    assert "ReusedExchange" in plan(df)
