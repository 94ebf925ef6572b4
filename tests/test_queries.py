"""Registered queries against SQL on the smallest data set; `compare.py` runs them all."""

from pathlib import Path

import pytest

from suite import load
from tests.compare import connect, run_spark, run_sql

DATA = "/root/testdata/sf0.001"
NAMES = ["normalize_for_match", "contributors", "validation", "enrich", "robots_join", "score_join", "error_summary",
         "page_links", "expand_folders", "explode_keyed_catalog", "extract_list_items", "search_books", "book_details", "resolve_books",
         "list_records", "detail_records", "catalog_from_pages", "catalog_from_feeds", "details_from_pages", "rank_by_score", "best_and_second", "ambiguous", "top3_candidates", "input_order"]


@pytest.fixture(scope="module")
def con():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return connect(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    reg = load()
    assert run_spark(reg.QUERIES[name](spark, DATA)) == run_sql(con, reg.ORACLES[name])


def test_stored_inputs_are_read_by_all_cores(spark):
    from suite import tables, views

    for made in (views.book_rows, views.clue_rows, tables.asks, views.catalog):
        assert len(made(spark, DATA).inputFiles()) >= spark.sparkContext.defaultParallelism


def test_places_around_a_customer_are_not_broadcast(spark):
    from suite import tables

    near = tables._near(spark, DATA)
    assert near.count() > 0
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1  # that of the registry


def test_every_query_has_sql():
    reg = load()
    assert set(reg.QUERIES) == set(reg.ORACLES) and len(reg.QUERIES) > 100
