"""Shapes of the physical plans: what scales and what must never appear."""

import re

import pytest

from quarry.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"

# Queries that run model or parser code in Python, or write files while planning.
PYTHON = {
    "chunk_documents", "chunk_upsert", "embed_dense", "embed_sparse", "ingest_status", "rebuild_index", "dense_topk",
    "boosted_topk", "rrf", "sparse_topk", "multi_query", "retrieve", "rag_sources",
    "ingest_files", "chunk_sql", "rerank_guarded",
    "semantic_chunks", "dense_topk_indexed", "sparse_topk_indexed", "retrieve_indexed", "chunk_sql_table", "src_csv_split", "read_cases_split", "unresolved_entities",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(q(spark, SF_DIR)) for name, q in QUERIES.items()}


def test_no_query_pairs_everything_with_everything(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_python_only_where_a_model_or_parser_runs(plans):
    nodes = re.compile(r"EvalPython|MapInArrow|MapInPandas|FlatMap\w*In(Arrow|Pandas)|PythonUDTF")
    assert {n for n, p in plans.items() if nodes.search(p)} <= PYTHON


def test_no_window_over_a_whole_table(plans):
    # A window without partition keys, or a limit before the end, pulls all rows into one task.
    assert [n for n, p in plans.items() if re.search(r"Window \[.*\], \[\], ", p)] == []
    ends_with_limit = re.compile(r"GlobalLimit|CollectLimit")
    assert [n for n, p in plans.items() if ends_with_limit.search(p) and "TakeOrdered" not in p] in ([], ["aggregate_global"])


def test_single_partition_exchange_only_for_global_totals(plans):
    # Allowed below a final aggregate without keys, where each task sends one row.
    for name, p in plans.items():
        lines = p.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert any("partial_" in below for below in lines[i + 1 : i + 3]), (name, lines[i + 1])


@pytest.mark.parametrize(
    "name",
    ["latest_version", "latest_quote", "price_history", "chat_history", "top_children", "stmt_last_years", "dedup_uploads", "last_attempt"],
)
def test_group_cuts_happen_before_the_shuffle(plans, name):
    assert re.search(r"WindowGroupLimit .* Partial", plans[name])


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("select_rows", "EqualTo(o_orderstatus,F)"),
        ("filter_compare", "IsNotNull(l_quantity)"),
        ("filter_in", "In(o_orderpriority"),
        ("latest_version_filtered", "GreaterThanOrEqual(l_linenumber,2)"),
        ("bars_minute", "GreaterThanOrEqual(ts,"),
        ("stale_groups", "EqualTo(o_orderstatus,F)"),
    ],
)
def test_filters_reach_the_scan(plans, name, pushed):
    assert pushed in plans[name]


def test_value_filters_of_versioned_reads_are_not_pushed(plans):
    scan = plans["latest_version_filtered"].split("PushedFilters")[1]
    assert "l_quantity" not in scan.split("ReadSchema")[0]


@pytest.mark.parametrize(
    "name, columns",
    [("aggregate_grouped", 5), ("filter_not_in", 2), ("session_activity", 2), ("tokens_by_component", 3), ("bars_daily", 4)],
)
def test_only_needed_columns_are_read(plans, name, columns):
    read = re.search(r"ReadSchema: struct<(.*?)>", plans[name]).group(1)
    assert read.count(":") <= columns


@pytest.mark.parametrize("name", ["chunk_documents", "embed_sparse", "embed_dense"])
def test_models_and_parsers_run_once_per_row(plans, name):
    assert plans[name].count("EvalPython") == 1


@pytest.mark.parametrize("name", ["pct_pick", "spread_sample", "event_replay", "topic_change"])
def test_position_helpers_read_their_input_twice_at_most(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet", final)) <= 2
