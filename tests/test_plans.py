"""Plans that should stay as they are: pushdown, pruning, semi joins, bounded sorts."""

import pytest

from tally.plans import catalog


def plan(spark, sf, name):
    return catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(spark, sf, "range_chunk")
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,1000), LessThan(o_orderkey,2000)" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p
    assert "ReadSchema: struct<l_returnflag:string>" in plan(spark, sf, "count_where")
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan(spark, sf, "revenue_filtered")


def test_top_k_is_a_bounded_sort(spark, sf):
    for name in ("topk_exact", "topk_rollup", "cms_topk", "outbox_batch", "keyset_page"):
        assert "TakeOrderedAndProject" in plan(spark, sf, name), name


@pytest.mark.parametrize(("name", "join"), [("exists_semi", "LeftSemi"), ("parent_guard", "LeftAnti"), ("store_diff", "LeftAnti"), ("insert_ignore", "LeftAnti"), ("topk_trap_wide", "LeftSemi"), ("reconcile_classes", "FullOuter")])
def test_joins(spark, sf, name, join):
    assert join in plan(spark, sf, name)


def test_counts_combine_before_the_shuffle(spark, sf):
    for name in ("topk_exact", "minute_rollup", "apply_naive", "partition_fingerprint", "cms_cells"):
        assert "partial_" in plan(spark, sf, name), name


def test_no_pairs_of_everything_and_no_python(spark, sf):
    python = {"cms_cu", "cms_heap", "ss_guarantee", "transfer_fold", "transfer_naive", "transfer_ledger", "transfer_conserved", "cache_replay", "id_naive", "id_policies"}
    for name in catalog.queries():
        if name.startswith("stream_"):
            continue
        p = plan(spark, sf, name)
        assert "CartesianProduct" not in p, name
        assert ("Pandas" in p or "Arrow" in p or "EvalPython" in p) == (name in python), name
