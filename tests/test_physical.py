"""The plans stay the ones that scale: pushed filters, pruned columns, no Cartesian products, top-k without full sorts."""

import pytest

from lodestone.plans import catalog

DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "knn_filtered")
    assert "EqualTo(label,3)" in p and "TakeOrderedAndProject" in p
    p = plan(spark, "recent_filings")
    assert "EqualTo(o_orderstatus,F)" in p and "o_totalprice" not in p
    assert "n_chars" not in plan(spark, "content_dedup") and "html" not in plan(spark, "url_filename")


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"ivf_probe", "stream_ingest", "poison_messages", "audit_records", "research_answer"}))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_ring_buffer_and_search_are_top_k(spark):
    assert "TakeOrderedAndProject" in plan(spark, "ring_buffer") and "TakeOrderedAndProject" in plan(spark, "hybrid_search")
