"""Physical-plan assertions: pushdown, pruning, partial top-k, no needless shuffle."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = E.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_range_reaches_parquet(spark):
    p = plan(spark, "index_filter")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(spark, "html_text")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p


def test_chunking_and_flagship_need_no_shuffle(spark):
    # the only exchange allowed is one that the session asks for
    for p in (plan(spark, "word_chunks"), plan(spark, "chunk_counts"),
              E.entry(spark)._jdf.queryExecution().executedPlan().toString()):
        assert "ENSURE_REQUIREMENTS" not in p
        assert p.count("Exchange") <= p.count("REPARTITION_BY_NUM")


def test_entity_unescape_runs_once(spark):
    assert E.entry(spark)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_top_n_is_limited_before_shuffle(spark):
    for name in ("newest_n_per_security", "vector_topk", "multi_query_best_score", "context_concat"):
        p = plan(spark, name)
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_latest_per_group_combines_map_side(spark):
    p = plan(spark, "latest_nonnull_per_group")
    assert "partial_max_by" in p


def test_small_sides_broadcast_without_hints(spark):
    # no broadcast() hint anywhere in these plans: the size check is Spark's
    for name in ("directory_left_join", "skip_ingested", "missing_diagnostics"):
        df = E.queries()[name](spark, SF)
        df.collect()  # AQE re-plans from measured sizes
        assert "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString(), name
