import __spark_entry__ as E

FAST = ["L4_bm25_search", "M8_retrieval_metrics", "P5_chunk_documents", "D3_flat_search", "N1_mine_bm25",
        "K6_kd_loss", "R1_token_bucket", "R3_error_rate"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["query_id", "rank", "doc_id", "score", "text"]


def test_every_query_has_a_builder_and_oracle_keys_match():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_selected_queries_run_at_smallest_scale(spark, sf):
    qs = E.queries()
    for name in FAST:
        df = qs[name](spark, sf)
        assert df.count() >= 0, name
