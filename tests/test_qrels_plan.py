from quarry.plans import standins as st


def test_documents_are_cut_into_parts_once(spark, sf):
    """Parts are counted and joined from what was written; only the verification reads the documents' texts."""
    plan = st.qrels_a(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in "\n".join(x for x in plan.splitlines() if "__dtext" in x) and plan.count("documents.parquet") <= 1
    assert plan.count("array_distinct") == 0
