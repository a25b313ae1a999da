"""The driver contract, with and without the subpackage for training data."""

import __spark_entry__ as entry


def test_entry_runs(spark, small):
    assert entry.entry(spark).count() >= 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_queries_run_on_small_tables(spark, small):
    from lectern import queries

    for name in ("concept_facts", "vector_topk", "lexical_all", "context_budget", "question_parse", "derived_concept_links", "latest_job"):
        assert queries.queries()[name](spark, small).columns


def test_plans_push_filters_down(spark, small):
    from lectern.queries import queries

    plan = queries()["lane_filter"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "doc_kind" in plan and "text" not in plan.split("ReadSchema")[-1]
