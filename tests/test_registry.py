"""A cross-section of the registered queries against their independent SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import connect, rows

SAMPLE = [
    "point_ids", "semantic_search", "merge_keyword_semantic", "quality_report", "snapshot_projection", "rows_to_shards",
    "document_feedback_stats", "attribute_feedback", "ratio_rule", "histogram_quantile", "alert_state", "endpoint_benchmark",
    "contract_violations", "gate_outcomes", "serving_version_as_of", "upsert_documents", "rewrite_queue_ids", "replay_events",
]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    got = queries()[name](spark, sf).toPandas()
    want = connect(sf).execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
