"""Queries over files and timelines cover every row of their table."""
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("timeline_places", "events"), ("document_part_files", "events"), ("entity_message_files", "conversations")])
def test_query_covers_its_table(spark, name, table):
    assert entry.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_documents_of_a_long_session_are_bounded(spark, monkeypatch):
    from sessionmill.plans import usage_queries
    monkeypatch.setattr(usage_queries, "_MESSAGES", 3)
    rows = usage_queries.document_part_files(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert max(r["row_no"] for r in rows) == 2 and max(r["part"] for r in rows) > 0
