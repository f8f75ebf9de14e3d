import pytest

from spanforge.plans import queries as engine
from tests.helpers import SF, oracle, result

QUICK = ["page_tokens", "document_lines", "filing_texts", "filing_eras", "order_eras", "chrome_lines", "stripped_texts", "front_matter"]
QUICK += ["item_headings", "accepted_items", "items", "residual_spans", "violations", "page_conservation", "user_sessions", "running_records", "shipping_islands", "shipping_overlaps", "filing_conservation", "item_sources", "dated_summary", "raw_formats", "layout_violations", "result_documents", "ledger_classes", "walk_errors", "conservation_examples", "file_formats", "page_provenance", "own_ruleset", "tagged_evidence"]


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, name):
    assert result(engine.queries()[name](spark, SF)) == oracle(engine.oracle_sql()[name])


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(engine.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
