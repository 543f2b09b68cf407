"""Some queries against their SQL on the smallest tables; the driver compares them all."""

import pytest

from tests.oracle import both, there
from trailmark.plans import catalogue, oracle

SOME = ["url_normalize", "url_kind", "html_links", "page_outline", "headings_json", "content_kind", "rerank_parse", "robots_policy", "query_atoms", "match_string", "job_keys", "upsert_meta", "crawl_counts", "changed_names", "tenant_children", "page_captures"]


def test_every_query_has_its_sql():
    assert {*catalogue.QUERIES} == {*oracle.SQL}


@pytest.mark.skipif(not there, reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_and_sql_agree(spark, name):
    columns, want_columns, rows, want = both(spark, catalogue.QUERIES[name], oracle.SQL[name])
    assert columns == want_columns and rows == want
