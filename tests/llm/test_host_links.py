"""Every form of link that LINK reads makes an edge."""

import pytest

from lorebase.llm import hostgraph


@pytest.mark.parametrize("link", ["href='//bad.net/'", "href=//bad.net/", 'href="//bad.net/"', "href='http://bad.net/'"])
def test_page_with_one_link(spark, link):
    pages = spark.createDataFrame([(1, "http://a.org/x", f"<p><a {link}>x</a>")], "page_id long, url string, html string")
    assert [tuple(r) for r in hostgraph.host_edges(pages).collect()] == [("a.org", "bad.net", 1)]
