"""Hosts written together are split whether one page or a third of the pages has them."""

import pytest

from labelloom.llm import urls


def pages(spark, hot):
    text = "<p>free casino bets and cheap pills, garden news of the day; free casino</p>"
    rows = [(i, f"http://{'gardennews' if i % 2 else 'daynews'}.test/a{i}", text if i % 10 == 0 else "<p>garden news of the day</p>") for i in range(60)]
    return spark.createDataFrame(rows + [(100 + i, "http://freecasinobets.test/x", "<p>day</p>") for i in range(hot)], "page_id long, url string, html string")


@pytest.mark.parametrize("hot", [1, 30])
def test_hosts_written_together(spark, hot):
    docs = pages(spark, hot)
    host, path = urls.split_url(docs["url"])
    got = {r._host: r._tokens for r in urls.url_tokens(docs.select("html", host.alias("_host"), path.alias("_path"))).collect()}
    assert got["freecasinobets.test"][:3] == ["free", "casino", "bets"]
    verdicts = {r.host: r.verdict for r in urls.judge_urls(docs, (("allow", "none.invalid", "/"),)).collect()}
    assert verdicts["freecasinobets.test"] == "block" and verdicts["gardennews.test"] == "allow"
