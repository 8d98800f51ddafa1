import re

import pytest

from massq.llm import urls

URLS = ["https://a.Example.ORG/es/1?x", "http://org/x", "http://org", "https://x.com/fr/", "https://x.com/de/5#t", "https://com/de/", "no scheme", None, "", "ftp://h.net?q=://z.com/de/", "http://casino-win.net/a", "http://casinos.net/", "https://example.org/en/17", "https://myorg/x", "http://x.example.org:80/es/", "http://a.com/de/", "http://a.com/de/", "a://b.org/\n?", "http://free-bets.example.org/en/2"]


def plain(url):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(s, v) for s, v in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")) for h, p in [s.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fits:
        rule, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    words = "adult|porn|xxx|casino|bets|pills|spam|ads|track|malware|phishing|warez"
    return host, path, None, "block" if re.search(rf"(^|[.-])({words})([.-]|$)", host) else "allow"


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(URLS)], "page_id long, url string, host string, tokens string")
    got = {x.page_id: (x._url.host, x._url.path, x._url.rule if x._url.tier == 0 else None, x._url.verdict) for x in urls.judge_urls(pages).collect()}
    assert got == {i: plain(u) for i, u in enumerate(URLS)}


def test_names_that_clash_repeats_and_long_urls(spark):
    """Columns named like ours, one URL on most rows, URLs of a million characters, repeated rows."""
    long = "https://x.com/de/" + "a/" * 500_000
    values = ["https://b.org/"] * 3000 + [long, long, "https://x.org/" + "b" * 1_000_000, None, None, "https://com/fr/ü"]
    names = "_u string, u string, row string, _best string, best string, n long, _url string, token string"
    pages = spark.createDataFrame([(u, "u", "row", "b", "c", 7, "gone", "t") for u in values], names)
    got = urls.judge_urls(pages, url_col="_u")
    assert got.columns == ["_u", "u", "row", "_best", "best", "n", "token", "_url"]
    found = sorted(((x._u or "")[:40], x._url.rule if x._url.tier == 0 else None, x._url.verdict, x.n, x.u, x.row, x.best) for x in got.collect())
    assert found == sorted(((v or "")[:40], *plain(v)[2:], 7, "u", "row", "c") for v in values)


def test_rarest_token(spark):
    frame = spark.createDataFrame([(["org", "example", "es"],), (["org", "example"],), (["org"],)], "tokens array<string>")
    index = {x.name: x.token for x in urls.rule_index(spark, (urls.prefix_rule("example.org/es/", "block"),), frame).collect()}
    assert index == {"example.org/es/": "es"}


def test_bad_rules_and_no_pages(spark):
    with pytest.raises(ValueError):
        urls.rule_index(spark, (urls.Rule("x", "block", ".*"),), spark.createDataFrame([], "tokens array<string>"))
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
