import re

from brindle.llm import url_filter as u

URLS = [
    "https://a.example.com/en/1", "https://www.example.com/en/1", "http://EXAMPLE.com/de/", "http://x.example.net/es/9?q#f", "http://x.example.net/fr", "ftp://net/fr/",
    "no scheme", None, "", "http://com", "http://com?x=/en/", "https://h.example.org/en/://x", "https://ads-track.example.org/en/7", "https://library.example.org/en/7", "http://É.org/\nx#y",
]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def brute(url):
    """Host, path, rule and action by regular expressions, apart from the module's own splitting and rules."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(d + p), d + p, a) for d, p, a in RULES if re.search(rf"(?:^|\.){re.escape(d)}\Z", host) and path[: len(p)] == p]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_rules_and_model(spark):
    pages = spark.createDataFrame([(i, x, "h", "r") for i, x in enumerate(URLS)] + [(None, URLS[0], None, None)], "page_id bigint, url string, host string, rule string")
    got = {r.page_id: r for r in u.filter_urls(pages).collect()}
    assert len(got) == len(URLS) + 1
    for i, x in enumerate(URLS):
        host, path, rule, action = brute(x)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), x
        assert got[i].verdict == (action or ("block" if got[i].score >= 0.5 else "allow"))
    assert got[12].verdict == "block" and got[13].verdict == "allow"
    assert u.filter_urls(pages.limit(0)).count() == 0


def test_held_out_words():
    """Words of the test half are in no URL of the training half; only modifiers and invented names are on both."""
    for half in (0, 1):
        w, b = u.train(u.labelled_urls(u.BLOCKED[half::2], u.ALLOWED[half::2]))
        table = u.labelled_urls(u.BLOCKED[1 - half :: 2], u.ALLOWED[1 - half :: 2], 0)
        p = u.score(*map(list, zip(*(u.split_url(x) for x, _ in table), strict=True)), w, b)
        found = [a >= 0.5 for a, (_, y) in zip(p, table, strict=True) if y]
        wrong = [a >= 0.5 for a, (_, y) in zip(p, table, strict=True) if not y]
        assert sum(found) >= 0.3 * len(found) and sum(wrong) <= 0.02 * len(wrong)


def test_every_url_of_the_table():
    table = u.labelled_urls()
    w, b = u.train(table)
    p = u.score(*map(list, zip(*(u.split_url(x) for x, _ in table), strict=True)), w, b)
    assert sum((a >= 0.5) == bool(y) for a, (_, y) in zip(p, table, strict=True)) >= 0.99 * len(table)


def test_very_long_urls(spark):
    rows = [(1, "http://casino-poker.example.org/" + "a/b" * 400_000), (2, "x" * 500_000), (3, "http://" + "q" * 300_000 + ".net/fr/?" + "z" * 300_000)]
    got = {r.page_id: r for r in u.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert got[1].path == "/" + "a/b" * 400_000 and (got[2].host, got[2].path) == ("", "") and (got[3].rule, got[3].verdict) == ("net/fr/", "block")


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "https://news.example.org/x")], "page_id bigint, url string")
    assert u.filter_urls(pages, rules=()).first().rule is None
