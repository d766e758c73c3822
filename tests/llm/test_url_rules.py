import re

from siftwell.llm import url_rules as U

PAGES = [
    (1, "https://shop.example.net/en/1", None),
    (2, "http://m.shop.example.net/fr/1?utm_source=x#top", ""),
    (3, "https://WWW.Example.com/DE/x", "<html></html>"),
    (4, "https://example.com/de/x", '<link rel="canonical" href="https://a.example.org/x/">'),
    (5, "https://a.example.org/x/index.html", "<p>"),
    (6, "https://b.example.org/y", "<link href='/fr/y' rel='canonical'>"),
    (7, "https://b.example.org/fr/y", '<meta http-equiv="refresh" content="0; url=https://example.com/de/x?gclid=1">'),
    (8, None, None),
    (9, "no scheme", None),
    (10, "ftp://:80", None),
    (11, "https://www.a.example.org/x", None),
    (11, "https://www.a.example.org/x", None),
    (12, "https://c.example.org/z?b=2&a=1", '<link rel=canonical href="z2">'),
    (13, "https://c.example.org/z2", None),
    (14, "https://xnet/en/", None),
    (15, "x://net/", None),
    (None, "https://evil.net", None),
]


def brute(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_rules_and_aliases(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, verdict string").repartition(3)
    got = U.judged(df).collect()
    assert len(got) == len(PAGES)
    want = {(i, *brute(u)) for i, u, _ in PAGES}
    assert {(r.page_id, r.host, r.path, (r.rule, r.verdict) if r.rule else None) for r in got} == want
    verdicts = {r.page_id: (r.verdict, r.by) for r in got}
    # 4 is blocked, its canonical alias 5 and 11 go with it: but 6 and 7 link them to an allowed page
    assert verdicts[5] == ("allow", "alias") and verdicts[11] == ("allow", "alias") and verdicts[4] == ("block", "rule")
    assert verdicts[8] == verdicts[9] == verdicts[10] == ("allow", "default") and verdicts[14] == ("allow", "default")
    rest = {r.page_id: (r.verdict, r.by) for r in U.judged(df.where("page_id not in (6, 7)")).collect()}
    assert rest[5] == rest[11] == ("block", "alias") and rest[13] == ("allow", "default")
    known = spark.createDataFrame([("https://c.example.org/z", "https://q.net/"), ("https://c.example.org/z?a=1&b=2", "http://c.example.org/z2")], "from_url string, to_url string")
    led = {r.page_id: r.verdict for r in U.judged(spark.createDataFrame([*PAGES, (20, "https://q.net/", None), (21, "https://c.example.org/z/", None)], "page_id long, url string, html string"), redirects=known).collect()}
    assert led[20] == "block" and led[21] == "block" and led[13] == "allow"


def test_empty(spark):
    assert U.judged(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
