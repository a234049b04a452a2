import random
import re

from tessera.llm import urls

RULES = [(a, h, p) for a, h, p in urls.RULES]


def brute(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, False, None, otherwise))
    return host, path, best[3], best[4]


def some_urls():
    rng = random.Random(8)
    fixed = [None, "", "no scheme", "http://", "http://COM/en/", "http://x.com?/en/", "HTTPS://A.Example.COM/en/77#t", "ftp://example.net/de/8?x://y", "http://notexample.com/en/7", "http://É.com/en/ü", "http://a..com/en/", "http://com./en/", "a://b://c.org/es/"]
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'a.b.', 'X.'])}{rng.choice(['example.', 'ample.', ''])}{rng.choice(['com', 'net', 'org'])}{rng.choice(['/', '/en/', '/de/', '/es/', ''])}{rng.randint(0, 99)}{rng.choice(['', '?a=/en/', '#top', '/'])}" for _ in range(300)]
    return fixed + made


def test_query(spark):
    rows = list(enumerate(some_urls() * 2))
    got = sorted(map(tuple, urls.rules_query(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")).collect()))
    assert got == sorted((i, *brute(u, RULES)) for i, u in rows)


def test_many_rules_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 2)
    rules = RULES + [("allow", "com", "/en/"), ("block", "b.example.org", ""), ("allow", "org", "/"), (None, "net", "/")]
    rows = list(enumerate(some_urls()))
    table = spark.createDataFrame(rules, "action string, host string, path string")
    got = sorted(map(tuple, urls.judged(spark.createDataFrame(rows, "page_id long, url string"), table, "block").collect()))
    assert got == sorted((i, *brute(u, [r for r in rules if r[0]], "block")) for i, u in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.rules_query(none).count() == 0
    rules = spark.createDataFrame([], "action string, host string, path string")
    page = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert tuple(urls.judged(page, rules).first()) == (1, "com", "/en/", None, "allow")


def test_very_long_urls(spark):
    """A host of many labels and a path of many parts: only prefixes of the rules' lengths are looked up."""
    rows = [(1, "http://" + "a." * 20_000 + "com/en/" + "x/" * 50_000), (2, "http://org/es/" + "y" * 200_000), (2, "http://org/es/" + "y" * 200_000), (None, "x" * 300_000)]
    got = urls.rules_query(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(u, RULES)) for i, u in rows), key=str)
