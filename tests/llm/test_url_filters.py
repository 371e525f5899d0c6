from sheetstorm.llm.queries import URL_RULES
from sheetstorm.llm.url_filters import filter_urls, rule_table


def expected(url, rules=URL_RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("#")[0].split("?")[0]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


URLS = [
    None, "", "no scheme", "http://", "http://example.com/en/7", "http://EXAMPLE.com/en/71?x#y", "http://a.b.example.com/en/8", "x://com/en/", "x://.com/en/", "x://xcom/en/",
    "http://example.net/de/8/", "http://net/de/8", "http://org?/es/", "http://a.org/es/#://b", "http://a.org./es/", "http://ü.ORG/es/", "http://a.com:80/en/", "http://a..com/en/",
    "http://" + "a." * 5000 + "com/en/" + "y" * 5000,
]


def test_against_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, None, "x"), (None, URLS[4], "x"), (None, URLS[4], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rule_table(spark, URL_RULES)).collect()), key=str)
    assert got == sorted(((i, *expected(u)) for i, u, _ in rows), key=str)


def test_many_rules_are_joined_by_shuffling(spark):
    rules = [("block", f"h{i % 50}.org", f"/{i}/") for i in range(400)] + [("allow", "h1.org", "/1/"), ("block", "", "")]
    pages = spark.createDataFrame([(i, f"http://sub.h{i % 60}.org/{i}/page") for i in range(500)], "page_id long, url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, rule_table(spark, rules)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: expected(f"http://sub.h{i % 60}.org/{i}/page", rules[:400]) for i in range(500)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(pages, rule_table(spark, URL_RULES)).count() == 0
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert filter_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), none).first().verdict == "allow"
