import numpy as np

from stranda.llm import url_filter as U

SCHEMA = "page_id bigint, url string, html string, rule int, listed string, host double"
URLS = [
    None,
    "",
    "no scheme example.net/en/x",
    "http://Example.NET/en/1?x=1#y",
    "https://a.b.example.net/en/",
    "https://example.net/fr/",
    "https://example.net",
    "https://notexample.com/de/",
    "http://www.example.com/de/9",
    "http://example.com/en/9",
    "ftp://x.org/fr/2",
    "http://org/fr/",
    "http://x.org/en/2",
    "http://net/",
    "http://xnet/",
    "http://spam-farm.example.org/en/7.html",
    "http://m.Casino-Win.example.com/en/",
    "http://listed.test/a/b.html",
    "http://www.listed.test/a/b/?utm=1",
    "http://listed.test/a/c",
    "a://b://c/d",
    "http://h/" + "x" * 100_000,
    "http://line\nfeed.net/p",
]


def plain(url, listed):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(h), len(p)) > best[0]):
            best = (len(h), len(p)), verdict, h + p
    if best:
        return host, path, best[2], best[1]
    site = host
    while site.startswith(("www.", "m.", "blog.")):
        site = site.split(".", 1)[1]
    own = site + path.rstrip("/").removesuffix(".html")
    return host, path, None, "block" if {own, site} & listed else "allow"


def test_matches_plain_rules(spark):
    listed = [(u,) for u in [*[f"http://{site}/" for site in U.SITES], "https://listed.test/a/b", None, "", "nonsense"]]
    pages = spark.createDataFrame([(i, u, "<p>", 7, "clash", 0.5) for i, u in enumerate(URLS)], SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, spark.createDataFrame(listed, "url string")).collect()}
    keys = set(U.SITES) | {"listed.test/a/b"}
    assert [got[i] for i in range(len(URLS))] == [plain(u, keys) for u in URLS]


def test_full_filter_still_gives_exact_verdicts(spark):
    """A filter of one block for thousands of keys lets everything pass; the join settles it."""
    listed = spark.range(3000).selectExpr("concat('http://bad', id, '.test/') AS url")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://bad', id, '.test/x') AS url")
    for small in (U.SMALL_LIST, 0):
        got = U.judge(pages, listed, most_bytes=32, small=small).groupBy("verdict").count().collect()
        assert {r.verdict: r["count"] for r in got} == {"block": 3000, "allow": 3000}


def test_other_columns_pass_through_whatever_their_names(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", 1.5, "o", "r", 3, 9)], "page_id bigint, url string, `x.y` double, own string, row string, l1 int, host int")
    r = U.judge(pages, spark.createDataFrame([("http://a.org/x/",)], "url string")).collect()[0]
    assert r.asDict() == {"page_id": 1, "url": "http://a.org/x", "x.y": 1.5, "own": "o", "row": "r", "l1": 3, "host": "a.org", "path": "/x", "rule": None, "verdict": "block", "listed": True}


def test_list_from_junk_pages_stops_their_other_addresses(spark):
    pages = spark.createDataFrame([("http://www.a.org/x.html", "<p>buy%%% now&amp;&amp;&amp; ok</p>"), ("http://a.org/y", "<p>100%</p>"), (None, "x$$$ "), ("http://b.org/", None)], "url string, html string")
    assert {r.url for r in U.junk_urls(pages).collect()} == {"http://www.a.org/x.html", None}
    got = U.judge(spark.createDataFrame([("https://m.a.org/x?s=1",), ("http://a.org/y",)], "url string"), U.junk_urls(pages)).collect()
    assert {r.url: r.verdict for r in got} == {"https://m.a.org/x?s=1": "block", "http://a.org/y": "allow"}


def test_filter_holds_what_was_added_and_little_else():
    rng = np.random.default_rng(5)
    keys, others = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    bloom = U.BlockedBloom.sized(5000)
    bloom.add(keys)
    assert bloom.might_contain(keys).all() and bloom.might_contain(others).mean() < 0.03


def test_filter_built_in_parts_is_the_same(spark):
    keys = spark.range(500).selectExpr("concat('k', id) AS key").repartition(7)
    made = U.build(keys, 500)
    hashes = np.array([r.h for r in keys.selectExpr("xxhash64(key) AS h").collect()])
    whole = U.BlockedBloom.sized(500)
    whole.add(hashes)
    assert np.array_equal(made.words, whole.words)


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    nothing = spark.createDataFrame([], "url string")
    assert U.judge(none, nothing).count() == 0
    twice = spark.createDataFrame([(1, "http://a.net/")] * 2 + [(None, None)], "page_id bigint, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in U.judge(twice, nothing).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
