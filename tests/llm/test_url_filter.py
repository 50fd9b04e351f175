import random

from quillmark.llm.url_filter import filter_urls

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("b.org", "/x", "allow"), ("org", "/x/yz", "block"), ("", "", "block")]


def judge(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        ends = [rest.index(c) for c in "/?#" if c in rest]
        host = rest[: min(ends, default=len(rest))]
        tail = rest[len(host) :]
        cut = [tail.index(c) for c in "?#" if c in tail]
        path = tail[: min(cut, default=len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x", "http://com/en/", "http://xcom/en/", "http://a.b.org/x/yz", "http://é.com/en/ü#f", "http://example.net/de/8\n9", "x://a://b.com/en/", "http://.com/en/"]
    part = lambda: rng.choice(["com", "example", "net", "a", "org", "b", "Example"])
    urls += [f"http://{'.'.join(part() for _ in range(rng.randint(1, 4)))}/{rng.choice(['en', 'de', 'x'])}/{rng.choice(['7', '8', '81', 'yz', ''])}{rng.choice(['', '?q', '#f'])}" for _ in range(200)]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, None), (0, None), (None, "http://a.com/en/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    rules = RULES[:-1]
    got = filter_urls(pages, spark.createDataFrame(rules + [(None, "/", "block"), ("com", "/en/", "block")], "host string, path string, verdict string"))
    found = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str)
    assert found == sorted(((p, u, *judge(u, rules)) for p, u in rows), key=str)


def test_empty_tables_and_clashing_names(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://A.com/p", "own", "kept")], "page_id bigint, url string, Host string, key string")
    row = filter_urls(pages, rules).first()
    assert (row.host, row.rule, row.verdict, row.key) == ("a.com", None, "allow", "kept")
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert filter_urls(none, spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    plan = filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_hosts_and_very_many_path_lengths(spark):
    rules = [("com", "/" + "a" * k, "block" if k % 2 else "allow") for k in range(2500)] + [("a.b.c.d.net", "/", "block")]
    urls = ["http://" + "x." * 20_000 + "com/" + "a" * 1700, "http://com/" + "a" * 9000, "http://y.a.b.c.d.net/", "http://b.c.d.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [judge(u, rules) for u in urls]
