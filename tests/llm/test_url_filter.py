import numpy as np
from pyspark.sql import functions as F

from cotejo.llm import url_filter as U
from cotejo.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "https://example.com/en/", "https://example.com/en", "https://a.b.example.com/en/1",
    "https://www.example.com/en/1", "https://sub.www.example.com/en/1", "http://x.net/es/1", "http://x.net/fr/", "http://x.net/de/1", "http://net/es/", "http://xnet/es/",
    "http://com", "http://com/", "http://foo.com?x=/en/", "ftp://foo.com#a", "http://a://b.com/", "http://ÉX.com/é/", "http://x.org/",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = [(len(r), r, v) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


def judged(spark, urls, **kw):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").withColumns({"rule": F.lit("old"), "verdict": F.lit(1)})
    df = df.withColumns({"host": U.url_host(F.col("url")), "path": U.url_path(F.col("url"))})
    rules = URL_RULES
    if kw.get("table"):
        rules = spark.createDataFrame(URL_RULES, "verdict string, rule string")
    return {r.i: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, rules, max_bytes=kw.get("max_bytes", U.MAX_BYTES)).collect()}


def test_verdicts_against_brute_force_on_both_ways(spark):
    expected = {i: brute(u) for i, u in enumerate(URLS)}
    assert judged(spark, URLS) == expected
    assert judged(spark, URLS, table=True) == expected
    assert judged(spark, URLS, table=True, max_bytes=1) == expected


def array(rules):
    return U.DigestArray(np.frombuffer(U.packed(rules), "u1"))


def test_long_hosts_and_paths_cost_what_the_rules_ask_for(spark):
    a = array([("b.example.com/x/", True), ("com", False), ("net/", True)])
    host = b"a." * 500_000 + b"b.example.com"
    assert len(list(a.candidates(host, b"/x/" + b"y" * 1_000_000))) <= 3 * 13
    assert a.match([host, b"x" * 1_000_000 + b".net", b"x" * 1_000_000], [b"/x/" + b"y" * 1_000_000, b"/", b"/"]) == [(b"b.example.com/x/", True), (b"net/", True), None]
    url = "http://" + "a." * 200_000 + "example.com/en/" + "z" * 200_000
    assert judged(spark, [url])[0][2:] == ("example.com/en/", "block")


def test_many_rules_in_little_memory():
    import tracemalloc

    rules = [(f"host{i}.example{i % 1000}.org/some/path{i}/", i % 2 == 0) for i in range(100_000)]
    data = U.packed(rules)
    assert len(data) < sum(len(r) for r, _ in rules) + 17 * len(rules) + 200
    tracemalloc.start()
    a = U.DigestArray(np.frombuffer(data, "u1"))
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()
    assert a.match([b"x.host7.example7.org"], [b"/some/path7/z"]) == [(b"host7.example7.org/some/path7/", False)]


def test_digest_collisions_are_told_apart_by_the_strings(monkeypatch):
    monkeypatch.setattr(U.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    a = array([(r, v == "block") for v, r in URL_RULES])
    for u in URLS:
        host, path, rule, verdict = brute(u)
        found = a.match([host.encode()], [path.encode()])[0]
        assert (found and found[0].decode()) == rule
        assert ("block" if found and found[1] else "allow") == verdict


def test_empty_rules_and_tables(spark):
    df = spark.createDataFrame([("a.com", "/")], "host string, path string")
    assert [tuple(r) for r in U.judge_urls(df, []).collect()] == [("a.com", "/", None, "allow")]
    assert U.judge_urls(df.limit(0), URL_RULES).count() == 0
