from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugewise.llm import queries, url_filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def by_hand(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def judged(spark, urls, rules=RULES, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge_urls(pages, url_filter.rules_from(spark, rules), **more).collect()
    assert sorted(r.page_id for r in rows) == list(range(len(urls)))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


URLS = [
    "http://www.example.net/en/1", "http://example.net/en", "https://EXAMPLE.net/en/?x", "http://net/", "http://net", "http://anet/", "http://x.net?/en/", "http://.net/", "ftp://example.com/de/#t",
    "http://example.com/DE/", "http://badexample.com/de/", "http://a.b.c.example.com/de/x", "http://x.org/fr/", "http://org/fr/y", "http://org.x/fr/", "no scheme.net/", "", None, "://", "://net/", "a://b://net/",
    "http://e.net/" + "x" * 100_000, "http://" + "a." * 5000 + "net/", "http://ÄÖ.Net/é", "http://example.net:80/en/", "http://x.net/\nline", "http://example.net/en/1", "http://example.net/en/1",
]


def test_contract_rules(spark):
    got = judged(spark, URLS)
    assert got == {i: by_hand(u, RULES) for i, u in enumerate(URLS)}
    assert got[0][2:] == ("example.net/en/", "allow") and got[3][2:] == ("net/", "block") and got[4][2:] == (None, "allow")


def test_nested_rules_over_many_ranges(spark, monkeypatch):
    """Rules inside rules, on one host and across hosts, open over several ranges."""
    monkeypatch.setattr(url_filter, "OVERSAMPLE", 1)
    rules = [("block", "b", ""), ("allow", "b", "/"), ("block", "b", "/a"), ("allow", "b", "/a/b"), ("block", "a.b", "/a"), ("allow", "c.a.b", ""), ("block", "", "/z"), ("block", "b", "/a/b/c/d/e")]
    urls = [f"http://{h}{p}" for h in ("b", "a.b", "c.a.b", "d.c.a.b", "x.b", "bb", "") for p in ("", "/", "/a", "/ab", "/a/b", "/a/b/c/d/e/f", "/z", "/\U0010ffff")]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert judged(spark, urls, rules, default="block") == {i: by_hand(u, rules, "block") for i, u in enumerate(urls)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


labels = st.lists(st.sampled_from(["a", "b", "ab", ""]), min_size=1, max_size=4).map(".".join)
paths = st.text("/ab", max_size=4).map(lambda x: "/" + x if x else x)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(labels, paths), max_size=8, unique=True), st.lists(st.tuples(labels, paths), min_size=1, max_size=30))
def test_any_rules(spark, rules, urls):
    rules = [("block" if i % 2 else "allow", h, p) for i, (h, p) in enumerate(rules)]
    urls = [f"x://{h}{p}" for h, p in urls]
    assert judged(spark, urls, rules) == {i: by_hand(u, rules) for i, u in enumerate(urls)}


def test_odd_tables(spark):
    """Empty tables, no rules, null and repeated rules, null ids, repeated rows and clashing columns."""
    rules = url_filter.rules_from(spark, [("allow", "net", "/"), ("block", "NET", "/"), ("allow", "net", "/"), ("block", None, "/"), ("block", "net", None)])
    pages = spark.createDataFrame([(None, "http://net/", "x", "y"), (1, None, None, None), (1, None, None, None)], "page_id long, url string, Tail string, verdict string")
    out = url_filter.judge_urls(pages, rules)
    assert sorted(map(str, ((r.page_id, r.Tail, r.rule, r.verdict) for r in out.collect()))) == ["(1, None, None, 'allow')"] * 2 + ["(None, 'x', 'net/', 'block')"]
    assert sorted(out.columns) == sorted(["page_id", "url", "Tail", "verdict", "host", "path", "rule"])
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, url_filter.rules_from(spark, []), default="block").collect()} == {"block"}


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op13_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("n", [1, 5])
def test_ranges(spark, n):
    bounds = [bytes([10 * i]) for i in range(1, n + 1)]
    keys = spark.range(0, 70).select(F.unhex(F.hex("id")).alias("k"), "id")
    for r in keys.select("id", url_filter._range_of(F.col("k"), bounds).alias("r")).collect():
        assert r.r == sum(bytes([r.id]) >= b for b in bounds)
