"""URL rules against a plain reading of the rules, row by row."""

import random

import pytest

from inkstone.llm import url_rules
from inkstone.llm.queries import URL_RULES

RULES = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best[3] if best else None, best[4] if best else default


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    return {r.page_id: tuple(r)[1:] for r in url_rules.judge(pages, spark.createDataFrame(rules, RULES), **options).collect()}


def test_odd_urls(spark):
    urls = [None, "", "nothing", "http://", "http://com", "http://com/", "http://A.Example.COM/en/x?y#z", "x://www.example.com/en/", "ftp://www.example.com/enx", "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/#/es/"]
    urls += ["http://ü.É.com/en/", "http://www.example.com?/en/", "http://www.example.com#a/b", "http://example.com:80/en/", "http://u@example.com/en/x", "http://.com/", "http://com./", "http://a..example.com/en/", "http://x.com/a://b.net/es/", "http://example.com/" + "long/" * 50_000, "://example.com/en/"]
    got = judged(spark, urls, URL_RULES)
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(urls)}


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_nested_rules_and_hot_hosts(spark, monkeypatch, ranges):
    monkeypatch.setattr(url_rules, "CUT", 9)  # boundaries are shorter than the keys
    rng = random.Random(ranges)
    label = lambda: rng.choice(["a", "b", "ab", "a-b", "a0", "b.a", "a/"[:1]])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/a", "a", "/ab/", "-"]) for _ in range(rng.randint(0, 4)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(120)] + [("", "/a", "block"), ("a", "", "allow"), ("a", "", "block")]
    urls = [f"http://{host()}{path()}" for _ in range(700)] + ["http://a.b/a/a"] * 900
    got = judged(spark, urls, rules, ranges=ranges, default="block")
    want = {i: plain(u, rules, "block") for i, u in enumerate(urls)}
    assert {i: (g[0], g[1], g[2], g[3]) for i, g in got.items()} == want


def test_a_hot_url_spans_ranges(spark):
    urls = spark.range(3000).selectExpr("id AS page_id", "if(id % 3 = 0, 'http://hot.example.com/en/1', concat('http://h', id, '.net/fr/')) AS url")
    from pyspark.sql import functions as F

    salted = urls.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    bounds = url_rules.boundaries(salted, 30)
    key = url_rules.key_of("hot.example.com")
    assert len(bounds) <= 29 and bounds == sorted(bounds) and sum(b[0] == key for b in bounds) >= 5
    assert len({url_rules.place(bounds, key, "/en/1", s) for s in range(-(2**63), 2**63, 2**59)}) >= 5
    assert set(url_rules.places(bounds, url_rules.rule_key("example.com"))) >= {url_rules.place(bounds, key, "/en/1", s) for s in (-(2**63), 0, 2**63 - 1)}


def test_empty_tables_repeats_and_other_columns(spark):
    rules = spark.createDataFrame(URL_RULES, RULES)
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_rules.judge(none, rules).count() == 0
    rows = [(None, "http://net/es/", 1, "x"), (5, "http://net/es/", 2, "y"), (5, "http://net/es/", 2, "y"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, part int, host string")
    got = url_rules.judge(pages, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(None, "net", "/es/", "net/es/", "block"), (5, "net", "/es/", "net/es/", "block"), (5, "net", "/es/", "net/es/", "block"), (None, "", "", None, "allow")]))
    assert [r.verdict for r in url_rules.judge(pages, rules.limit(0), default="block").collect()] == ["block"] * 4
    assert [r.rule for r in url_rules.judge(pages.where("url IS NOT NULL"), spark.createDataFrame([(None, None, "block"), ("x", "/", None)], RULES)).collect()] == [""] * 3
