from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from salesmart.llm import urls
from salesmart.llm.queries import RULES

URLS = {
    "http://A.Example.COM/De/x?q#f": ("a.example.com", "/De/x"),
    "https://x.net": ("x.net", ""),
    "x://u:p@H.org:80/a/b#c": ("u:p@h.org:80", "/a/b"),
    "no scheme/at all": ("", ""),
    "": ("", ""),
    None: ("", ""),
    "http://?x": ("", ""),
    "a://b://c/d": ("b:", "//c/d"),
    "ÀÉ://ÀB.ORG/É": ("Àb.org", "/É"),
    "http://h/a\nb?c": ("h", "/a\nb"),
}


def test_hosts_and_paths(spark):
    table = spark.createDataFrame([(u,) for u in URLS], "url string")
    got = {r[0]: (r[1], r[2]) for r in table.select("url", urls.host_of(F.col("url")), urls.path_of(F.col("url"))).collect()}
    assert got == URLS


@pytest.mark.parametrize(
    ("host", "path", "rule", "verdict"),
    [
        ("net", "/", "net/", "block"),
        ("a.net", "/x", "net/", "block"),
        ("a.net", "", None, None),
        ("anet", "/x", None, None),
        ("m.example.net", "/en/1", "example.net/en/", "allow"),
        ("m.example.net", "/fr/1", "net/", "block"),
        ("example.com", "/de/", "example.com/de/", "block"),
        ("example.com", "/de", None, None),
        ("x.org", "/fr/y", "org/fr/", "allow"),
        ("", "", None, None),
    ],
)
def test_the_longest_rule_wins(spark, host, path, rule, verdict):
    table = spark.createDataFrame([(host, path)], "host string, path string")
    assert tuple(table.select(*urls.matching_rule(F.col("host"), F.col("path"), RULES)).first()) == (rule, verdict)


def test_ties_of_rules(spark):
    rules = [urls.Rule("allow", "b.org", "/a/"), urls.Rule("block", "org", "/a/bc"), urls.Rule("block", "b.org", "/a/")]
    table = spark.createDataFrame([("b.org", "/a/bc")], "host string, path string")
    assert tuple(table.select(*urls.matching_rule(F.col("host"), F.col("path"), rules)).first()) == ("b.org/a/", "block")


@pytest.mark.parametrize(("host", "domain", "suffix"), [("a.b.example.com", "example.com", "com"), ("x.co.uk", "x.co.uk", "co.uk"), ("a.x.co.uk:80", "x.co.uk", "co.uk"), ("localhost", "localhost", "localhost"), ("1.2.3.4", "1.2.3.4", "4"), ("", "", "")])
def test_domains(spark, host, domain, suffix):
    table = spark.createDataFrame([(host,)], "host string")
    assert tuple(table.select(urls.domain_of(F.col("host")), urls.suffix_of(F.col("host"))).first()) == (domain, suffix)


def shrunk(rows, settings):
    """Bounds per host, from (host, domain, suffix, n, k), said again in plain Python."""

    def add(keys):
        out = {}
        for row in rows:
            n, k = out.get(keys(row), (0, 0))
            out[keys(row)] = n + row[3], k + row[4]
        return out

    def strength(units):
        chance = sum(m * (1 - m) for _, _, m in units)
        spread = sum(n * (k / n - m) ** 2 for n, k, m in units)
        weight = sum(m * (1 - m) * (n - 1) for n, k, m in units)
        r = (spread - chance) / weight if weight else settings.weakest
        return 1 / max(settings.weakest, min(settings.strongest, r)) - 1

    s, d = add(lambda r: r[2]), add(lambda r: r[1])
    n0, k0 = add(lambda r: 0)[0]
    parent = {r[1]: r[2] for r in rows}
    m1 = strength([(n, k, k0 / n0) for n, k in s.values()])
    m2 = strength([(n, k, s[parent[x]][1] / s[parent[x]][0]) for x, (n, k) in d.items()])
    m3 = strength([(r[3], r[4], d[r[1]][1] / d[r[1]][0]) for r in rows])
    rate1 = {x: (k + m1 * k0 / n0) / (n + m1) for x, (n, k) in s.items()}
    rate2 = {x: (k + m2 * rate1[parent[x]]) / (n + m2) for x, (n, k) in d.items()}
    out = {}
    for host, domain, _, n, k in rows:
        a, b = k + m3 * rate2[domain], n - k + m3 * (1 - rate2[domain])
        out[host] = a / (a + b) + settings.deviations * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
    return out


def test_bounds_are_shrunk_level_by_level(spark):
    hosts = [("a.one.com", "one.com", "com", 40, 36), ("b.one.com", "one.com", "com", 12, 9), ("c.two.com", "two.com", "com", 30, 3), ("d.two.com", "two.com", "com", 2, 1), ("e.three.org", "three.org", "org", 25, 20), ("f.four.org", "four.org", "org", 9, 8)]
    outcomes = [(f"http://{h}/{i}", int(i < k)) for h, _, _, n, k in hosts for i in range(n)]
    pages = [(1, f"http://{h}/x", "clash") for h, *_ in hosts] + [(2, None, None), (None, "http://new.two.com/", None), (2, None, None)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, verdict string"), spark.createDataFrame(outcomes, "url string, good int"), [])
    rows = got.collect()
    assert len(rows) == len(pages)
    want = shrunk(hosts, urls.Reputation())
    for row in rows:
        if row["host"] in want:
            assert row["good_rate_bound"] == pytest.approx(want[row["host"]])
            usual = sum(r[4] for r in hosts) / sum(r[3] for r in hosts)
            assert row["verdict"] == ("block" if want[row["host"]] < usual else "allow")
    by_host = {r["host"]: r for r in rows}
    assert by_host["c.two.com"]["verdict"] == "block" and by_host["a.one.com"]["verdict"] == "allow"
    assert by_host["new.two.com"]["good_rate"] < by_host[""]["good_rate"]


def test_without_outcomes_or_pages(spark):
    none = spark.createDataFrame([], "url string, good int")
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert [r["verdict"] for r in urls.judge(pages, none, RULES).collect()] == ["block"]
    assert [r["verdict"] for r in urls.judge(pages, none, []).collect()] == ["allow"]
    assert urls.judge(pages.limit(0), none, RULES).collect() == []
