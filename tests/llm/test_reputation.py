"""Host reputation against a plain version of the same priors, and rules against a loop."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpora import CLASHES
from logquarry.llm.reputation import DEVIATIONS, LIMIT, Rule, judged_pages, outcomes_of, suffix_of, domain_of

RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("b.co.uk", "", "block")]


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def groups_of(host):
    if re.fullmatch(r"[0-9.:]*", host):
        return host, host, host
    parts = host.split(".")
    wide = ".".join(parts[-2:]) in ("co.uk", "com.au")
    return ".".join(parts[-1 - wide :]), ".".join(parts[-2 - wide :]), host


def plain(pages, bad):
    """``host -> bound`` by the definition."""
    counts = defaultdict(lambda: [0, 0])
    for i, url in pages:
        own = counts[parse(url)[0]]
        if i in bad:
            own[0] += 1
            own[1] += bad[i]
    mean = {(): (sum(b for _, b in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1)}
    for level in range(3):
        groups = defaultdict(lambda: [0, 0])
        for host, (n, b) in counts.items():
            key = groups_of(host)[: level + 1]
            groups[key][0] += n
            groups[key][1] += b
        found = expected = pairs = 0
        for key, (n, b) in groups.items():
            m = mean[key[:-1]]
            if n:
                found += (b - n * m) ** 2 / n
                expected += m * (1 - m)
                pairs += m * (1 - m) * (n - 1)
        rho = min(0.9, max(1e-4, (found - expected) / pairs)) if pairs else 0.5
        weight = (1 - rho) / rho
        sizes = {key: n + weight for key, (n, _) in groups.items()}
        mean |= {key: (b + weight * mean[key[:-1]]) / (n + weight) for key, (n, b) in groups.items()}
    return {h[-1]: mean[h] - DEVIATIONS * math.sqrt(mean[h] * (1 - mean[h]) / (sizes[h] + 1)) for h in sizes}


def verdict(url, bounds):
    host, path = parse(url)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = max(fit, key=lambda r: (len(r.host), len(r.path)))
        return best.host + best.path, best.verdict
    return None, "block" if bounds[host] > LIMIT else "allow"


def make(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string")
    return df.selectExpr("*", *[f"cast(null as string) as `{name}`" for name in [*CLASHES, "host", "bad", "rules", "a.b"]])


def outcomes(spark, bad):
    return spark.createDataFrame(list(bad.items()), "id long, bad int")


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    hosts = [f"h{i}.d{i % 5}.{rng.choice(['com', 'net', 'co.uk'])}" for i in range(40)] + ["bad.example.net", "good.example.net", "One.ORG", "10.0.0.1:80"]
    rows, bad = [], {}
    for i in range(1500):
        host = rng.choice(["bad.example.net"] * 3 + hosts)
        rows.append((i, f"https://{host}/{rng.choice(['es/', 'en/', ''])}{i}?q=http://x.org/#y"))
        if rng.random() < 0.4:
            bad[i] = int(rng.random() < (0.95 if "bad" in host else 0.1))
    return rows, bad


def test_against_brute_force(spark, pages):
    rows, bad = pages
    bounds = plain(rows, bad)
    got = judged_pages(make(spark, rows), outcomes(spark, bad), RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "bad_bound"]
    found = {r.page_id: r for r in got.collect()}
    assert len(found) == len(rows)
    for i, url in rows:
        r = found[i]
        assert (r.host, r.path) == parse(url) and (r.rule, r.verdict) == verdict(url, bounds)
        assert r.bad_bound == pytest.approx(bounds[r.host], abs=1e-9)
    blocked = {r.host for r in found.values() if r.verdict == "block" and r.rule is None}
    assert blocked == {"bad.example.net"}


def test_few_bad_pages_block_nothing(spark):
    rows = [(i, f"http://h{i % 50}.example.com/{i}") for i in range(500)] + [(900, "http://new.example.com/x")]
    got = judged_pages(make(spark, rows), outcomes(spark, {i: 0 for i in range(400)} | {900: 1}))
    assert {r.verdict for r in got.collect()} == {"allow"}


def test_rules_and_odd_urls(spark):
    urls = [
        None, "", "no host", "://", "http://", "x://A.example.ORG", "x://A.example.ORG/es/1", "x://example.org/en/12", "x://example.org?/es/",
        "x://notexample.org/es/", "x://org/", "x://b.co.uk", "x://a.b.co.uk/p#/q", "x://bb.co.uk", "x://É.org/\nes", "x://a://b/c", "x://u@h:1/#",
        "x://" + "a." * 3000 + "org/" + "p" * 50_000,
    ]
    rows = [(None, u) for u in urls[:3]] + [(i, u) for i, u in enumerate(urls)] + [(5, urls[5]), (5, urls[6])]
    found = judged_pages(make(spark, rows), outcomes(spark, {2: 0}), RULES).collect()
    bounds = {r.host: r.bad_bound for r in found}
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found], key=key) == sorted(
        [(i, *parse(u), *verdict(u, bounds)) for i, u in rows], key=key
    )
    assert judged_pages(make(spark, []), outcomes(spark, {})).collect() == []
    assert {r.verdict for r in judged_pages(make(spark, rows), outcomes(spark, {})).collect()} == {"allow"}


def test_groups_and_outcomes(spark):
    hosts = ["a.b.c.com", "com", "", "x.co.uk", "w.x.co.uk", "co.uk", "10.0.0.1"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", suffix_of("host"), domain_of("host")).collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("com", "c.com"), ("com", "com"), ("", ""), ("co.uk", "x.co.uk"), ("co.uk", "x.co.uk"), ("co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1"),
    ]
    labels = [(1, 1, 0), (2, 0, 0), (3, None, 1), (4, None, None), (None, 0, 1), (5, 1, 0), (5, 0, None)]
    got = outcomes_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r) for r in got} == {(1, 0), (2, 1), (3, 1), (5, 1)}


def test_no_python_on_the_path(spark, pages):
    rows, bad = pages
    spark.createDataFrame(rows, "page_id long, url string").write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir', '/tmp')}/reputation-pages")
    df = judged_pages(spark.read.parquet(path), spark.range(100).select("id", F.lit(0).alias("bad")), RULES)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
