from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from matchlens.llm import urlfilter


def slow_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, None, None)
    return host, path, best[1], best[2]


def test_rules_and_hosts(spark):
    urls = ["http://Example.NET/en/a?x#y", "https://a.example.net/EN/", "http://net", "http://net/", "ftp://evilnet/x", "http://x.example.com/de/1", "http://example.com/de", "http://b.org/fr/", "http://b.org?fr/", "no scheme", None, "", "://", "http://é.net/#", "a://b://c/d", "http://h?q://net/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rounds=1).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = slow_rule(u)
        assert got[i][:3] == (host, path, rule)
        assert verdict is None or got[i][3] == verdict


def slow_scores(edges, trusted, distrusted, rounds=10, d=0.85):
    out, into = defaultdict(float), defaultdict(float)
    for (a, b), w in edges.items():
        out[a] += w
        into[b] += w
    part = lambda x: {h: w / sum(x.values()) for h, w in x.items()} if isinstance(x, dict) else {h: 1 / len(x) for h in x}
    t, b = part(trusted), part(distrusted)
    t0, b0 = t, b
    for _ in range(rounds):
        nt, nb = defaultdict(float, {h: (1 - d) * v for h, v in t0.items()}), defaultdict(float, {h: (1 - d) * v for h, v in b0.items()})
        for (x, y), w in edges.items():
            nt[y] += d * t.get(x, 0) * w / out[x]
            nb[x] += d * b.get(y, 0) * w / into[y]
        t, b = nt, nb
    return t, b


def test_propagation(spark):
    links = {"http://good.example.net/en/": ["a.test", "A.test", "b.test"], "http://a.test/": ["b.test", "farm.test"], "http://farm.test/": ["bad.net", "bad.net", "a.test"], "http://far.test/": ["farm.test", "far.test"], "http://bad.net/": ["farm.test"], "http://lone.test/": []}
    pages = [(i, u, "".join(f'<a HREF="//{h}/x">' if k % 2 else f"<a href = 'https://{h}?q'>" for k, h in enumerate(hs)) + '<a href="/own">') for i, (u, hs) in enumerate(links.items())]
    pages.append((99, "http://a.test/2", None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("verdict", F.lit(1))
    got = {r.page_id: r for r in urlfilter.judge(df).collect()}
    edges = defaultdict(float)
    for u, hs in links.items():
        src = u.split("/")[2]
        for h in hs:
            if h.lower() != src:
                edges[(src, h.lower())] += 1
    t, b = slow_scores(edges, ["good.example.net"], ["bad.net"])
    for i, u, _ in pages:
        h = u.split("/")[2]
        assert abs(got[i].trust - t.get(h, 0)) < 1e-9 and abs(got[i].distrust - b.get(h, 0)) < 1e-9
        if slow_rule(u)[3] is None:
            assert got[i].verdict == ("block" if b.get(h, 0) > max(1e-9, t.get(h, 0)) else "allow")
    assert got[2].verdict == "block" and got[5].verdict == "allow"


def test_empty(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_verdicts_of_many_copies_and_far_hosts(spark):
    link = lambda h, n=1: f'<a href="//{h}/">' * n

    def verdicts(copies):
        pages = []
        for c in range(copies):
            pages += [(f"b{c}.net", ""), (f"heavy{c}.test", link(f"b{c}.net", 2000)), (f"light{c}.test", link(f"b{c}.net")), (f"heavier{c}.test", link(f"light{c}.test", 2000)), (f"lighter{c}.test", link(f"light{c}.test"))]
            pages += [(f"far{c}x{i}.test", link(f"far{c}x{i - 1}.test" if i else f"b{c}.net")) for i in range(14)] + [(f"lone{c}.test", "")]
        df = spark.createDataFrame([(i, f"http://{h}/", x) for i, (h, x) in enumerate(pages)], "page_id long, url string, html string")
        return [r.verdict for r in urlfilter.judge(df, rounds=None).orderBy("page_id").collect()]

    one = verdicts(1)
    assert one == ["block"] * 19 + ["allow"]
    assert verdicts(40) == one * 40


def test_seeds_of_both_kinds(spark):
    """A host with allowed and blocked pages is a seed of both, by their shares; which is more decides on its other pages."""
    rules = (("block", "test", "/bad/"), ("allow", "test", "/good/"))
    paths = {"mixed.test": ["good", "good", "bad", "x"], "worse.test": ["good", "bad", "bad", "x"], "fine.test": ["good", "x"]}
    pages = [(f"http://{h}/{p}/", "") for h, ps in paths.items() for p in ps]
    df = spark.createDataFrame([(i, u, x) for i, (u, x) in enumerate(pages)], "page_id long, url string, html string")
    got = urlfilter.judge(df, rules, rounds=None).where("rule is null").collect()
    assert {r.host: r.verdict for r in got} == {"mixed.test": "allow", "worse.test": "block", "fine.test": "allow"}
    t, b = slow_scores({}, {"mixed.test": 2 / 3, "worse.test": 1 / 3, "fine.test": 1.0}, {"mixed.test": 1 / 3, "worse.test": 2 / 3}, rounds=200)
    assert all(abs(r.trust - t[r.host] * 1.0) < 1e-5 and abs(r.distrust - b.get(r.host, 0)) < 1e-5 for r in got)


def test_large_graph(spark):
    """A generated graph of 100,000 edges, with a host that a third of the links lead to, against the plain rule."""
    rng = np.random.default_rng(9)
    n = 20_000
    src, dst = rng.integers(0, n, 100_000), np.where(rng.random(100_000) < 1 / 3, 7, rng.integers(0, n, 100_000))
    trusted, distrusted = {f"h{i}": 1.0 for i in range(0, 400, 2)}, {f"h{i}": 1.0 for i in range(1, 400, 2)}
    edges = Counter((f"h{a}", f"h{b}") for a, b in zip(src.tolist(), dst.tolist()) if a != b)
    links = spark.createDataFrame(pd.DataFrame([(a, b, float(w)) for (a, b), w in edges.items()], columns=["src", "dst", "w"]))
    seeds = spark.createDataFrame(pd.DataFrame([(f"h{i}", trusted.get(f"h{i}", 0.0), distrusted.get(f"h{i}", 0.0)) for i in range(400)], columns=["host", "trusted", "distrusted"]))
    got = {r.host: r for r in urlfilter.spread(links, seeds, rounds=6).collect()}
    t, b = slow_scores(edges, trusted, distrusted, rounds=6)
    hosts = {h for h, v in [*t.items(), *b.items()] if v > 0}
    assert set(got) == hosts and len(hosts) > n / 2
    assert all(abs(got[h].trust - t.get(h, 0)) < 1e-12 and abs(got[h].distrust - b.get(h, 0)) < 1e-12 for h in hosts)
