import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from koine.llm import url_filter as uf

URLS = {
    "http://WWW.Example.COM/en/1?x#y": ("www.example.com", "/en/1"), "a://b://c/d": ("b:", "//c/d"), "http://É.Com:80/": ("É.com:80", "/"), "x.com/en/": ("", ""), "": ("", ""), None: ("", ""),
    "http://h": ("h", ""), "http://h?q/p": ("h", ""), "http://h#f": ("h", ""), "http://h/a#b/c?d": ("h", "/a"), "http://": ("", ""), "s://h/a\nb?c": ("h", "/a\nb"), "://net/es/1": ("net", "/es/1"),
}
RULED = {
    ("www.example.com", "/en/1"): ("www.example.com/en/", "allow"), ("a.www.example.com", "/en/"): ("www.example.com/en/", "allow"), ("m.example.com", "/en/1"): ("example.com/en/", "block"),
    ("example.com", "/en"): ("com/", "allow"), ("badexample.com", "/en/1"): ("com/", "allow"), ("a.net", "/es/x"): ("net/es/", "block"), ("net", "/fr/"): ("net/fr/", "block"),
    ("a.net", "/en/"): (None, None), ("com", ""): (None, None), ("xnet", "/es/"): (None, None), ("", ""): (None, None),
}


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    assert {r.url: (r.h, r.p) for r in df.select("url", uf.host_of(df.url).alias("h"), uf.path_of(df.url).alias("p")).collect()} == URLS
    df = spark.createDataFrame(list(RULED), "host string, path string")
    rule, verdict = uf.ruled(F.col("host"), F.col("path"))
    assert {(r.host, r.path): (r.r, r.v) for r in df.select("*", rule.alias("r"), verdict.alias("v")).collect()} == RULED


def shape(s):
    return next(name for name, pattern in uf.SHAPES.items() if re.search(pattern, s))


def far(a, n, b, m, delta):
    return bool(n and m) and abs(a / n - b / m) > math.sqrt(math.log(2 / delta) / 2) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


def plain_templates(paths, delta=0.05):
    """The tree by recursion. paths: {(host, path): (rows, labelled, bad)}."""
    out = {}

    def leaf(host, items, template_of):
        for path, rest in items:
            out[host, path] = template_of(rest)

    def divide(host, prefix, items):
        n = sum(paths[host, p][0] for p, _ in items)
        labelled = sum(paths[host, p][1] for p, _ in items)
        if len({r for _, r in items}) == 1:
            return leaf(host, items, lambda r: prefix + r)
        if n < uf.DIVIDED or not labelled:
            return leaf(host, items, lambda r: prefix + "**")
        split = [(p, r.split("/")) for p, r in items]
        k = 0
        while len({tuple(s[: k + 1]) for _, s in split if len(s) > k}) == 1 and all(len(s) > k for _, s in split):
            k += 1
        common = "/".join(split[0][1][:k]) + ("/" if k else "")
        at = lambda s, i: s[i] if i < len(s) else ""
        held = Counter()
        for p, s in split:
            held[at(s, k)] += paths[host, p][0]
        literals = {x for x, c in held.items() if x and c >= n * uf.SHARE and c >= uf.LEAST}
        branch = lambda s: at(s, k) if at(s, k) in literals else shape(at(s, k))
        counts, following = defaultdict(lambda: [0, 0, 0]), defaultdict(Counter)
        for p, s in split:
            for i in range(3):
                counts[branch(s)][i] += paths[host, p][i]
            following[branch(s)][shape(at(s, k + 1))] += paths[host, p][0]
        groups = []
        for b in sorted(counts, key=lambda b: (-counts[b][0], b)):
            c, f = counts[b], following[b]
            for g in groups:
                if not far(g[1][2], g[1][1], c[2], c[1], delta) and not any(far(g[2][x], g[1][0], f[x], c[0], delta) for x in uf.SHAPES):
                    g[0].append(b)
                    g[1] = [x + y for x, y in zip(g[1], c, strict=True)]
                    g[2] = g[2] + f
                    break
            else:
                groups.append([[b], c, f])
        for names, _, _ in groups:
            label = names[0] if len(names) == 1 else "{" + "|".join(sorted(names)) + "}"
            own = [(p, s) for p, s in split if branch(s) in names]
            for p, s in own:
                if len(s) <= k + 1:
                    out[host, p] = prefix + common + label
            if more := [(p, "/".join(s[k + 1 :])) for p, s in own if len(s) > k + 1]:
                divide(host, prefix + common + label + "/", more)

    by_host = defaultdict(list)
    for host, path in paths:
        by_host[host].append(path)
    for host, own in by_host.items():
        for prefix in ("/", ""):
            if items := [(p, p[len(prefix) :]) for p in own if p and p.startswith("/") == bool(prefix)]:
                divide(host, prefix, items)
        if "" in own:
            out[host, ""] = ""
    return out


def random_paths(seed):
    rng, paths = random.Random(seed), {}
    for _ in range(1500):
        host = rng.choice(["hot", "hot", "hot", "b", "c", ""])
        kind = rng.choice(["en", "de", "fr", "tags", "x" + str(rng.randrange(50))])
        tail = rng.choice([str(rng.randrange(300)), f"{rng.randrange(30)}.html", "about", "", f"a{rng.randrange(9)}/deep/{rng.randrange(5)}", "ffee-12"])
        path = rng.choice([f"/shared/run/{kind}/{tail}", f"/{kind}/{tail}", f"/{kind}"] if host == "b" else [f"/{kind}/{tail}", f"/{kind}/{tail}/"])
        if rng.random() < 0.02:
            path = ""
        rows, bad = rng.choice([1, 1, 1, 9]), kind in ("en", "tags")
        labelled = rows if rng.random() < 0.6 and kind != "fr" else 0
        paths.setdefault((host, path), (rows, labelled, labelled * bad))
    return paths


@pytest.mark.parametrize("seed", [1, 2])
def test_templates_against_the_plain_tree(spark, seed):
    paths = random_paths(seed)
    df = spark.createDataFrame([(*k, *v) for k, v in paths.items()], "host string, path string, rows long, labelled long, bad long").repartition(3)
    got = {(r.host, r.path): r for r in uf.path_templates(df).collect()}
    want = plain_templates(paths)
    assert {k: r.template for k, r in got.items()} == want
    assert any("|" in t for t in want.values()) and any("{n}" in t for t in want.values()) and any(t.endswith("**") for t in want.values())
    labelled, bad = Counter(), Counter()
    for (host, path), t in want.items():
        labelled[host, t] += paths[host, path][1]
        bad[host, t] += paths[host, path][2]
    assert all((r.t_labelled, r.t_bad) == (labelled[h, r.template], bad[h, r.template]) for (h, _), r in got.items())


def test_salted_joins_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(uf, "SALT", 7)
    paths = random_paths(3)
    df = spark.createDataFrame([(*k, *v) for k, v in paths.items()], "host string, path string, rows long, labelled long, bad long")
    assert {(r.host, r.path): r.template for r in uf.path_templates(df).collect()} == plain_templates(paths)


def test_verdicts(spark):
    rows = [(i, f"https://a.net/es/{i}") for i in range(20)] + [(100 + i, f"https://a.net/en/{i}") for i in range(5)] + [(200 + i, f"https://b.org/en/{i}") for i in range(20)]
    rows += [(300, None), (300, None), (None, "nothing"), (301, "https://m.example.com/en/1"), (302, "https://long.org/" + "x/" * 20000 + "?q")]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "1 as template", "true as said", "2 as __lot").repartition(4)
    got = uf.url_report(df).collect()
    assert len(got) == len(rows)
    verdicts = {(r.host, r.verdict, r.rule) for r in got}
    assert verdicts == {("a.net", "block", "net/es/"), ("a.net", "block", None), ("b.org", "allow", None), ("", "allow", None), ("m.example.com", "block", "example.com/en/"), ("long.org", "allow", None)}
    assert sum(r.page_id == 300 for r in got) == 2
    assert uf.url_report(df.limit(0)).collect() == []
    one = spark.createDataFrame([(1, "http://x/")], "page_id long, url string")
    assert [tuple(r)[:5] for r in uf.url_report(one).collect()] == [(1, "x", "/", None, "allow")]


def test_very_deep_paths_that_all_share_end_soon(spark):
    deep = "d/" * 3000
    rows = [(i, f"http://a.net/es/{deep}{i % 40}") for i in range(60)] + [(99, f"http://a.net/en/{deep}7")]
    got = uf.url_report(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.verdict for r in got} == {"block"}
