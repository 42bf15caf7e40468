"""URL filters from labelled examples: a path-template tree of each host, in DataFrame operations only.

Paths of a host are taken apart segment by segment. At a node, segments that few of its paths share become a wildcard of
their shape; the others stay as they are, so a node has a bounded number of branches. Branches whose labels and whose next
segments' shapes don't tell them apart, by Hoeffding's bound, are merged. What can't be divided further is a template; it is
rejected where its labelled paths, smoothed, are bad nearly always.

A node is counted from its branches and those from its distinct paths, map-side first, and totals come back in salted parts:
no task holds a host. A step ends in a written table; there are as many steps as the deepest node that is worth dividing
has segments, runs of segments that all paths of a node share counted as one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koine.llm.common import cut, with_totals

#: Shapes of a segment, from special to general; the first that fits names a wildcard.
SHAPES = {"{end}": "^$", "{n}": "^[0-9]+$", "{n}.ext": r"^[0-9]+\.[A-Za-z0-9]+$", "{hex}": "^[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*$", "{id}": "[0-9]", "{word}": ""}
#: A segment stays as it is if at least this share of a node's paths has it, and so many of them: a node has at most
#: 1 / SHARE such branches, and one for each shape.
SHARE, LEAST = 1 / 20, 3
#: Paths that a node needs to be divided.
DIVIDED = 8
#: Paths of a node that share a salt in joins; parts in which a path's rows are counted.
SALT, SALTS = 20_000, 32

#: Rules of the query, (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without one or for null."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does: a rule fits its host and all below it, and paths
    that start with its own. Of rules of one length the first as text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shape(segment: Column) -> Column:
    out = F.lit(list(SHAPES)[-1])
    for name, pattern in reversed(list(SHAPES.items())[:-1]):
        out = F.when(segment.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _far(a: Column, n: Column, b: Column, m: Column, delta: float) -> Column:
    """Whether shares a of n and b of m differ beyond Hoeffding's bound; never where either counts nothing."""
    bound = math.sqrt(math.log(2 / delta) / 2) * (1 / F.sqrt(n) + 1 / F.sqrt(m))
    return F.coalesce(F.abs(a / n - b / m) > bound, F.lit(False))


def _add(x: Column, y: Column) -> Column:
    names = ("paths", "labelled", "bad")
    return F.struct(*[(x[c] + y[c]).alias(c) for c in names], F.zip_with(x["next"], y["next"], lambda p, q: p + q).alias("next"))


def _merged(branches: Column, delta: float) -> Column:
    """Branches of a node, in a fixed order, each put to the first group that it isn't told apart from. A list of
    (names, total) groups."""
    alone = lambda b: F.struct(F.array(b["branch"]).alias("names"), b["total"].alias("total"))

    def alike(group: Column, b: Column) -> Column:
        g, t = group["total"], b["total"]
        told = _far(g["bad"], F.nullif(g["labelled"], F.lit(0)), t["bad"], F.nullif(t["labelled"], F.lit(0)), delta)
        shapes = F.exists(F.arrays_zip(g["next"].alias("p"), t["next"].alias("q")), lambda z: _far(z["p"], g["paths"], z["q"], t["paths"], delta))
        return ~told & ~shapes

    def put(groups: Column, b: Column) -> Column:
        at = F.array_position(F.transform(groups, lambda g: alike(g, b)), True)
        grown = F.transform(
            groups, lambda g, i: F.when(i + 1 == at, F.struct(F.concat(g["names"], F.array(b["branch"])).alias("names"), _add(g["total"], b["total"]).alias("total"))).otherwise(g)
        )
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(alone(b))))

    return F.aggregate(F.slice(branches, 2, 1 << 20), F.transform(F.slice(branches, 1, 1), alone), put)


def _label(names: Column) -> Column:
    return F.when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("{"), F.array_join(F.array_sort(names), "|"), F.lit("}")))


def _divided(active: DataFrame, delta: float) -> DataFrame:
    """One step: paths of nodes that are worth it go to a branch each; columns as they came, without the nodes' totals."""
    low, high = F.split("low", "/"), F.split("high", "/")
    shared = F.array_position(F.zip_with(low, high, lambda p, q: ~p.eqNullSafe(q)), True).cast("int") - 1  # low and high differ
    segments = F.split("rest", "/")
    at = lambda k: F.coalesce(F.get(F.col("segments"), F.col("shared") + k), F.lit(""))
    rows = active.withColumns({"shared": shared, "segments": segments})
    rows = rows.withColumns({"segment": at(0), "next": shape(at(1))})

    counts = {"paths": F.sum("rows"), "labelled": F.sum("labelled"), "bad": F.sum("bad")}
    following = F.array(*[F.sum(F.when(F.col("next") == name, F.col("rows")).otherwise(0)) for name in SHAPES])
    children = rows.groupBy("host", "node", "segment").agg(F.max("n_rows").alias("n_rows"), *[c.alias(k) for k, c in counts.items()], following.alias("next"))
    usual = (F.col("paths") >= F.col("n_rows") * SHARE) & (F.col("paths") >= LEAST) & (F.col("segment") != "")
    children = children.withColumn("branch", F.when(usual, F.col("segment")).otherwise(shape(F.col("segment"))))
    summed = [F.sum(c).alias(c) for c in counts]
    branches = children.groupBy("host", "node", "branch").agg(
        F.max("n_rows").alias("n_rows"), F.max("segment").alias("literal"), *summed, F.array(*[F.sum(F.col("next")[i]) for i in range(len(SHAPES))]).alias("next")
    )
    entry = F.struct((-F.col("paths")).alias("order"), "branch", F.struct("paths", "labelled", "bad", "next").alias("total"))
    literal = F.when(F.col("literal") == F.col("branch"), F.col("branch"))
    nodes = branches.groupBy("host", "node").agg(F.max("n_rows").alias("n_rows"), F.sort_array(F.collect_list(entry)).alias("all"), F.collect_set(literal).alias("literals"))
    nodes = cut(nodes.select("host", "node", "n_rows", "literals", F.transform(_merged(F.col("all"), delta), lambda g: g["names"]).alias("groups")), "nodes")

    salts = (F.col("n_rows") / SALT).cast("long") + 1
    nodes = nodes.select("host", "node", "literals", "groups", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("path"), salts)).join(nodes, ["host", "node", "salt"])
    branch = F.when(F.array_contains("literals", F.col("segment")), F.col("segment")).otherwise(shape(F.col("segment")))
    rows = rows.withColumn("branch", branch)
    rows = rows.withColumn("label", _label(F.filter("groups", lambda g: F.array_contains(g, F.col("branch")))[0]))
    left = F.slice("segments", F.col("shared") + 2, 1 << 30)
    before = F.array_join(F.slice("segments", 1, F.col("shared")), "/")
    ended = F.size("segments") <= F.col("shared") + 1
    template = F.concat("template", before, F.when(F.col("shared") > 0, "/").otherwise(""), "label", F.when(ended, "").otherwise("/"))
    return rows.select(
        "host", "path", "rows", "labelled", "bad", F.array_join(left, "/").alias("rest"), ended.alias("ended"), F.xxhash64("node", F.col("shared"), F.col("label"), ended).alias("node"), template.alias("template")
    )


def path_templates(paths: DataFrame, delta: float = 0.05) -> DataFrame:
    """host, path, template, t_labelled, t_bad: the template of each of paths(host, path, rows, labelled, bad), with the
    labelled rows of all its paths and the bad ones among them.

    A row a distinct path; nothing is null; counts are longs. A template names literal segments, wildcards ({n}, {n}.ext,
    {hex}, {id}, {word}, {end}), merged branches as {a|b}, and as ** what isn't divided further.
    """
    slash = F.col("path").startswith("/")
    state = paths.select(
        "host", "path", "rows", "labelled", "bad", F.when(slash, F.substring("path", 2, 1 << 30)).otherwise(F.col("path")).alias("rest"), (F.col("path") == "").alias("ended"),
        F.lit(0).cast("long").alias("node"), F.when(slash, "/").otherwise("").alias("template"),
    )
    state, done = cut(state, "paths"), []
    keep = ("host", "path", "labelled", "bad", "node", "template")
    while True:
        done.append(state.filter("ended").select(*keep))
        whole = {"n_rows": F.sum("rows"), "n_labelled": F.sum("labelled"), "low": F.min("edge"), "high": F.max("edge")}
        totals = {"n_rows": F.sum("n_rows"), "n_labelled": F.sum("n_labelled"), "low": F.min("low"), "high": F.max("high")}
        open_ = state.filter("not ended").withColumn("edge", F.concat("rest", F.lit("/")))
        open_ = cut(with_totals(open_, ["host", "node"], "path", whole, totals), "open")
        worth = (F.col("n_rows") >= DIVIDED) & (F.col("n_labelled") > 0) & (F.col("low") != F.col("high"))
        only = F.col("low") == F.col("high")
        done.append(open_.filter(~worth).withColumn("template", F.concat("template", F.when(only, F.col("rest")).otherwise("**"))).select(*keep))
        active = open_.filter(worth)
        if active.isEmpty():
            break
        state = cut(_divided(active, delta), "paths")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    counted = with_totals(out, ["host", "node", "template"], "path", {"t_labelled": F.sum("labelled"), "t_bad": F.sum("bad")}, {"t_labelled": F.sum("t_labelled"), "t_bad": F.sum("t_bad")})
    return counted.select("host", "path", "template", "t_labelled", "t_bad")


def judge_urls(urls: DataFrame, threshold: float = 0.8, strength: float = 2.0, delta: float = 0.05) -> DataFrame:
    """urls(host, path, said, ...) with `template`, `purity` and `judged`: allow or block, by the host's templates.

    said: true where a row is labelled bad, false where good, null where it isn't labelled. A template's purity is the bad
    share of its labelled rows, smoothed by `strength` rows of the overall share, of one half at most; from `threshold` on it is rejected. A null
    host or path counts as empty. Columns named as those added are replaced. Empty table: no rows.
    """
    own = ("template", "purity", "judged")
    base = urls.drop(*own).withColumns({"__host": F.coalesce("host", F.lit("")), "__path": F.coalesce("path", F.lit("")), "__lot": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))})
    base = cut(base, "urls")
    counts = [F.count("*").alias("rows"), F.count("said").alias("labelled"), F.count_if("said").alias("bad")]
    parts = cut(base.groupBy(F.col("__host").alias("host"), F.col("__path").alias("path"), "__lot").agg(*counts), "url-parts")
    paths = parts.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("rows", "labelled", "bad")])
    total = paths.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("n")).first()
    usual = min(0.5, total.b / total.n) if total.n else 0.0  # nothing is rejected by what others are like alone
    found = path_templates(paths, delta).withColumn("purity", (F.col("t_bad") + strength * usual) / (F.col("t_labelled") + strength))
    named = parts.select("host", "path", "__lot").join(found, ["host", "path"])  # SALTS rows of a path at most
    named = named.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "__lot", "template", "purity")
    judged = base.join(named, ["__host", "__path", "__lot"]).withColumn("judged", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return judged.select(*[c for c in urls.columns if c not in own], *own)


def url_report(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of pages(page_id, url).

    A row that a rule fits has the rule's verdict; these verdicts are the labels that the templates of the other rows are
    judged by. A null url, or one without `://`, has an empty host and path and no rule. Repeated rows are judged each and
    count each; other columns are ignored, whatever their names. Empty table: no rows.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "given": verdict})
    judged = judge_urls(urls.withColumn("said", F.col("given") == "block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", "judged").alias("verdict"), "template", "purity")
