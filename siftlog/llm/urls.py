"""URL filter: rules first, then a tree of path templates per host.

The tree grows level by level.  At each node

1. a segment with a digit becomes the wildcard ``*``; so does, in a node with more than
   ``MAX_BRANCHES`` different ones, each that has less than 1 / ``MAX_BRANCHES`` of the node's pages;
2. branches whose share of blocked labels does not differ from that of
   their node by more than Hoeffding's bound merge into one branch ``~``, branches without labels into ``?``;
3. the purity of a branch is its blocked share, smoothed towards its parent's; that of a host is smoothed
   towards 0, so a host without labels is not blocked.  A branch without labels has its parent's purity.

A page is rejected when the purity of its template reaches ``MIN_PURITY``.  Everything is
grouping and joining of counts; a large host is just many counted rows, and its
rows meet their template by a size-checked or salted join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import lookup_join, stage

# The rules of the task, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MAX_BRANCHES = 32
CONFIDENCE = 0.05             # of the bound that keeps branches apart
SMOOTHING = 2.0               # labels that a parent counts for
MIN_PURITY = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.when(url.contains("://"), F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for decision, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(decision))
    return rule, verdict


def _purity(blocked: Column, labelled: Column, prior: Column, smoothing: float) -> Column:
    return (blocked + smoothing * prior) / (labelled + smoothing)


def with_templates(pages: DataFrame, max_branches: int = MAX_BRANCHES, smoothing: float = SMOOTHING) -> DataFrame:
    """``pages`` (``host``, ``path``, ``bad``: true, false or null where unlabelled) with ``template`` and ``purity``."""
    names = pages.columns
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = stage(pages.select(*names, segments.alias("_s"), F.lit("").alias("template")))
    labelled, blocked = F.count("bad").alias("l"), F.count_if("bad").alias("b")
    depth = rows.agg(F.max(F.size("_s"))).first()[0]
    hosts = rows.groupBy("host").agg(labelled, blocked)
    hosts = stage(hosts.select("host", _purity(F.col("b"), F.col("l"), F.lit(0.0), smoothing).alias("purity")))
    rows = lookup_join(rows, hosts, ["host"])
    bound = math.sqrt(math.log(2 / CONFIDENCE) / 2)
    for level in range(depth or 0):
        seg = F.get("_s", F.lit(level))
        rows = stage(rows.withColumn("_g", seg))
        deep = rows.filter(F.col("_g").isNotNull())
        nodes = stage(deep.groupBy("host", "template", "_g").agg(F.count(F.lit(1)).alias("n"), labelled, blocked, F.first("purity").alias("prior")))
        parents = nodes.groupBy("host", "template").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("pn"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        wide = lookup_join(nodes, stage(parents), ["host", "template"])
        rare = (F.col("k") > max_branches) & (F.col("n") * max_branches < F.col("pn"))
        wide = stage(wide.withColumn("token", F.when(F.col("_g").rlike("[0-9]") | rare, "*").otherwise(F.col("_g"))))
        branch = wide.groupBy("host", "template", "token").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("pl").alias("pl"), F.first("pb").alias("pb"))
        apart = F.abs(F.col("b") / F.col("l") - F.col("pb") / F.col("pl")) > bound * (1 / F.sqrt("l") + 1 / F.sqrt("pl"))
        branch = stage(branch.withColumn("name", F.when(F.col("l") == 0, "?").when(apart, F.col("token")).otherwise("~")).select("host", "template", "token", "name"))
        wide = lookup_join(wide, branch, ["host", "template", "token"])
        merged = wide.groupBy("host", "template", "name").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("prior").alias("prior"))
        merged = stage(merged.select("host", "template", "name", _purity(F.col("b"), F.col("l"), F.col("prior"), smoothing).alias("next")))
        step = lookup_join(wide.select("host", "template", "_g", "name"), merged, ["host", "template", "name"])
        step = stage(step.select("host", "template", "_g", F.concat_ws("/", "template", "name").alias("longer"), "next"))
        moved = lookup_join(deep, step, ["host", "template", "_g"]).select(
            *names, "_s", F.col("longer").alias("template"), F.col("next").alias("purity"))
        rows = rows.filter(F.col("_g").isNull()).select(*names, "_s", "template", "purity").unionByName(moved)
    return rows.select(*names, "template", "purity")


def judge_pages(pages: DataFrame, rules=RULES, min_purity: float = MIN_PURITY, max_branches: int = MAX_BRANCHES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row.

    The verdict is the rule's where one fits; the pages with a rule are
    the labels of the tree, and other pages are blocked when the purity of their template
    reaches ``min_purity``.  A null url, or one without ``://``, has an empty host and path and is judged like other
    pages of that host.  Rows with equal ids and null ids stay; without any labels nothing is blocked.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    given = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    given = given.select("*", rule.alias("rule"), (verdict == "block").alias("bad"))
    judged = with_templates(given, max_branches)
    own = F.when(F.col("purity") >= min_purity, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule",
                         F.when(F.col("bad"), "block").when(~F.col("bad"), "allow").otherwise(own).alias("verdict"), "template", "purity")
