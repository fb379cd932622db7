"""URL filters: rules by host and path, and a path-template tree for the rest.

Rules judge first. What no rule fits is judged by templates: per host, path
segments form a tree; variable segments become wildcards (by their look, or
because a branch has too many different children), labelled siblings whose
blocked shares don't differ significantly are merged, and a template is
rejected if its smoothed share of allowed pages is low. Pages that a rule fits
are the labelled ones, unless labels are given.

A template's share is smoothed towards what the same path shape shows on other
hosts: on those with the same last three labels, two, one, on all hosts, then
the shape's first segment, then all pages, each smoothed towards the next. So a
host without labels of its own follows its domain's, or that of its language branch.

The tree is built from one row per host and path shape, summed before it is
sent, so a hot host is a few shapes; every level is a grouping of those rows, and
a branch is followed only while it has labels and more than one shape. The
joins back are broadcasts while they are small, else joins of two written tables,
whose hot keys the engine splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, stored

#: (verdict, host, path); the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A branch with more children than this, or with so many that most stand for one page, is variable.
MAX_CHILDREN, FEW_CHILDREN = 64, 8
#: Smoothing: so many pages at the odds of the level above, even odds at the top; rejected below this share of allowed pages.
PRIOR, REJECT_BELOW = 2.0, 0.3
#: Siblings are merged unless they differ from the parent by so many standard errors.
SIGNIFICANT = 2.0
#: Hosts teach each other by so many last labels.
DOMAINS = (1, 2, 3)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null; of equally long ones the last of ``rules``."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def shape(path: Column) -> Column:
    """The segments, those that look variable as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    variable = r"^(?:[0-9][^a-zA-Z]*(?:\.[a-z]+)?|[0-9a-fA-F-]{16,}|.*[0-9].*[0-9].*[0-9].*|.{40,})$"
    return F.transform(parts, lambda s: F.when(s.rlike(variable), F.lit("*")).otherwise(s))


def priors(tree: DataFrame) -> DataFrame:
    """(host, shape, prior) from one row (host, shape, allowed, blocked) each: the smoothed share that other hosts show."""
    labels, whole, first = F.split("host", r"\."), F.array_join("shape", "/"), F.coalesce(F.get("shape", F.lit(0)), F.lit(""))
    key = lambda level, domain, path: F.struct(F.lit(level).alias("level"), domain.alias("domain"), path.alias("path"))
    domains = [F.when(F.size(labels) > k, key(2 + k, F.array_join(F.slice(labels, -k, k), "."), whole)) for k in DOMAINS]
    keys = F.filter(F.array(key(0, F.lit(""), F.lit("")), key(1, F.lit(""), first), key(2, F.lit(""), whole), *domains), lambda x: x.isNotNull())
    each = materialize(tree.select("host", "shape", "allowed", "blocked", F.explode(keys).alias("key")))
    sums = each.groupBy("key").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    joined = each.select("host", "shape", "key").join(maybe_broadcast(materialize(sums)), "key")
    chain = joined.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("key.level", "a", "b"))).alias("chain"))
    return chain.select("host", "shape", F.aggregate("chain", F.lit(0.5), lambda p, x: (x["a"] + PRIOR * p) / (x["a"] + x["b"] + PRIOR)).alias("prior"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, shape, template, purity) from rows of (host, shape, allowed, blocked, n).

    ``purity`` is the smoothed share of allowed pages among the labelled pages
    of the template.
    """
    tree = stored(pages.groupBy("host", "shape").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "allowed", "blocked")]))
    prior = stored(priors(tree))
    tree = tree.withColumn("path", F.array().cast("array<string>"))
    closed, level = [], 0
    while True:
        # branches with labels, several shapes and further segments
        nodes = tree.groupBy("host", "path").agg(F.count("*").alias("shapes"), F.sum(F.col("allowed") + F.col("blocked")).alias("labelled"), F.max(F.size("shape")).alias("longest"))
        opened = stored(nodes.where((F.col("shapes") > 1) & (F.col("labelled") > 0) & (F.col("longest") > level)).select("host", "path"))
        if not opened.take(1):
            closed.append(tree)
            break
        opened = maybe_broadcast(opened)
        closed.append(tree.join(opened, ["host", "path"], "left_anti"))
        own = tree.join(opened, ["host", "path"]).withColumn("child", F.coalesce(F.get("shape", F.lit(level)), F.lit("")))
        own = stored(own)
        children = stored(own.groupBy("host", "path", "child").agg(F.sum("n").alias("cn"), F.sum("allowed").alias("ca"), F.sum("blocked").alias("cb")))
        parents = children.groupBy("host", "path").agg(F.count("*").alias("many"), F.sum("cn").alias("pn"), F.sum("ca").alias("pa"), F.sum("cb").alias("pb"))
        labelled, all_labelled = F.col("ca") + F.col("cb"), F.col("pa") + F.col("pb")
        pooled = F.try_divide(F.col("pb"), all_labelled)
        error = F.sqrt(pooled * (1 - pooled) / F.greatest(labelled, F.lit(1.0)))
        variable = (F.col("many") > MAX_CHILDREN) | ((F.col("many") >= FEW_CHILDREN) & (F.col("many") > F.col("pn") / 2))
        similar = (labelled > 0) & (labelled < all_labelled) & (F.abs(F.try_divide(F.col("cb"), labelled) - pooled) <= SIGNIFICANT * error)
        name = F.when(F.col("child") == "", F.lit("")).when(variable | F.coalesce(similar, F.lit(False)), F.lit("*")).otherwise(F.col("child"))
        named = children.join(maybe_broadcast(stored(parents)), ["host", "path"]).select("host", "path", "child", name.alias("name"))
        grown = F.when(F.col("name") == "", F.concat("path", F.array(F.lit("")))).otherwise(F.concat("path", F.array("name")))
        tree = stored(own.join(maybe_broadcast(stored(named)), ["host", "path", "child"]).select("host", "shape", "n", "allowed", "blocked", grown.alias("path")))
        level += 1
    leaves = closed[0]
    for more in closed[1:]:
        leaves = leaves.unionByName(more)
    leaves = stored(leaves.select("host", "shape", "path", "allowed", "blocked"))
    sums = leaves.groupBy("host", "path").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    judged = leaves.join(maybe_broadcast(stored(sums)), ["host", "path"]).join(maybe_broadcast(prior), ["host", "shape"])
    purity = (F.col("a") + PRIOR * F.col("prior")) / (F.col("a") + F.col("b") + PRIOR)
    shown = F.concat(F.lit("/"), F.array_join(F.filter("path", lambda s: s != ""), "/"))
    return judged.select("host", "shape", shown.alias("template"), purity.alias("purity"))


def url_filter(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, label: str | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) for each row.

    A null url, or one without ``://``, has an empty host and path, no rule
    and, as nothing is known of it, the verdict of its template (the empty
    host's). ``label`` names a column of ``allow`` and ``block`` (else null)
    to learn templates from; without one the rules' own verdicts teach.
    Of rules of equal length the last wins. Repeated rows get equal results; an
    empty table gives an empty result. Other columns aren't read.
    """
    columns = [F.col(key), F.col(url).alias("url"), (F.col(label) if label else F.lit(None).cast("string")).alias("label")]
    parts = pages.select(*columns).select(key, "label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = parts.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path")))
    rows = materialize(rows.withColumn("label", F.coalesce("label", "best.verdict")))
    counted = rows.select("host", "shape", F.lit(1).alias("n"), (F.coalesce(F.col("label") == "allow", F.lit(False))).cast("int").alias("allowed"), (F.coalesce(F.col("label") == "block", F.lit(False))).cast("int").alias("blocked"))
    known = maybe_broadcast(materialize(templates(counted)))
    verdict = F.coalesce("best.verdict", F.when(F.col("purity") < REJECT_BELOW, "block").otherwise("allow"))
    return rows.join(known, ["host", "shape"], "left").select(key, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
