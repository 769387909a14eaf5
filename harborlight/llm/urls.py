"""URL filters by a path-template tree, in DataFrame functions only.

Rules label the urls they fit. For each host, paths become templates: segments are nodes of a tree;
digits become a placeholder, and a node whose children differ too much gets one wildcard child. Branches of a parent whose
labelled shares don't differ are judged together. A template is rejected if its smoothed share of
blocked pages is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.session import written

#: (host, path, verdict): a rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
#: A node gets a wildcard child if it has so many different children, and at least this share of its different paths.
MANY, VARIED = 12, 0.2
#: Pages that the next wider count is worth when a share is smoothed, the share from which a template is rejected, and
#: standard errors by which branches may differ and still be judged together.
SMOOTHING, REJECT, ALIKE = 5.0, 0.7, 1.5
#: The share of a host without any label.
NEUTRAL = 0.5


def with_parts(pages: DataFrame) -> DataFrame:
    """Add host (A-Z lower-cased) and path; both empty for null and where there is no '://'."""
    at = F.locate("://", F.col("url"))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    pages = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), "^[^?#]*", 0)
    pages = pages.withColumn("_host", host).withColumn("path", path)
    lower = F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", lower).drop("_rest", "_host")


def rule_for(rules: list[tuple[str, str, str]]) -> Column:
    """The rule that wins: the longest that fits; of equal length the one with the longer host, then the first by name."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    fits = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path),
            F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for host, path, verdict in ordered
    ]
    return F.coalesce(*fits)


def tokens(path: str) -> Column:
    """The segments of a path, all of them, digits replaced."""
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "{n}"))


def templates(counted: DataFrame) -> DataFrame:
    """Add `template` to rows (host, tokens, ...), one per path form: their tokens, wildcards where a node's children vary.

    Every segment is a node, known by a digest of the path down to it, so what is moved for a path grows with its segments.
    How often a page comes does not count: children are compared with different path forms.
    """
    key = lambda parts: F.sha2(F.array_join(parts, "/"), 256)
    keyed = counted.withColumn("tkey", key(F.col("tokens")))
    nodes = keyed.select("host", "tkey", "tokens", F.posexplode("tokens").alias("depth", "child")).select(
        "host", "tkey", "depth", "child", key(F.expr("slice(tokens, 1, depth)")).alias("parent")
    )
    children = nodes.groupBy("host", "parent", "child").agg(F.count("*").alias("n"))
    varied = (
        children.groupBy(F.col("host").alias("vhost"), F.col("parent").alias("vparent"))
        .agg(F.count("*").alias("different"), F.sum("n").alias("total"))
        .where((F.col("different") >= MANY) & (F.col("different") >= VARIED * F.col("total")))
        .withColumn("wild", F.lit(True))
    )
    placed = (
        nodes.join(varied, (F.col("host") == F.col("vhost")) & (F.col("parent") == F.col("vparent")), "left")
        .groupBy(F.col("host").alias("thost"), F.col("tkey").alias("ttkey"))
        .agg(F.array_sort(F.collect_list(F.struct("depth", F.when(F.col("wild"), "*").otherwise(F.col("child")).alias("name")))).alias("names"))
    )
    joined = keyed.join(placed, (F.col("host") == F.col("thost")) & (F.col("tkey") == F.col("ttkey")), "left")
    names = F.transform("names", lambda x: x["name"])
    return joined.withColumn("template", F.coalesce(names, F.array().cast("array<string>"))).drop("tkey", "thost", "ttkey", "names")


def judged(counted: DataFrame) -> DataFrame:
    """Rows (host, tokens, n, blocked, labelled) with `share`: the smoothed share of blocked pages of their template.

    An empty table gives an empty one.
    """
    rows = templates(counted).withColumn("parent", F.expr("slice(template, 1, greatest(size(template) - 1, 0))"))
    sums = [F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")]
    smooth = lambda blocked, labelled, prior: (blocked + SMOOTHING * prior) / (labelled + SMOOTHING)
    by_template = rows.groupBy("host", "parent", "template").agg(*sums)
    by_parent = by_template.groupBy("host", "parent").agg(*sums)
    by_host = by_parent.groupBy("host").agg(*sums).select(
        "host", smooth(F.col("blocked"), F.col("labelled"), F.lit(NEUTRAL)).alias("host_share")
    )
    by_parent = by_parent.join(by_host, "host").select(
        "host", "parent", smooth(F.col("blocked"), F.col("labelled"), F.col("host_share")).alias("parent_share")
    )
    own = smooth(F.col("blocked"), F.col("labelled"), F.col("parent_share"))
    error = F.sqrt(F.col("parent_share") * (1 - F.col("parent_share")) / F.greatest("labelled", F.lit(1)))
    merged = F.when(F.abs(F.try_divide("blocked", "labelled") - F.col("parent_share")) > ALIKE * error, own).otherwise(F.col("parent_share"))
    shares = by_template.join(by_parent, ["host", "parent"]).select("host", "template", merged.alias("share"))
    return rows.drop("parent").join(shares, ["host", "template"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule (or null), verdict (allow or block), template.

    A rule's verdict holds for the urls it fits. Pages are counted by host and path form before anything is joined, so a host
    with a third of all pages is a few rows. Null urls have an empty host and path. Repeated pages
    count each time and get a row each. Without any label nothing else is rejected.
    """
    found = with_parts(pages.select("page_id", "url")).withColumn("_rule", rule_for(rules))
    found = found.withColumn("tokens", tokens("path"))
    counted = written(
        found.groupBy("host", "tokens").agg(
            F.count("*").alias("n"), F.count_if(F.expr("_rule.verdict = 'block'")).alias("blocked"), F.count("_rule").alias("labelled")
        ),
        "templates",
    )
    shares = judged(counted).select(F.col("host").alias("jhost"), F.col("tokens").alias("jtokens"), "template", "share")
    verdict = F.coalesce("_rule.verdict", F.when(F.col("share") >= REJECT, "block").otherwise("allow"))
    return found.join(shares, (F.col("host") == F.col("jhost")) & (F.col("tokens") == F.col("jtokens")), "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The columns that the registered query returns."""
    return found.select("page_id", "host", "path", "rule", "verdict", "template")
