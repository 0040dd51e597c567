"""URL filters (operator 10): a path-template tree per host, built-in
expressions only.

Fixed rules (host suffix plus path prefix, the longest wins) decide first.
The urls they decide are also the labels from which templates are learned for
all other urls (a table of labelled urls may be given instead):

1. Paths are cut into segments; numbers (with or without an ending such as
   ``.html``) and long hexadecimal names become wildcards, segments beyond
   ``depth`` are one rest wildcard.
2. Level by level, a node of a host's tree with at least ``min_labels``
   labelled children whose labelled shares do not differ (chi-square, over all
   and among paths with the same next segment) turns its children into one
   wildcard child (a variable segment).  Their number alone decides nothing.
3. On every level, siblings whose labelled shares do not differ significantly
   (pooled two-proportion z below ``z``) are merged into one branch, in order
   of their share.
4. From the host down, a branch's share of blocked labels is smoothed with the
   share above it, the host's with the overall share. Where the labels end, a
   template without labels takes the share of its last labelled ancestor's
   labelled children, each counted once (those of a wildcard as given): labels
   below one child do not speak for its sibling more than once.
5. A template is rejected when its share reaches ``purity`` on evidence of at
   least ``min_labels``: the labels of its branch, and one for each labelled
   sibling outside it and on the levels above.

Every step is an aggregate or join over distinct (host, path) pairs, counted
map-side first; windows run over the distinct shares below one node only.

Defined cases: a null url or one without ``://`` has empty host and path and
falls under no rule and no template: allow; an empty table gives no rows;
repeated rows count and are returned each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docrevise.llm.common import ascii_lower, col, stored

#: (verdict, rule): host, then path (fixed values).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEPTH = 6


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty without a ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        name, _, rest = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def segments(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments, variable shapes as wildcards."""
    def general(x: Column) -> Column:
        return (F.when(x.rlike(r"^[0-9]+$"), "*").when(x.rlike(r"^[0-9]+\.[a-z0-9]{1,5}$"), F.concat(F.lit("*"), F.regexp_extract(x, r"\.[a-z0-9]+$", 0)))
                .when(x.rlike(r"^[0-9a-f]{16,}$"), "*").otherwise(x))
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    head = F.transform(F.slice(parts, 1, depth), general)
    return F.when(F.size(parts) > depth, F.concat(head, F.array(F.lit("**")))).otherwise(head)


def learn_templates(labelled: DataFrame, depth: int = DEPTH, z: float = 1.96, min_labels: int = 5,
                    smoothing: float = 2.0, purity: float = 0.8) -> DataFrame:
    """host, raw (the segments as given), template, n_labels and n_blocked (of
    the template's branch), evidence, share (null on a host without labels)
    and reject, one row per distinct (host, raw) of ``labelled`` (columns
    host, path, blocked: true, false or null for no label)."""
    t = labelled.where("host <> ''").select("host", segments(F.col("path"), depth).alias("raw"), "blocked")
    t = t.groupBy("host", "raw").agg(F.count("blocked").alias("n"), F.count_if("blocked").alias("b"))
    t = stored(t.withColumn("template", F.col("raw")), "paths")
    for d in range(1, depth + 1):
        prefix, seg = F.slice("template", 1, d - 1), F.get("template", d - 1)
        here = t.select("*", prefix.alias("prefix"), seg.alias("seg"))
        wide = alike_children(here.where("seg is not null and n > 0"), d, z, min_labels)
        if wide.isEmpty():
            continue
        wide = stored(wide, "wide").withColumn("wide", F.lit(True))
        new = F.when(F.col("wide") & F.col("seg").isNotNull(), F.concat(
            F.col("prefix"), F.array(F.lit("*")), F.slice("template", d + 1, depth + 1))).otherwise(F.col("template"))
        t = stored(here.join(wide, ["host", "prefix"], "left").select("host", "raw", "n", "b", new.alias("template")), "paths")
    return t.select("host", "raw", "template").join(template_shares(t, z, min_labels, smoothing, purity), ["host", "template"], "left").select(
        "host", "raw", "template", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_labels", "n_blocked", "evidence")],
        "share", F.coalesce("reject", F.lit(False)).alias("reject"))


def alike_children(labelled: DataFrame, d: int, z: float, min_labels: int) -> DataFrame:
    """host and prefix of the nodes at depth ``d`` with at least ``min_labels``
    labelled children (column seg) whose labelled shares do not differ, neither
    as they are nor among paths with the same next segment."""
    def spread(df: DataFrame, *by: str) -> DataFrame:
        """Chi-square of the children's shares (x) and its degrees of freedom (df) per group."""
        g = df.groupBy("host", "prefix", *by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(F.col("b") * F.col("b") / F.col("n")).alias("bb"))
        p = F.col("b") / F.col("n")
        x = F.when((F.col("b") > 0) & (F.col("b") < F.col("n")), (F.col("bb") - F.col("n") * p * p) / (p * (1 - p))).otherwise(0.0)
        return g.select("host", "prefix", "k", x.alias("x"), (F.col("k") - 1).alias("df"))

    def same(x: str, df: str) -> Column:
        """``x`` is below the chi-square bound (Wilson-Hilferty) of ``z``."""
        v = F.lit(2.0) / (9 * F.greatest(F.col(df), F.lit(1)))
        return (F.col(df) < 1) | (F.col(x) <= F.col(df) * F.pow(1 - v + z * F.sqrt(v), F.lit(3)))

    pairs = labelled.groupBy("host", "prefix", "seg", F.coalesce(F.get("template", F.lit(d)), F.lit("")).alias("next")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    kids = spread(pairs.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    below = spread(pairs, "next").groupBy("host", "prefix").agg(F.sum("x").alias("next_x"), F.sum("df").alias("next_df"))
    return kids.where(F.col("k") >= min_labels).where(same("x", "df")).join(below, ["host", "prefix"]).where(same("next_x", "next_df")).select("host", "prefix")


def template_shares(t: DataFrame, z: float, min_labels: int, smoothing: float, purity: float) -> DataFrame:
    """host, template, n_labels, n_blocked, evidence, share and reject of the
    templates (columns host, raw, template, n, b) of every host with labels."""
    # a path ends in a child '' of its last segment; all prefixes are nodes
    def prefix(name: str):
        c = F.concat(name, F.array(F.lit("")))
        return lambda i: F.slice(c, F.lit(1), i)
    levels = F.sequence(F.lit(0), F.size("template") + 1)
    given = t.where("n > 0").select("host", F.explode(F.transform(levels, lambda i: F.struct(prefix("template")(i).alias("node"), prefix("raw")(i).alias("raw")))).alias("x"), "n", "b")
    given = given.groupBy("host", F.col("x.node").alias("node"), F.col("x.raw").alias("raw")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    # w: the labelled raw prefixes of a node, ps: the sum of their shares
    told = given.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("w"), F.sum(F.col("b") / F.col("n")).alias("ps"))
    told = stored(told.withColumn("parent", F.when(F.size("node") > 0, F.slice("node", F.lit(1), F.size("node") - 1))).withColumn("p", F.col("b") / F.col("n")), "nodes")
    total = told.where("parent is null").agg(F.coalesce(F.try_divide(F.sum("b"), F.sum("n")), F.lit(0.0)).alias("prior"))
    prior = total.first()["prior"]  # one number
    # siblings that the labels do not tell apart are one branch; equal shares are summed before the window
    siblings = told.where("parent is not null")
    equal = siblings.groupBy("host", "parent", "p").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("w").alias("w"))
    order = Window.partitionBy("host", "parent").orderBy("p")
    n0, b0 = F.lag("n").over(order), F.lag("b").over(order)
    pooled = (F.col("b") + b0) / (F.col("n") + n0)
    far = (F.col("p") - b0 / n0) > z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / n0))
    equal = equal.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("branch", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "parent", "branch")
    equal = equal.select("host", "parent", "p", *[F.sum(c).over(whole).alias("g" + c) for c in "nbw"])
    kids = siblings.groupBy(F.col("host"), F.col("parent").alias("node")).agg(F.sum("w").alias("kids"), F.sum("ps").alias("kid_p"))
    branches = siblings.join(equal, ["host", "parent", "p"]).select("host", "node", "w", "gn", "gb", "gw").unionByName(
        told.where("parent is null").select("host", "node", "w", F.col("n").alias("gn"), F.col("b").alias("gb"), F.col("w").alias("gw")))
    nodes = stored(branches.join(kids, ["host", "node"], "left").select(
        "host", "node", "w", "gn", "gb", "gw", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("kid_p", F.lit(0.0)).alias("kid_p")), "branches")
    # from the host down, every share is smoothed with the one above it
    steps = t.select("host", "template").distinct().select("host", "template", F.explode(F.transform(levels, prefix("template"))).alias("node")).join(nodes, ["host", "node"]).groupBy("host", "template").agg(
        F.sort_array(F.collect_list(F.struct(F.size("node").alias("level"), "w", "gn", "gb", "gw", "kids", "kid_p"))).alias("steps"))
    share = F.aggregate("steps", F.lit(prior).cast("double"), lambda p, x: (x["gb"] + smoothing * p) / (x["gn"] + smoothing))
    last = F.element_at("steps", -1)
    leaf = last["level"] == F.size("template") + 1
    # labelled siblings of every step
    beside = F.aggregate("steps", F.lit(0).cast("long"), lambda e, x: e + F.when(x["level"] < last["level"], x["kids"]).otherwise(0) - F.when(x["level"] > 0, x["w"]).otherwise(0))
    found = steps.select(
        "host", "template", F.when(leaf, last["gn"]).otherwise(0).alias("n_labels"), F.when(leaf, last["gb"]).otherwise(0).alias("n_blocked"),
        F.when(leaf, beside + last["w"] - last["gw"] + last["gn"]).otherwise(beside + last["kids"]).alias("evidence"),
        F.when(leaf, share).otherwise((last["kid_p"] + smoothing * share) / (last["kids"] + smoothing)).alias("share"))
    return found.withColumn("reject", (F.col("evidence") >= min_labels) & (F.col("share") >= purity))


def judge_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, id_col: str = "page_id", url: str = "url", **kw) -> DataFrame:
    """page_id, host, path, rule, verdict and template per row of ``pages``.
    ``labels`` (host, path, blocked) replaces the rules' own decisions as labels;
    the urls of ``pages`` take part without labels then."""
    p = pages.select(col(id_col).alias("page_id"), col(url).alias("url"))
    host, path = url_parts(F.col("url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    blocked = F.col("ruled") == "block" if labels is None else F.lit(None).cast("boolean")
    learnt = p.select("host", "path", blocked.alias("blocked"))
    if labels is not None:
        learnt = learnt.unionByName(labels.select("host", "path", "blocked"))
    t = stored(learn_templates(learnt, **kw).where("host <> ''"), "templates")
    # only rejected templates matter for the verdict: the small side of the join
    bad = t.where("reject").select(F.col("host").alias("t_host"), F.col("raw").alias("t_raw"), F.array_join("template", "/").alias("template"))
    j = p.join(bad, (F.col("host") == F.col("t_host")) & (segments(F.col("path"), kw.get("depth", DEPTH)) == F.col("t_raw")), "left")
    learned = F.when(F.col("template").isNotNull(), "block").otherwise("allow")
    return j.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template")
