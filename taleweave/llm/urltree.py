"""URL filter by path-template trees.

Rules decide the URLs they fit.  For all others a tree of path templates is
grown for every host, level by level.  Segments that are plainly variable
(numbers, hexadecimal ids, dates) become wildcards at once.  Siblings are put in
order of their labelled share of blocked URLs; neighbours whose shares don't
differ significantly are merged, so a branch is compared with its siblings, and
segments that are rare on their host make one branch.  A section that stands
alone keeps its name; merged ones are called ``*``, with a number where there are
several such groups.  Where many are tested the level of significance is shared
among them, so chance alone splits no large fan-out.

What a host's own labels don't tell is taken from the same path on all hosts: a
branch's share is smoothed with the share of its path everywhere, and that with
the share of the branch above it.  So templates of hosts without labels have
purities of their own.  Templates at or over the threshold are rejected.  Labels
are the verdicts of the rules and any further labels given.

Everything is a DataFrame plan over aggregated templates; a host with a third
of all rows collapses before it meets in a join, and siblings meet as at most
``BINS`` sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.llm.frames import join_on
from taleweave.llm.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MANY_CHILDREN = 20  # with more children to test, their number divides the level of significance
LEAST_LABELS, LEAST_URLS = 5, 5  # segments with fewer of both make one branch
BINS = 256  # of shares, in which siblings are compared
Z_LIMIT = 1.96
PRIOR_WEIGHT = 4.0
REJECT_AT = 0.75


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path); both empty for null or without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of (verdict, host, path), else null."""
    rule = verdict = F.lit(None).cast("string")
    for said, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def general_segments(path: Column) -> Column:
    """The path's segments with plainly variable ones as wildcards."""
    # fixed values: patterns of variable segments, most special first
    patterns = (
        (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
        (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>"),
        (r"^[0-9]+(?=$|\.)", "<n>"),
        (r"^(?=[a-fA-F]*[0-9])[0-9a-fA-F]{8,}(?=$|\.)", "<hex>"),
        (r"[0-9]+", "<n>"),
    )

    def general(segment: Column) -> Column:
        for pattern, name in patterns:
            segment = F.regexp_replace(segment, pattern, name)
        return segment

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def z_limit(tested: Column) -> Column:
    """Z_LIMIT, or for more than MANY_CHILDREN tested children the quantile at 2.5 % divided by their number."""
    t = F.sqrt(-2 * F.log(F.lit(0.025) / tested))
    # Abramowitz and Stegun 26.2.23, within 0.00045
    strict = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(tested > MANY_CHILDREN, strict).otherwise(F.lit(Z_LIMIT))


def _merged(bins: Column, z: Column) -> Column:
    """[(bin, group)] of the bins (share, bin, blocked, labelled) of one parent, in order: a bin that doesn't differ from the group before joins it."""
    start = F.struct(F.lit(-1).alias("group"), F.lit(0.0).alias("blocked"), F.lit(0.0).alias("labelled"), F.array().cast("array<struct<bin:int,group:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        n, b = acc["labelled"] + x["labelled"], acc["blocked"] + x["blocked"]
        pooled = b / n
        spread = F.sqrt(pooled * (1 - pooled) * (1 / acc["labelled"] + 1 / x["labelled"]))
        differs = (acc["group"] < 0) | (F.abs(acc["blocked"] / acc["labelled"] - x["blocked"] / x["labelled"]) >= z * spread) & (spread > 0)
        group = F.when(differs, acc["group"] + 1).otherwise(acc["group"])
        out = F.concat(acc["out"], F.array(F.struct(x["bin"].alias("bin"), group.alias("group"))))
        return F.struct(group.alias("group"), F.when(differs, x["blocked"]).otherwise(b).alias("blocked"), F.when(differs, x["labelled"]).otherwise(n).alias("labelled"), out.alias("out"))

    return F.aggregate(bins, start, step, lambda acc: acc["out"])


def grow(urls: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(host, segments, n, labelled, blocked), one row each, to the same with ``template`` and ``purity``.

    Levels go on until paths end or a template holds a single path; ``max_depth`` may stop them earlier.
    """
    whole = urls.agg(F.sum("labelled"), F.sum("blocked")).first()
    base = (whole[1] or 0) / whole[0] if whole[0] else 0.0
    smoothed = lambda blocked, labelled, prior: (blocked + PRIOR_WEIGHT * prior) / (labelled + PRIOR_WEIGHT)
    sums = [F.sum(c).alias(f"{c}_sum") for c in ("n", "labelled", "blocked")]
    hosts = urls.groupBy("host").agg(*sums).select("host", smoothed(F.col("blocked_sum"), F.col("labelled_sum"), F.lit(base)).alias("purity"))
    rows = join_on(urls, hosts, ["host"]).withColumn("template", F.lit("")).withColumn("paths", F.lit(2).cast("long"))
    rows = written(rows, "templates-0")
    done, level = [], 0
    while True:
        level += 1
        # only paths that go on, and of templates with several
        goes_on = (F.size("segments") >= level) & (F.col("paths") > 1)
        rest = F.array_join(F.slice("segments", level, F.greatest(F.size("segments") - (level - 1), F.lit(0))), "/")
        single = (F.size("segments") >= level) & (F.col("paths") == 1)
        done.append(rows.where(~goes_on).withColumn("template", F.when(single, F.concat("template", F.lit("/"), rest)).otherwise(F.col("template"))))
        if level > (max_depth or 1 << 30) or rows.where(goes_on).isEmpty():
            done.append(rows.where(goes_on))
            return reduce(DataFrame.unionByName, done).drop("paths")
        here = rows.where(goes_on).withColumn("segment", F.get("segments", F.lit(level - 1))).withColumn("prefix", F.array_join(F.slice("segments", 1, level), "/"))
        everywhere = here.groupBy("prefix").agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
        children = here.groupBy("host", "template", "prefix", "segment").agg(*sums, F.first("purity").alias("above"))
        children = join_on(children, everywhere, ["prefix"])
        children = children.withColumn("prior", smoothed(F.col("all_blocked"), F.col("all_labelled"), F.col("above")))
        children = children.withColumn("b", F.col("blocked_sum") + PRIOR_WEIGHT * F.col("prior")).withColumn("l", F.col("labelled_sum") + PRIOR_WEIGHT)
        rare = (F.col("n_sum") < LEAST_URLS) & (F.col("labelled_sum") < LEAST_LABELS)
        children = children.withColumn("bin", F.when(rare, -1).otherwise(F.floor(F.col("b") / F.col("l") * (BINS - 1))).cast("int"))
        children = written(children, f"children-{level}")
        # several segments of one bin are one sibling; the bins of a parent are at most BINS + 1
        sib = children.groupBy("host", "template", "bin").agg(F.sum("b").alias("blocked"), F.sum("l").alias("labelled"))
        bins = F.array_sort(F.collect_list(F.struct((F.col("blocked") / F.col("labelled")).alias("share"), "bin", "blocked", "labelled")))
        groups = sib.groupBy("host", "template").agg(bins.alias("bins"))
        groups = groups.select("host", "template", F.explode(_merged(F.col("bins"), z_limit(F.size("bins").cast("double")))).alias("g")).select("host", "template", "g.bin", "g.group")
        told = join_on(children, groups, ["host", "template", "bin"])
        # the prior of a merged branch weighs its segments by their URLs; templates of labels alone have none
        weight = F.col("n_sum") + F.lit(0.001)
        rates = told.groupBy("host", "template", "group").agg(F.sum("labelled_sum").alias("labelled"), F.sum("blocked_sum").alias("blocked"), (F.sum(F.col("prior") * weight) / F.sum(weight)).alias("prior"), (F.min("segment") != F.max("segment")).alias("merged"), F.min("segment").alias("one"))
        many = rates.groupBy("host", "template").agg(F.sum(F.col("merged").cast("int")).alias("many"))
        star = F.when(F.col("many") > 1, F.concat(F.lit("*"), F.col("group").cast("string"))).otherwise(F.lit("*"))
        rates = join_on(rates, many, ["host", "template"]).withColumn("branch", F.when(F.col("merged"), star).otherwise(F.col("one")))
        rates = rates.select("host", "template", "group", "branch", smoothed(F.col("blocked"), F.col("labelled"), F.col("prior")).alias("rate"))
        chosen = join_on(told.select("host", "template", "segment", "prefix", "group"), rates, ["host", "template", "group"]).drop("group")
        rows = join_on(here.drop("paths"), chosen, ["host", "template", "segment", "prefix"])
        rows = rows.withColumn("template", F.concat("template", F.lit("/"), "branch")).withColumn("purity", F.col("rate"))
        rows = written(rows.drop("segment", "prefix", "branch", "rate"), f"templates-{level}")
        paths = rows.groupBy("host", "template").agg(F.count("*").alias("paths"))
        rows = written(join_on(rows, paths, ["host", "template"]), f"paths-{level}")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, template, purity.

    A null URL, like one without ``://``, has an empty host and path, which
    form a host of their own.  Without any labels nothing is rejected.  Repeated
    rows are judged alike and weigh as often as they occur.  An empty table
    gives no rows; other columns are ignored.  ``labels`` (url, blocked 0/1)
    adds labelled URLs to those the rules decide.
    """

    def cut(df: DataFrame, keep: list) -> DataFrame:
        host, path = split_url(F.col(url_col))
        return df.select(*keep, host.alias("host"), path.alias("path")).withColumn("segments", general_segments(F.col("path")))

    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = cut(pages.select(F.col(id_col).alias("page_id"), F.col(url_col)), ["page_id"]).withColumn("rule", rule).withColumn("said", verdict)
    judged = written(judged, "urls")
    one = F.lit(1).cast("long")
    counted = judged.select("host", "segments", one.alias("n"), F.when(F.col("said").isNotNull(), 1).otherwise(0).cast("long").alias("labelled"), F.when(F.col("said") == "block", 1).otherwise(0).cast("long").alias("blocked"))
    if labels is not None:
        known = cut(labels.select(F.col("url").alias(url_col), F.col("blocked").cast("long").alias("blocked")), ["blocked"]).where("blocked IS NOT NULL")
        counted = counted.unionByName(known.select("host", "segments", F.lit(0).cast("long").alias("n"), one.alias("labelled"), "blocked"))
    urls = counted.groupBy("host", "segments").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "blocked")])
    tree = grow(urls).select("host", "segments", "template", "purity")
    out = join_on(judged, tree, ["host", "segments"], "left")
    method = F.when(F.col("purity") >= REJECT_AT, "block").otherwise("allow")
    return out.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", F.col("purity"))
