"""URL filters: a tree of path templates per host, and listed rules before it.

The tree grows from the root, one path segment at a time, over counts of distinct paths. Segments that are numbers or codes,
and children of nodes with very many rare children, become wildcards. Among the other children of a node, those whose rate
of bad labels does not differ from their siblings' are merged into one branch. At the end every path has a template; a template
is blocked if its smoothed rate of bad labels is high.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvian.llm.columns import own_names
from pluvian.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments past this depth form one last segment.
DEPTH = 8
#: A segment that reads as a number, a date or a code, with or without a file ending, which stays.
VARIABLE = r"^(?:[0-9]+(?:[-_.][0-9]+)*|[0-9a-fA-F]{8,}|[0-9a-fA-F-]{32,})(\.[A-Za-z]{1,5})?$"


@dataclass(frozen=True)
class Rule:
    """Listed verdict for a host with its subdomains, and paths that start with `path`."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and for texts without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(str(r))).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _segments(path: Column) -> Column:
    """Path segments; what lies deeper than DEPTH stays together as the last one."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) <= DEPTH, parts).otherwise(
        F.concat(F.slice(parts, 1, DEPTH - 1), F.array(F.array_join(F.slice(parts, DEPTH, F.size(parts)), "/"))))


def templates(paths: DataFrame, many: int = 20, rare: float = 3.0, z: float = 1.96) -> DataFrame:
    """`paths` (host, path, n, labelled, bad) with `template`.

    A child is a wildcard if it reads as variable, or if its node has over `many` children with under `rare` rows each on
    average. Children merge if their bad labels lie within `z` standard deviations of the node's rate. Each level joins the
    paths with the counts of (host, node, segment), which are combined before the shuffle; a hot host only has more rows
    under keys that Spark may split.
    """
    rows = written(paths.withColumn("_segs", _segments(F.col("path"))).withColumn("template", F.lit("")))
    depth = rows.agg(F.max(F.size("_segs"))).first()[0] or 0
    for d in range(depth):
        seg = F.get(F.col("_segs"), F.lit(d))
        rows = rows.withColumn("_seg", F.regexp_replace(seg, VARIABLE, "*$1"))
        child = (rows.where(F.col("_seg").isNotNull()).groupBy("host", "template", "_seg")
                 .agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
        fixed = ~F.col("_seg").startswith("*")
        node = child.groupBy("host", "template").agg(
            F.count(F.when(fixed, 1)).alias("_kinds"), F.sum(F.when(fixed, F.col("n"))).alias("_n"),
            F.sum("labelled").alias("_labelled"), F.sum("bad").alias("_bad"))
        rate = F.try_divide("_bad", "_labelled")
        spread = F.sqrt(F.col("labelled") * rate * (1 - rate))
        alike = (F.abs(F.col("bad") - F.col("labelled") * rate) <= z * spread) | (F.col("_labelled") == 0)
        crowded = (F.col("_kinds") > many) & (F.col("_n") < rare * F.col("_kinds"))
        branch = (F.when(~fixed, F.col("_seg")).when(crowded, "*").when(F.coalesce(alike, F.lit(True)), "~")
                  .otherwise(F.col("_seg")))
        grown = child.join(node, ["host", "template"]).select("host", "template", "_seg", branch.alias("_branch"))
        rows = written(rows.join(grown, ["host", "template", "_seg"], "left")
                       .withColumn("template", F.concat("template", F.coalesce(F.concat(F.lit("/"), "_branch"), F.lit(""))))
                       .drop("_seg", "_branch"))
    return rows.drop("_segs")


def filter_urls(pages: DataFrame, marks: DataFrame, rules: tuple[Rule, ...], key: str = "page_id", url: str = "url",
                weight: float = 10.0, limit: float = 0.5, **shape) -> DataFrame:
    """(key, host, path, rule, verdict, template, bad_rate) of every page.

    `marks` (url, bad) holds labelled urls. A template's rate of bad labels is smoothed by `weight` labels at its host's
    rate, which in turn is smoothed by as many at the overall rate (0 without labels); above `limit` it is blocked. Null urls
    and those without `://` have an empty host and path and share a template; repeated rows are counted and judged alike;
    an empty table gives no rows. Columns beyond the named ones are ignored.
    """
    def located(df: DataFrame) -> DataFrame:
        host, path = split_url(F.col("url"))
        return df.withColumns({"host": host, "path": path}).drop("url")
    rows = located(own_names(pages, key, url).toDF("key", "url"))
    seen = located(own_names(marks, "url", "bad").where(F.col("bad").isNotNull()))
    zero = F.lit(0).cast("bigint")
    paths = (rows.select("host", "path", F.lit(1).cast("bigint").alias("n"), zero.alias("labelled"), zero.alias("bad"))
             .unionByName(seen.select("host", "path", zero.alias("n"), F.lit(1).cast("bigint").alias("labelled"),
                                      F.col("bad").cast("bigint").alias("bad")))
             .groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]))
    tree = written(templates(paths, **shape))

    def rate(name: str, prior: Column) -> Column:
        return (F.col(f"bad_{name}") + weight * prior) / (F.col(f"labelled_{name}") + weight)
    total = tree.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("r")).select("r").scalar()
    per_template = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled_t"), F.sum("bad").alias("bad_t"))
    per_host = per_template.groupBy("host").agg(F.sum("labelled_t").alias("labelled_h"), F.sum("bad_t").alias("bad_h"))
    judged = (per_template.join(per_host, "host").withColumn("_all", total)
              .select("host", "template", rate("t", rate("h", F.col("_all"))).alias("bad_rate")))
    per_path = tree.select("host", "path", "template").join(judged, ["host", "template"])
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_rate") > limit, "block").otherwise("allow")
    return rows.join(per_path, ["host", "path"]).select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template",
        "bad_rate")
