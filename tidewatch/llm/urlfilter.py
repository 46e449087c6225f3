"""URL filter by a tree of path templates, with built-in functions only.

Explicit rules decide the urls they fit, and label them for the rest. Per host the paths form a tree, made level by level: a segment that too small a share of
its siblings' rows carries becomes a wildcard, and so does a branch whose labels do not differ from its siblings' by a two-proportion test. A template is
rejected if the share of blocked among its labelled urls, smoothed towards its host's and that towards the share over all, is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: From this level on, rows of a branch of fewer than SUPPORT rows leave the loop: none of their segments could stay, so all are wildcards. The result is the same at any level.
EARLY = 4
#: A segment stays as it is with so many rows, and such a share of its siblings' rows.
SUPPORT, SHARE = 10, 0.02
#: Branches whose standardised difference is smaller are merged.
Z = 1.96
#: Weight of the parent's purity, in labelled urls; a template is rejected from this purity on.
WEIGHT, REJECT = 10.0, 0.6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. rules: (verdict, host and path prefix)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def templates(rows: DataFrame) -> DataFrame:
    """The rows with their template, one level after the other until no row has a further segment. rows: host, segments (array), label (1 blocked, 0 allowed, null unknown)."""
    now, done, level = stored(rows.withColumn("template", F.lit(""))), [], 0
    while True:
        done.append(now.where(F.size("segments") <= level))
        now = now.where(F.size("segments") > level)
        if now.isEmpty():
            break
        if level >= EARLY:
            live = now.groupBy("host", "template").agg(F.count(F.lit(1)).alias("_live")).where(F.col("_live") >= SUPPORT)
            now = stored(now.join(live, ["host", "template"], "left"))
            rest = F.expr(f"concat(template, repeat('/*', size(segments) - {level}))")
            done.append(now.where("_live is null").drop("_live").withColumn("template", rest))
            now = now.where("_live is not null").drop("_live")
            if now.isEmpty():
                break
        now = now.withColumn("_seg", F.element_at("segments", F.lit(level + 1)))
        counts = [F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")]
        branch = now.groupBy("host", "template", "_seg").agg(*counts)
        whole = branch.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
        b = branch.join(whole, ["host", "template"])
        # the branch against its siblings together
        others, others_blocked = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
        pooled = F.col("all_blocked") / F.greatest(F.lit(1), F.col("all_labelled"))
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.lit(1), F.col("labelled")) + 1 / F.greatest(F.lit(1), others)))
        differs = (F.col("labelled") > 0) & (others > 0) & (F.abs(F.col("blocked") / F.greatest(F.lit(1), F.col("labelled")) - others_blocked / F.greatest(F.lit(1), others)) > Z * spread)
        alone = F.col("n") == F.col("all_n")
        keep = b.where((F.col("n") >= SUPPORT) & (F.col("n") >= SHARE * F.col("all_n")) & (alone | differs)).select("host", "template", "_seg", F.lit(True).alias("_kept"))
        joined = now.join(keep, ["host", "template", "_seg"], "left")
        part = F.concat(F.lit("/"), F.when(F.col("_kept"), F.col("_seg")).otherwise(F.lit("*")))
        now = stored(joined.withColumn("template", F.concat("template", part)).drop("_seg", "_kept"))
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def judged(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity.

    pages: page_id, url. A null url and one without :// have an empty host and path, no rule and the empty template. Repeated rows stay and are judged alike. Without any
    labelled url the purity is 0 and everything is allowed. Paths may have any number of segments; empty ones are left out. Other columns are not looked at.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    base = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rule = base.withColumn("_r", ruled(F.col("host"), F.col("path"), rules))
    rows = rule.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled"))
    rows = rows.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("label", (F.col("ruled") == "block").cast("int"))
    placed = stored(templates(rows))
    sums = [F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")]
    every = placed.agg(*sums).first()
    overall = every[1] / every[0] if every[0] else 0.0
    by_host = placed.groupBy("host").agg(*sums).select("host", ((F.col("blocked") + WEIGHT * overall) / (F.col("labelled") + WEIGHT)).alias("_host"))
    by_template = placed.groupBy("host", "template").agg(*sums).join(by_host, "host")
    purity = by_template.select("host", "template", ((F.col("blocked") + WEIGHT * F.col("_host")) / (F.col("labelled") + WEIGHT)).alias("purity"))
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return placed.join(purity, ["host", "template"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
