"""URL block and allow lists: host-suffix and path-prefix expressions, joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, repeat_rows

#: Hexadecimal digits of the SHA-256 that the join compares, as a number; whole digests are compared after it.
PREFIX_DIGITS = 8


def _prefix(digest: Column) -> Column:
    return F.conv(F.left(digest, F.lit(PREFIX_DIGITS)), 16, 10).cast("long")



def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A small rule list, (verdict, host, path) each, as a table whose size Catalyst knows."""
    rows = [f"('{v}', '{h}', '{p}')" for v, h, p in ((x.replace("\\", "\\\\").replace("'", "\\'") for x in r) for r in rules)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS rules(verdict, host, path)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(
    pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", url_column: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    rules has verdict, host and path. A rule fits its host and all subdomains if the url's path starts
    with the rule's path; the longest rule (host and path together, then the longer host) wins, and of
    equal rules block wins. Without a rule, rule is null and the verdict is `otherwise`.

    A url is expanded into the host suffixes and path prefixes whose shape (labels of the host, length
    of the path) occurs among the rules. The shapes are the only thing that the driver sees: at most
    (labels of a host) x (lengths of a path) many, whatever the number of rules and pages. Catalyst
    broadcasts the rules while they are small and else shuffles both sides on the hash prefix.

    A null url, or one without ://, has an empty host and path and fits no rule. Repeated rows are
    judged once and returned as often as they occur. Other columns of pages are ignored.
    """
    clean = rules.select(
        F.coalesce(rules["verdict"], F.lit("block")).alias("verdict"),
        ascii_lower(F.coalesce(rules["host"], F.lit(""))).alias("host"),
        F.coalesce(rules["path"], F.lit("")).alias("path"),
    ).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    keyed = clean.select(
        F.sha2(F.concat("host", "path"), 256).alias("rule_digest"),
        F.struct(
            F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), F.col("verdict"), F.concat("host", "path").alias("rule")
        ).alias("found"),
    ).withColumn("rule_prefix", _prefix(F.col("rule_digest")))
    shapes = clean.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct().orderBy("labels", "length").collect()

    host, path = host_and_path(pages[url_column])
    urls = pages.select(pages[id_column].alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.size(F.split("host", r"\."))
    expressions = [
        F.when((labels >= s.labels) & (F.length("path") >= s.length), F.concat(F.substring_index("host", ".", -s.labels), F.left("path", F.lit(s.length))))
        for s in shapes
    ]
    # The first entry stands for the url itself: it carries no expression and counts the rows.
    variants = F.array_append(F.array_compact(F.array(*expressions)), F.lit(None).cast("string")) if shapes else F.array(F.lit(None).cast("string"))
    expanded = urls.select("*", F.explode(variants).alias("expression")).withColumn("digest", F.sha2("expression", 256))
    met = expanded.withColumn("prefix", _prefix(F.col("digest"))).join(keyed, F.col("prefix") == F.col("rule_prefix"), "left")
    found = met.withColumn("found", F.when(F.col("digest") == F.col("rule_digest"), F.col("found")))  # a short prefix can meet by chance
    best = found.groupBy("page_id", "host", "path").agg(F.max("found").alias("found"), F.count_if(F.col("expression").isNull()).alias("rows"))
    return repeat_rows(best, "rows").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(otherwise)).alias("verdict")
    )
