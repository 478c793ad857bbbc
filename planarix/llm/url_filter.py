"""URL filters: host-suffix and path-prefix expressions matched by hash prefix.

Every host expands into its suffixes, which meet the rules' hosts in an equi-join on a short prefix of
their SHA-256, confirmed by the full digest. A URL whose host has such suffixes expands into the
expressions `suffix` + `prefix of its path`, for the path lengths that rules have for that suffix.
These meet the rules in the same way, and the longest rule wins. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no :// gives an empty host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return _lower(rest)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rules_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with digest and short prefix, one row a host (A-Z lower-cased) and path.

    Of equal rules, block wins over allow. A null path is empty. Rules without a host fit nothing and are left out.
    """
    one = rules.groupBy(_lower(F.coalesce("host", F.lit(""))).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")).agg(F.max("verdict").alias("rule_verdict"))
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    return one.where("rule_host <> ''").select("rule_host", "rule_path", F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict", digest.alias("rule_digest"), _prefix(digest).alias("short"))


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Append host, path, rule and verdict to every row; rule is null and the verdict `default` where none fits.

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest
    rule (characters of host and path) wins, then the first by code point. Null urls and such without ://
    have an empty host and path. Equal host and path are judged once: expansion and join see
    distinct ones, and the closing join has one row for each, so a hot host or URL splits. Nothing is
    gathered on the driver, and neither rules nor URLs are bounded in number; a URL expands into as
    many expressions as its suffixes' rules have path lengths. Empty tables of pages or rules give what
    they should. Columns of the four names are replaced.
    """
    base = pages.drop("host", "path", "rule", "verdict")
    table = rules_table(rules)
    seen = base.select("*", host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    distinct = seen.where("host <> ''").select("host", "path").distinct()
    # hosts against the rules' hosts; a host's path lengths are few
    lengths = table.groupBy("rule_host").agg(F.collect_set(F.char_length("rule_path")).alias("lengths"))
    lengths = lengths.withColumn("host_digest", F.sha2("rule_host", 256)).select(_prefix(F.col("host_digest")).alias("short"), "host_digest", "lengths")
    suffixes = distinct.select("host").distinct().select("host", F.explode(F.sequence(F.lit(1), F.size(F.split("host", "\\.")))).alias("labels"))
    suffixes = suffixes.select("host", F.expr("substring_index(host, '.', -labels)").alias("suffix"))
    suffixes = suffixes.select("host", "suffix", F.sha2("suffix", 256).alias("digest")).withColumn("short", _prefix(F.col("digest")))
    fits = suffixes.join(lengths, "short").where("digest = host_digest").select("host", "suffix", "lengths")
    # their URLs against the whole rules
    expanded = distinct.join(fits, "host").select("host", "path", "suffix", F.explode("lengths").alias("chars")).where(F.char_length("path") >= F.col("chars"))
    keyed = expanded.select("host", "path", F.sha2(F.concat("suffix", F.lit("\n"), F.expr("substring(path, 1, chars)")), 256).alias("digest")).withColumn("short", _prefix(F.col("digest")))
    hits = keyed.join(table.select("short", "rule", "rule_verdict", "rule_digest"), "short").where("digest = rule_digest")
    best = hits.groupBy(F.col("host").alias("__host"), F.col("path").alias("__path")).agg(F.min(F.struct((-F.char_length("rule")).alias("order"), "rule", "rule_verdict")).alias("__b"))
    return seen.join(best, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left").select(
        *base.columns, "host", "path", F.col("__b.rule").alias("rule"), F.coalesce("__b.rule_verdict", F.lit(default)).alias("verdict")
    )
