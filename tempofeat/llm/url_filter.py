"""URL block and allow lists by hashed host-suffix and path-prefix expressions.

A URL's expressions are every suffix of its host's labels with every prefix of
its path; only label counts and path lengths that some rule has are expanded,
which loses nothing. They meet the rules in an equi-join on short prefixes of
their digests; full digests confirm, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the registered query: host, path, action.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, action string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or a URL without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url_col: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    prefix: int = 8,
    broadcast_rules: int = 100_000,
    salts: int = 16,
) -> DataFrame:
    """The `keep` columns of pages with host, path, rule and verdict, a row for each row.

    A kept column with one of these four names is replaced; others are ignored.
    An empty table gives no rows. A very long url is judged whole.
    rule is host and path of the longest fitting rule (ties: the longer host,
    then block before allow), verdict its action; no rule: null and `default`.
    Repeated pages stay, null ids too. Rules with a null or empty host or a null
    action fit nothing; a null path counts as empty; hosts of rules are
    lower-cased. Up to `broadcast_rules` rules, counted, are broadcast; more are
    joined by a shuffle, each replicated over `salts` salts, so that an
    expression in every URL (a top-level domain) is no hot key.
    """
    listed = (
        rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("action").alias("r_action"))
        .where("r_host <> '' and r_action is not null")
        .distinct()
    )
    digest = lambda c: F.sha2(c, 256)
    listed = listed.withColumn("r_digest", digest(F.concat("r_host", "r_path"))).withColumn("short", F.substring("r_digest", 1, prefix))
    stats = listed.agg(F.count("*"), F.collect_set(F.size(F.split("r_host", r"\.", -1))), F.collect_set(F.length("r_path"))).head()
    n, labels, lengths = stats[0], sorted(stats[1]) or [0], sorted(stats[2]) or [0]

    host, path = host_and_path(F.col(url_col))
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep) if c.lower() not in ("host", "path", "rule", "verdict")]
    kept = [c for c in keep if c.lower() not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(F.lit(0).alias("none"), *own).alias("own"), host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.filter(F.lit(labels), lambda k: (k <= F.size(parts)) & (F.col("host") != "")), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    prefixes = F.transform(F.filter(F.lit(lengths), lambda k: k <= F.length("path")), lambda k: F.col("path").substr(F.lit(1), k))
    each = rows.withColumn("_suffix", F.explode_outer(suffixes)).withColumn("_prefix", F.explode_outer(prefixes))
    each = each.withColumn("digest", digest(F.concat("_suffix", "_prefix"))).withColumn("short", F.substring("digest", 1, prefix))

    on = ["short"]
    if n <= broadcast_rules:
        listed = F.broadcast(listed)
    else:
        listed = listed.withColumn("salt", F.explode(F.lit(list(range(salts)))))
        each, on = each.withColumn("salt", F.pmod(F.col("_row"), F.lit(salts)).cast("int")), ["short", "salt"]
    joined = each.join(listed, on, "left")
    fits = (F.col("digest") == F.col("r_digest")) & (F.col("_suffix") == F.col("r_host")) & (F.col("_prefix") == F.col("r_path"))
    best = F.max(F.when(fits, F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_action") == "block").alias("b"), "r_host", "r_path", "r_action")))
    out = joined.groupBy("_row").agg(best.alias("best"), *(F.first(c).alias(c) for c in ("own", "host", "path")))
    return out.select(*(F.col(f"own.k{i}").alias(c) for i, c in enumerate(keep) if c in kept), "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.r_action", F.lit(default)).alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))
