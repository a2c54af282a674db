"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests.

A rule is (verdict, host, path). It fits its host and all subdomains if the url's path starts
with the rule's path; the longest fitting rule decides. Every url is expanded into rows: one for
each suffix of its host that some rule has, and of these one for each prefix of its path as long
as a rule's path under that host. A row is looked up by the first four bytes of its SHA-256 in
an equi-join with the rules, and a hit counts only if the whole digest agrees. Only hits meet by
url, where the longest is taken, and go back to their pages. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: The contract's rules: (verdict, host, path).
BASE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Up to so many rules (well under 64 MB) the rules are broadcast; beyond it the joins shuffle.
BROADCAST_RULES = 200_000
_PREFIX = 8  # hex digits, four bytes
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a table."""
    names = ("verdict", "host", "path")
    given = pa.table({n: pa.array([r[k] for r in rules], pa.string()) for k, n in enumerate(names)})
    return spark.createDataFrame(given, ", ".join(f"{n} string" for n in names))


def host_and_path(url):
    """(host, path) columns of a url column; both empty for null or a url without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _sha(expression):
    return F.sha2(expression.cast("binary"), 256)


def _ranked(rules: DataFrame) -> DataFrame:
    """digest, rule, verdict, n, h of each expression: of equal rules the blocking one holds."""
    held = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    wrong = F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False))
    held = held.withColumn("verdict", F.when(wrong, F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("verdict "), F.coalesce("verdict", F.lit("null"))))))
    one = held.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # allow < block
    rule = F.concat("host", "path")
    return one.select("host", "path", _sha(rule).alias("digest"), rule.alias("rule"), "verdict", F.length(rule).alias("n"), F.length("host").alias("h"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = BASE_RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    rules: (verdict, host, path) tuples, or a table with these columns; rules without a host are
    left out, and a verdict other than allow or block is an error. Longest: by the characters of
    host and path together, then of the host. A url that no rule fits gets a null rule and
    `default`; so does a null url or one without '://', with empty host and path. Null ids stay
    null, repeated rows give repeated results, an empty table gives none, and other columns of
    pages are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    given = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    ranked = _ranked(given)
    count, labels = given.agg(F.count("*"), F.max(F.size(F.split("host", r"\.")))).first()
    sent = F.broadcast if count <= BROADCAST_RULES else (lambda df: df)

    # suffixes of the host that have rules, with the lengths of these rules' paths
    hosts = ranked.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    hosts = hosts.select(F.substring(_sha(F.col("host")), 1, _PREFIX).alias("_hkey"), "lengths")
    parts = F.split("host", r"\.")
    # each host and path once, written: a page that stands in a third of the rows is one row here
    some = saved(urls.where("host <> ''").select("host", "path").distinct())
    own = some.select("host", "path", parts.alias("_parts"), F.explode(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels or 1)))).alias("_k"))
    own = own.select("host", "path", F.array_join(F.slice("_parts", -F.col("_k"), F.col("_k")), ".").alias("_suffix"))
    own = own.withColumn("_hkey", F.substring(_sha(F.col("_suffix")), 1, _PREFIX)).join(sent(hosts), "_hkey")

    # of these, prefixes of the path
    own = own.select("host", "path", "_suffix", F.explode("lengths").alias("_n")).where(F.col("_n") <= F.length("path"))
    own = own.select("host", "path", _sha(F.concat("_suffix", F.expr("substring(path, 1, _n)"))).alias("_digest"))
    keyed = ranked.select(F.substring("digest", 1, _PREFIX).alias("_key"), "digest", "rule", "verdict", "n", "h")
    hits = own.withColumn("_key", F.substring("_digest", 1, _PREFIX)).join(sent(keyed), "_key").where(F.col("_digest") == F.col("digest"))
    # written too, so that adaptive execution can split the join where one page is hot
    best = saved(hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("n", "h")).alias("_best")))
    none = urls.where("NOT coalesce(host <> '', false)").withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType))
    out = urls.where("host <> ''").join(best, ["host", "path"], "left").unionByName(none)
    return out.select("page_id", "host", "path", F.col("_best")["rule"].alias("rule"), F.coalesce(F.col("_best")["verdict"], F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
rules(verdict, rhost, rpath) AS (VALUES %s),
hit AS (
  SELECT p.page_id, p.host, p.path, r.verdict, r.rhost || r.rpath AS rule,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE k = 1
""" % ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in BASE_RULES)
