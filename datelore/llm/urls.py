"""URL filters: pattern rules indexed by their rarest literal token.

The tokens of a url fetch candidate rules by an equi-join, and only those run their regular expressions. All of
it is DataFrame work: no Python runs on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datelore.llm.common import read_table

#: The host rules of the contract, as (host and path, verdict).
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Pattern rules for what no host rule fits, as (regular expression over host and path, literal tokens, verdict).
PATTERN_RULES = (
    (r"(?:^|[.-])spam-", ("spam",), "block"),
    (r"(?:^|[.-])cheap-pills[.-]", ("cheap", "pills"), "block"),
    (r"(?:^|[.-])casino[.-]", ("casino",), "block"),
    (r"/wp-login\.php", ("wp", "login"), "block"),  # "php" is no token of these two: nothing closes it on the right
    (r"/xmlrpc\.php", ("xmlrpc",), "block"),
    (r"/download/crack/", ("download", "crack"), "block"),
)

_RULE = "rule_id int, kind string, rule string, pattern string, tokens array<string>, verdict string"


def split_url(url: str | Column) -> tuple[Column, Column]:
    """(host, path) of a url: the host, A-Z in small letters, lies after the first "://" up to "/", "?", "#" or the
    end; the path from there up to "?", "#" or the end. Both are empty where url is null or has no "://"."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_rule(rule: str, verdict: str) -> tuple[str, str, str, tuple[str, ...], str]:
    """A rule "host/path" as a pattern rule: it fits its host and all subdomains where the path starts with the rule's.

    Its literal tokens are those that delimiters close on both sides, so that a url which fits holds each of them.
    """
    tokens = tuple(t for t in re.findall(r"[a-z0-9]+(?=[^a-z0-9])", rule.lower()))
    return "host", rule, r"^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", rule), tokens, verdict


def rule_table(spark: SparkSession, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Rules as rows. A pattern rule has to name tokens that every url which it fits holds as whole tokens, or none."""
    rules = [host_rule(r, v) for r, v in host_rules] + [("pattern", p, p, tuple(t), v) for p, t, v in pattern_rules]
    return spark.createDataFrame([(k, *rule[:3], list(rule[3]), rule[4]) for k, rule in enumerate(rules)], _RULE)


def _tokens(text: Column) -> Column:
    """Distinct tokens of host and path, and the empty one, which rules without literal tokens are indexed by."""
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit(""))))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", few_rules: bool = False) -> DataFrame:
    """pages with host, path, rule and verdict.

    The longest host rule that fits decides, rule names it; where none fits rule is null, and a pattern rule that
    fits decides (block before allow), or else default. Equal urls are judged once. Null urls, and such without
    "://", have an empty host and path and get what fits the empty string. Columns of pages that bear a new name are
    replaced; an empty table gives no rows. few_rules says that the rules are a short list: they then go to the urls' tokens, and a
    token that most urls hold is met where it lies; without it the planner decides by size.
    """
    told = F.broadcast if few_rules else lambda df: df
    host, path = split_url(url_col)
    pages = pages.drop("host", "path", "rule", "verdict", "_key").withColumns({"host": host, "path": path}).withColumn("_key", F.concat("host", "path"))
    urls = pages.select("_key").distinct()
    tokens = urls.select("_key", F.explode(_tokens(F.col("_key"))).alias("token"))

    named = rules.select("rule_id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    counts = tokens.join(told(named.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = named.join(counts, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    index = rarest.select("rule_id", F.col("least.token").alias("token")).join(rules.drop("tokens"), "rule_id")

    fits = tokens.join(told(index), "token").where(F.expr("rlike(_key, pattern)"))
    best = fits.groupBy("_key").agg(
        F.max(F.when(F.col("kind") == "host", F.struct(F.length("rule").alias("n"), "rule", F.col("verdict")))).alias("by_host"),
        F.max(F.when(F.col("kind") == "pattern", F.col("verdict"))).alias("by_pattern"),
    )
    return pages.join(best, "_key", "left").select(
        *[c for c in pages.columns if c != "_key"],
        F.col("by_host.rule").alias("rule"),
        F.coalesce("by_host.verdict", "by_pattern", F.lit(default)).alias("verdict"),
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged."""
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark), few_rules=True).select("page_id", "host", "path", "rule", "verdict")


_OP2_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, max(struct_pack(n := length(h || q), rule := h || q, v := v)) AS best
      FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT s.page_id, host, path, best.rule AS rule,
       coalesce(best.v, CASE WHEN regexp_matches(host || path, '(?:^|[.-])spam-') OR regexp_matches(host || path, '(?:^|[.-])cheap-pills[.-]') OR regexp_matches(host || path, '(?:^|[.-])casino[.-]')
                                  OR regexp_matches(host || path, '/(?:wp-login|xmlrpc)\.php') OR regexp_matches(host || path, '/download/crack/') THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN m USING (page_id)
"""

QUERIES = {"op2_url_filters": op2_url_filters}
ORACLE_SQL = {"op2_url_filters": _OP2_SQL}
