"""URL filtering by pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path together with literal tokens (runs of a-z, 0-9)
that every url it fits contains as whole tokens. Each rule is filed under that one of its tokens
which is rarest among the urls at hand. The tokens of a url fetch the rules filed under them, and
only those run their regular expression. Host rules go before pattern rules, longer ones before
shorter ones. DataFrame functions only; a url's candidates are combined before the one shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number (with their tokens a few hundred bytes each) are broadcast; more are shuffled.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    pattern: str  # over host + path
    tokens: tuple[str, ...]
    host_rule: bool = False


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, all its subdomains and paths that start with path."""
    whole = re.findall("[a-z0-9]+", host)
    if path and path != "/":
        # the last piece of a path may go on in a url unless a sign ends it
        whole += [t for t in re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?![A-Za-z0-9])(?=.)", path)]
    quote = lambda s: re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", s)
    return Rule(host + path, verdict, f"^([^/?#]*[.])?{quote(host)}{quote(path)}", tuple(t.lower() for t in whole), True)


def pattern_rule(token: str, verdict: str = "block", pattern: str | None = None) -> Rule:
    """A rule for urls with the token, or with the pattern that implies it."""
    return Rule(f"*{token}*", verdict, pattern or f"(^|[^A-Za-z0-9]){token}([^A-Za-z0-9]|\\z)", tuple(re.findall("[a-z0-9]+", token)))


# fixed values: the host rules of the contract
HOST_RULES = [host_rule("com", "/", "allow"), host_rule("example.com", "/en/", "block"), host_rule("www.example.com", "/en/", "allow"), host_rule("net", "/es/", "block"), host_rule("net", "/fr/", "block")]
# fixed values: tokens of unwanted sites and files
PATTERN_RULES = [pattern_rule(t) for t in ("spam", "casino", "cheap-pills", "xxx", "porn", "warez", "phishing", "malware", "login", "wp-admin")] + [pattern_rule(t, pattern=f"[.]{t}\\z") for t in ("exe", "apk", "zip", "gz", "pdf")]


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ://, and path up to ? or #; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row of pages: id_col, host, path, rule (the host rule that holds, or null), pattern (the pattern rule), verdict.

    Null urls and urls without :// have empty host and path; no rule fits them. Of rules of equal
    length the alphabetically last holds. Rows with equal ids are judged one by one. Without rules
    every verdict is the default. Other columns are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.filter(F.split(lower_ascii(target), "[^a-z0-9]+"), lambda t: t != ""))
    table = small_table(spark, [(r.name, r.verdict, r.pattern, r.host_rule, list(r.tokens) or [""]) for r in rules], "name string, verdict string, pattern string, host_rule boolean, tokens array<string>")
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda x: x)
    # file each rule under its rarest token
    filed = table.select("name", "verdict", "pattern", "host_rule", F.explode("tokens").alias("token"))
    seen = rows.select(F.explode(tokens).alias("token")).join(small(filed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("k"))
    index = filed.join(seen, "token", "left").groupBy("name", "verdict", "pattern", "host_rule").agg(F.min(F.struct(F.coalesce("k", F.lit(0)), "token")).alias("best"))
    index = index.select("name", "verdict", "pattern", "host_rule", F.col("best.token").alias("token"))
    # rules without any literal are filed under the empty token, which every url has
    fetched = rows.withColumn("token", F.explode(F.concat(tokens, F.array(F.lit(""))))).join(small(index), "token", "left")
    hit = F.when(F.expr("concat(host, path) rlike pattern"), F.struct(F.length("name").alias("size"), "name", "verdict"))
    out = fetched.groupBy("uid").agg(
        F.first("id").alias(id_col), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("host_rule"), hit)).alias("ruled"), F.max(F.when(~F.col("host_rule"), hit)).alias("other"),
    )
    return out.select(id_col, "host", "path", F.col("ruled.name").alias("rule"), F.col("other.name").alias("pattern"), F.coalesce("ruled.verdict", "other.verdict", F.lit(default)).alias("verdict"))


def oracle(rules: list[Rule], default: str = "allow") -> str:
    """DuckDB SQL of judge_urls over the table pages."""
    rows = ", ".join(f"('{r.name}', '{r.verdict}', '{r.pattern}', {r.host_rule})" for r in rules)
    return f"""
WITH rules(name, verdict, pattern, host_rule) AS (VALUES {rows}),
u AS (SELECT page_id, row_number() OVER () AS uid, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT uid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
hits AS (SELECT v.uid, r.*, row_number() OVER (PARTITION BY v.uid, r.host_rule ORDER BY length(r.name) DESC, r.name DESC) AS rn
         FROM v JOIN rules r ON regexp_matches(v.host || v.path, r.pattern))
SELECT v.page_id, v.host, v.path, a.name AS rule, b.name AS pattern, coalesce(a.verdict, b.verdict, '{default}') AS verdict
FROM v LEFT JOIN hits a ON a.uid = v.uid AND a.host_rule AND a.rn = 1 LEFT JOIN hits b ON b.uid = v.uid AND NOT b.host_rule AND b.rn = 1
"""
