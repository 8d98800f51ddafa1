"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that any
match must hold. How often those tokens occur in the URLs decides by which one the
rule is indexed. A URL's tokens fetch its candidate rules in a hash join, and only
those run their expressions. Distinct URLs are judged once; the verdicts then join
back to the rows, those of hot URLs (more than one row in ``HOT``, so fewer than that) by
broadcast, so no URL's rows meet in one task.

The rules are a list given by the caller (at most ``MOST_RULES``, so the index can be
broadcast); rules without a literal token are refused. Edge cases: a null URL or one
without ``://`` has empty host and path, and no rule fits it; repeated rows get
the same verdict each; other columns stay, whatever their names, but for one named
``_url``, which the result's takes the place of; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massq.llm.common import cut

MOST_RULES = 100_000
HOT = 1000


@dataclass(frozen=True)
class Rule:
    """``name`` is what the result shows. Lower tiers win, then longer names."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...] = field(default=())
    tier: int = 0


def prefix_rule(spec: str, verdict: str) -> Rule:
    """``host/path``: the host with all subdomains, paths that start with the rule's."""
    host, slash, path = spec.partition("/")
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", (slash + path).lower())
    return Rule(spec, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}\Q{slash + path}\E", tuple(whole))


def host_word_rule(words: str) -> Rule:
    """Block hosts with a label that holds these hyphenated words."""
    return Rule(words, "block", rf"^(?:[^/]*[.-])?{re.escape(words)}(?:[.-]|/|$)", tuple(re.findall(r"[a-z0-9]+", words)), 1)


RULES = (
    prefix_rule("org/", "allow"),
    prefix_rule("example.org/es/", "block"),
    prefix_rule("example.org/en/1", "block"),
    prefix_rule("com/fr/", "allow"),
    prefix_rule("com/de/", "block"),
    *[host_word_rule(w) for w in ("adult", "porn", "xxx", "casino", "bets", "pills", "spam", "ads", "track", "malware", "phishing", "warez")],
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(target), "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(spark: SparkSession, rules: tuple[Rule, ...], urls: DataFrame) -> DataFrame:
    """rule columns and ``token``: of each rule's literal tokens the one in fewest of ``urls`` (column ``tokens``)."""
    if len(rules) > MOST_RULES or not all(r.tokens for r in rules):
        raise ValueError(f"at most {MOST_RULES} rules, each with a literal token")
    rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"), F.lit(r.tier).alias("tier"), F.array(*map(F.lit, r.tokens)).alias("literals")) for r in rules]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    literal = table.select("name", "tier", F.explode("literals").alias("token"))
    seen = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(literal.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = literal.join(seen, "token", "left").groupBy("name", "tier").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token"))
    return table.drop("literals").join(rarest, ["name", "tier"])


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with a struct ``_url``: host, path, rule (null: none), tier, verdict."""
    url = F.col("u")
    rows = pages.select(F.struct(*[c for c in pages.columns if c != "_url"]).alias("row"), F.col(url_col).alias("u"))
    seen = cut(rows.where(url.isNotNull()).groupBy("u").agg(F.count(F.lit(1)).alias("n")))
    urls = seen.select("u", F.concat(host_of(url), path_of(url)).alias("target")).withColumn("tokens", tokens_of(F.col("target")))
    index = rule_index(pages.sparkSession, rules, urls)
    candidates = urls.select("u", "target", F.explode("tokens").alias("token")).join(F.broadcast(index), "token")
    fits = candidates.where(F.expr("target rlike regex"))
    best = cut(fits.groupBy("u").agg(F.min(F.struct("tier", (-F.length("name")).alias("short"), "name", "verdict")).alias("best")))
    hot = F.broadcast(seen.where(F.col("n") * HOT > (seen.agg(F.sum("n")).first()[0] or 0)).select("u"))
    named, none = rows.where(url.isNotNull()), F.lit(None).cast(best.schema["best"].dataType)
    judged = named.join(hot, "u", "left_anti").join(best, "u", "left")
    judged = judged.unionByName(named.join(hot, "u", "left_semi").join(F.broadcast(best.join(hot, "u", "left_semi")), "u", "left"))
    judged = judged.unionByName(rows.where(url.isNull()).withColumn("best", none))
    return judged.select("row.*", F.struct(host_of(url).alias("host"), path_of(url).alias("path"), F.col("best.name").alias("rule"), F.col("best.tier").alias("tier"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).alias("_url"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    named = F.when(F.col("_url.tier") == 0, F.col("_url.rule")).alias("rule")
    return rows.select("page_id", "_url.host", "_url.path", named, "_url.verdict")


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, rhost, rpath, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m AS (SELECT page_id, max(struct_pack(n := len(rule), rule := rule, verdict := r.verdict)) AS b
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, host, path, b.rule AS rule,
       coalesce(b.verdict, CASE WHEN regexp_matches(host, '(^|[.-])(adult|porn|xxx|casino|bets|pills|spam|ads|track|malware|phishing|warez)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (page_id)
"""
