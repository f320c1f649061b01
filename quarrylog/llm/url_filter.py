"""Operator 5: URL filters by rules and empirical-Bayes host reputation.

A rule decides the pages it fits, the longest first. Every page is also a labelled outcome of
its host: bad or not, by the rule's verdict if one fits it, else by whether its own URL or
html holds a listed term. A host's rate of bad pages is shrunk through beta-binomial priors:
all pages, suffix, registered domain, host, each level's prior being centred on the posterior
mean above it with a strength estimated by moments from the spread among its members. A page
without a rule is blocked if the host's posterior rate is above ``LIMIT`` even at its lower
bound, ``Z`` standard deviations below the mean.

The table of hosts is written once, and each level is made from the one below it; the driver
gets one row of sums a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LIMIT, Z = 0.5, 1.645
#: Words that label a page without a rule as bad.
TERMS = ("adult", "bets", "casino", "escort", "gambling", "poker", "porn", "viagra", "xxx")
#: Second labels under which the countries' two-letter suffixes register names.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null or no ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, like ``net/``, and its verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def bad_words(url: Column, html: Column, terms=TERMS) -> Column:
    """Whether a listed term stands as a word in either; nulls hold none."""
    return ascii_lower(F.concat_ws(" ", url, html)).rlike(rf"(^|[^a-z0-9])({'|'.join(terms)})([^a-z0-9]|$)")


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """The last label, or the last two where a country registers below a second label; and one label more."""
    labels = F.split(host, r"\.")
    two = host.rlike(rf"(^|\.)({'|'.join(SECOND)})\.[a-z][a-z]$")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - (n - 1)), n), ".")
    return F.when(two, last(F.lit(2))).otherwise(last(F.lit(1))), F.when(two, last(F.lit(3))).otherwise(last(F.lit(2)))


def _strength(level: DataFrame) -> float:
    """Of the beta prior that (n, bad, above) of a level's members come from, by moments."""
    r = level.agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("above"), F.lit(2.0))).alias("v"), F.sum("n").alias("w"), F.count(F.lit(1)).alias("j"), F.sum("bad").alias("b")).first()
    variance, mean = r.v / r.w, r.b / r.w
    noise = mean * (1 - mean)
    between = variance - noise * (r.j / r.w)
    return min(STRONGEST, max(WEAKEST, (noise - variance) / between)) if between > 0 and noise > 0 else STRONGEST


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad) of single pages to (host, n, bad, rate, low): posterior mean and lower bound of the host's rate of bad pages.

    Counts are aggregated before anything is shuffled; a hot host is one row. No pages give no hosts.
    """
    hosts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = materialize(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "bad"), "reputation-hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = materialize(hosts.groupBy("suffix", "domain").agg(*sums), "reputation-domains")
    suffixes = materialize(domains.groupBy("suffix").agg(*sums), "reputation-suffixes")
    total = suffixes.agg(*sums).first()
    if total.n is None:
        return hosts.select("host", "n", "bad", F.lit(None).cast("double").alias("rate"), F.lit(None).cast("double").alias("low"))

    def below(level: DataFrame, upper: DataFrame | None, keys: list[str]) -> tuple[DataFrame, float]:
        """The level with its posterior means."""
        if upper is None:
            level = level.withColumn("above", F.lit(total.bad / total.n))
        else:
            level = level.join(upper.select(*keys, F.col("mean").alias("above")), keys)
        m = _strength(level)
        return level.withColumn("mean", (F.col("bad") + F.lit(m) * F.col("above")) / (F.col("n") + F.lit(m))), m

    suffixes, _ = below(suffixes, None, [])
    domains, _ = below(domains, suffixes, ["suffix"])
    hosts, m = below(hosts, domains, ["suffix", "domain"])
    rate = F.col("mean")
    low = rate - Z * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(m) + 1))
    return hosts.select("host", "n", "bad", rate.alias("rate"), low.alias("low"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict.

    Null urls have an empty host, judged like any other; repeated rows are judged alike and
    count each; an empty table gives no rows. Without an html column urls alone are searched
    for terms. Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), bad_words(F.col("url"), html).alias("_words"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_v", verdict)
    bad = F.coalesce(F.col("_v") == "block", F.col("_words")).cast("long").alias("bad")
    known = host_reputation(rows.select("host", bad))
    known = known.select(F.col("host").alias("_h"), (F.col("low") > LIMIT).alias("_bad"))
    out = rows.join(known, F.col("host") == F.col("_h"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict"))


ORACLE = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r,
    regexp_matches(translate(concat_ws(' ', url, html), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({"|".join(TERMS)})([^a-z0-9]|$)') AS words FROM pages
), parts AS (
  SELECT page_id, words, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM parts
), counted AS (
  SELECT host, count(*) AS n, sum(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NULL AND words THEN 1 ELSE 0 END) AS bad, string_split(host, '.') AS l,
    CASE WHEN regexp_matches(host, '(^|\.)({"|".join(SECOND)})\.[a-z][a-z]$') THEN 2 ELSE 1 END AS k FROM ruled GROUP BY host
), hosts AS (
  SELECT host, n, bad, array_to_string(list_slice(l, greatest(1, len(l) - k + 1), len(l)), '.') AS suffix, array_to_string(list_slice(l, greatest(1, len(l) - k), len(l)), '.') AS domain FROM counted
), d0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL
), s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY ALL
), s1 AS (SELECT *, (SELECT sum(bad) / sum(n) FROM s0) AS above FROM s0
), ms AS (SELECT sum(n * (bad / n - above) ** 2) / sum(n) AS v, sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) AS e, count(*) / sum(n) AS k FROM s1
), s2 AS (SELECT s1.*, (bad + m * above) / (n + m) AS mean FROM s1, (SELECT CASE WHEN v - e * k > 0 AND e > 0 THEN least({STRONGEST}, greatest({WEAKEST}, (e - v) / (v - e * k))) ELSE {STRONGEST} END AS m FROM ms)
), d1 AS (SELECT d0.*, s2.mean AS above FROM d0 JOIN s2 USING (suffix)
), md AS (SELECT sum(n * (bad / n - above) ** 2) / sum(n) AS v, sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) AS e, count(*) / sum(n) AS k FROM d1
), d2 AS (SELECT d1.*, (bad + m * above) / (n + m) AS mean FROM d1, (SELECT CASE WHEN v - e * k > 0 AND e > 0 THEN least({STRONGEST}, greatest({WEAKEST}, (e - v) / (v - e * k))) ELSE {STRONGEST} END AS m FROM md)
), h1 AS (SELECT hosts.*, d2.mean AS above FROM hosts JOIN d2 USING (suffix, domain)
), mh AS (SELECT sum(n * (bad / n - above) ** 2) / sum(n) AS v, sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) AS e, count(*) / sum(n) AS k FROM h1
), h2 AS (SELECT h1.host, n, m, (bad + m * above) / (n + m) AS mean FROM h1, (SELECT CASE WHEN v - e * k > 0 AND e > 0 THEN least({STRONGEST}, greatest({WEAKEST}, (e - v) / (v - e * k))) ELSE {STRONGEST} END AS m FROM mh)
)
SELECT page_id, ruled.host AS host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN mean - {Z} * sqrt(mean * (1 - mean) / (n + m + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN h2 ON ruled.host = h2.host
"""
