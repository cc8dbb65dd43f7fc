"""URL filter by empirical-Bayes host reputation; DataFrame functions only.

Rules (host, path) decide where they fit, the longest first.  For all other
urls the host's reputation decides.  Labelled outcomes (url, bad) are counted
by host, summed to registered domains and suffixes, and bad shares are shrunk
downwards: the suffix towards the share of all, the domain towards its suffix,
the host towards its domain.  On each level the prior is a beta distribution
around the parent's posterior mean whose weight comes from the spread of the
children (method of moments of the beta-binomial).  A host is blocked if even
the lower bound of its posterior bad share, mean - z * deviation, is above
``threshold``; hosts without outcomes have their parent's estimate as prior.

Verdicts belong to hosts, so pages meet only the few blocked ones in a join;
a host with very many pages is counted with partial sums and never gathered.

A null url, or one without ``://``, has an empty host and path, fits no rule
and is allowed.  Rows are judged one by one, repeated and null ids included.
Without outcomes no host is blocked.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import few, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Suffixes of two labels under which names are registered.
TWO_LABELS = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", "")


def suffix_of(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> Column:
    two = F.substring_index(name_of(host), ".", -2)
    return F.when(two.isin(*two_labels), two).otherwise(F.substring_index(two, ".", -1))


def domain_of(host: Column, two_labels: Sequence[str] = TWO_LABELS) -> Column:
    two = F.substring_index(name_of(host), ".", -2)
    return F.when(two.isin(*two_labels), F.substring_index(name_of(host), ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; rules: (verdict, host and path)."""
    rule = verdict = None
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def prior_weight(children: DataFrame, most: float = 1e4) -> float:
    """Weight of the prior, in outcomes, from children (n, bad, parent's mean p)."""
    q = F.col("p") * (1 - F.col("p"))
    r = children.agg(
        F.sum((F.col("bad") - F.col("n") * F.col("p")) * (F.col("bad") - F.col("n") * F.col("p"))).alias("spread"), F.sum(F.col("n") * q).alias("binomial"), F.sum(F.col("n") * (F.col("n") - 1) * q).alias("pairs")
    ).first()
    if not r.pairs:
        return 1.0
    rho = min(max((r.spread - r.binomial) / r.pairs, 1.0 / (1.0 + most)), 0.5)
    return 1.0 / rho - 1.0


def shrunk(counts: DataFrame, weight: float) -> DataFrame:
    return counts.withColumn("mean", (F.col("bad") + weight * F.col("p")) / (F.col("n") + weight))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, url_col: str = "url", bad_col: str = "bad", two_labels: Sequence[str] = TWO_LABELS) -> DataFrame:
    """host, n (outcomes), mean and deviation of the posterior bad share, for
    every row of hosts (host, distinct)."""
    labelled = outcomes.filter(F.col(bad_col).isNotNull()).select(host_of(F.col(url_col)).alias("host"), F.col(bad_col).cast("long").alias("bad")).filter("host <> ''")
    by_host = stash(labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).select("*", domain_of(F.col("host"), two_labels).alias("domain"), suffix_of(F.col("host"), two_labels).alias("suffix")), "outcomes")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_host.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = by_host.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    root = (whole.bad + 0.5) / (whole.n + 1.0)

    suffixes = by_suffix.withColumn("p", F.lit(root))
    suffixes = shrunk(suffixes, prior_weight(suffixes)).select("suffix", F.col("mean").alias("suffix_mean"))
    domains = by_domain.join(suffixes, "suffix").withColumnRenamed("suffix_mean", "p")
    domains = shrunk(domains, prior_weight(domains)).select("domain", F.col("mean").alias("domain_mean"))
    counted = by_host.join(domains, "domain").withColumnRenamed("domain_mean", "p")
    weight = prior_weight(counted)
    own = by_host.select("host", "n", "bad")
    return (
        hosts.select("host", domain_of(F.col("host"), two_labels).alias("domain"), suffix_of(F.col("host"), two_labels).alias("suffix"))
        .join(own, "host", "left")
        .join(domains, "domain", "left")
        .join(suffixes, "suffix", "left")
        .select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("domain_mean", "suffix_mean", F.lit(root)).alias("p"))
        .transform(lambda d: shrunk(d, weight))
        .select("host", "n", "mean", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + weight + 1)).alias("deviation"))
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, z: float = 1.0, id_col: str = "page_id", url_col: str = "url", two_labels: Sequence[str] = TWO_LABELS) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    two_labels: suffixes of two labels under which names are registered; the ones
    here are common, a full list is the caller's."""
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "said": said})
    hosts = parsed.filter("said is null and host <> ''").select("host").distinct()
    blocked = stash(host_reputation(outcomes, hosts, url_col, two_labels=two_labels).filter(F.col("mean") - z * F.col("deviation") > threshold).select("host", F.lit(True).alias("bad")), "blocked")
    return parsed.join(few(blocked), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


# The same in SQL, for the registered query's rules and parameters.
_RULE_CASE = """CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
 WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END"""
_WEIGHT = """SELECT CASE WHEN coalesce(sum(n * (n - 1) * p * (1 - p)), 0) = 0 THEN 1.0::DOUBLE ELSE
 1.0 / least(greatest((sum((bad - n * p) * (bad - n * p)) - sum(n * p * (1 - p))) / sum(n * (n - 1) * p * (1 - p)), 1.0::DOUBLE / 10001.0), 0.5::DOUBLE) - 1.0 END AS w FROM {}"""
_TWO = ", ".join(f"'{x}'" for x in TWO_LABELS)
ORACLE_SQL = rf"""
WITH parsed AS (
 SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {_RULE_CASE} AS rule FROM parsed),
labelled AS (
 SELECT host, (toxic = 1 OR quality = 0)::INT AS bad FROM parsed JOIN labels ON doc_id = page_id
 WHERE (toxic = 1 OR quality = 0) IS NOT NULL AND host <> ''),
names AS (SELECT DISTINCT host, string_split(regexp_replace(host, '^[^@]*@|:[0-9]*$', '', 'g'), '.') AS l FROM parsed WHERE host <> ''),
parts AS (SELECT host, l, array_to_string(l[-2:], '.') AS two FROM names),
placed AS (
 SELECT host, CASE WHEN two IN ({_TWO}) THEN array_to_string(l[-3:], '.') ELSE two END AS domain,
  CASE WHEN two IN ({_TWO}) THEN two ELSE l[-1] END AS suffix FROM parts),
by_host AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM labelled JOIN placed USING (host) GROUP BY host),
root AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS r FROM by_host),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT r FROM root) AS p FROM by_host GROUP BY suffix),
ws AS ({_WEIGHT.format("s0")}),
s AS (SELECT suffix, (bad + w * p) / (n + w) AS sm FROM s0, ws),
d0 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(sm) AS p FROM by_host JOIN s USING (suffix) GROUP BY domain),
wd AS ({_WEIGHT.format("d0")}),
d AS (SELECT domain, (bad + w * p) / (n + w) AS dm FROM d0, wd),
h0 AS (SELECT host, n, bad, dm AS p FROM by_host JOIN d USING (domain)),
wh AS ({_WEIGHT.format("h0")}),
h AS (
 SELECT host, coalesce(n, 0) AS n, (coalesce(bad, 0) + w * coalesce(dm, sm, r)) / (coalesce(n, 0) + w) AS mean, w
 FROM placed LEFT JOIN by_host USING (host) LEFT JOIN d ON placed.domain = d.domain LEFT JOIN s ON placed.suffix = s.suffix, root, wh),
blocked AS (SELECT host FROM h WHERE mean - sqrt(mean * (1 - mean) / (n + w + 1)) > 0.5)
SELECT page_id, host, path, rule,
 CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
