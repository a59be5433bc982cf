"""URL filter: path rules first, then an empirical-Bayes reputation of the host.  DataFrame operations only.

Labelled page outcomes (good or not) are counted by host.  Three beta-binomial levels shrink them: the public suffix
towards the global rate, the registered domain towards its suffix, the host towards its registered domain.  The strength
of each prior (its pseudo-count) is a method-of-moments estimate from the spread of the children's rates.  A host is
allowed when the lower bound of its posterior rate, mean minus ``z`` standard deviations, reaches ``threshold``.

Counting is a map-side combined aggregation, so a host with a third of all pages is no hot spot; the host verdicts are
joined back broadcast when they are counted as few, otherwise salted so that such a host is spread over tasks.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the verdict of the empty host;
hosts without labelled pages get their parents' shrunk rate; with no outcomes at all the prior rate is 1/2; repeated
label rows count as often as they stand there; repeated pages each return a row; other columns never take part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

Rule = tuple[str, str, str]  # verdict, host, path prefix


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The public suffix and one label more; a host without that is its own domain."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's."""
    chain = None
    for verdict, rule_host, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        hit = F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, hit) if chain is None else chain.when(fits, hit)
    return chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(level: DataFrame, name: str, most: float) -> DataFrame:
    """One row: the pseudo-count of a level's prior from the spread of its members' rates (x good of n)."""
    total = level.agg(
        F.sum("n").cast("double").alias("nn"), F.sum("x").cast("double").alias("xx"), F.count("*").cast("double").alias("k"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("n2"),
        F.sum(F.col("x") * F.col("x") / F.col("n")).alias("x2n"),
    )
    p = F.col("xx") / F.col("nn")
    spread = F.col("x2n") - F.col("nn") * p * p - (F.col("k") - 1) * p * (1 - p)
    weight = F.col("nn") - F.col("n2") / F.col("nn")
    strength = F.when((F.col("k") > 1) & (weight > 0) & (spread > 0), p * (1 - p) * weight / spread - 1)
    return total.select(F.greatest(F.lit(2.0), F.least(F.lit(most), F.coalesce(strength, F.lit(most)))).alias(name))


def host_reputation(
    pages: DataFrame, outcomes: DataFrame, *, z: float = 1.645, threshold: float = 0.5, most: float = 1000.0
) -> DataFrame:
    """host, domain, suffix, n, good, alpha, beta, mean, bound, verdict for every host of pages(page_id, url).

    outcomes(page_id, good): any number of rows for a page; null ids or outcomes are left out.
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"))
    judged = (
        outcomes.where(F.col("page_id").isNotNull() & F.col("good").isNotNull())
        .groupBy("page_id")
        .agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("x"))
    )
    hosts = (
        seen.join(judged, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x"))
        .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "x")
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    used = F.col("n") > 0
    # four numbers, as scalar subqueries
    rate = suffixes.agg(F.coalesce(F.try_divide(F.sum("x"), F.sum("n")), F.lit(0.5)).alias("rate")).scalar()
    k_suffix, k_domain, k_host = (_strength(level.where(used), "k", most).scalar() for level in (suffixes, domains, hosts))
    by_suffix = suffixes.select("suffix", ((F.col("x") + k_suffix * rate) / (F.col("n") + k_suffix)).alias("m_suffix"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", ((F.col("x") + k_domain * F.col("m_suffix")) / (F.col("n") + k_domain)).alias("m_domain"))
    alpha = F.col("x") + k_host * F.col("m_domain")
    beta = F.col("n") - F.col("x") + k_host * (1 - F.col("m_domain"))
    total = F.col("alpha") + F.col("beta")
    return (
        hosts.join(by_domain, ["domain", "suffix"])
        .select("host", "domain", "suffix", "n", F.col("x").alias("good"), alpha.alias("alpha"), beta.alias("beta"))
        .withColumn("mean", F.col("alpha") / total)
        .withColumn("bound", F.col("mean") - z * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1))))
        .withColumn("verdict", F.when(F.col("bound") >= threshold, "allow").otherwise("block"))
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], *, z: float = 1.645, threshold: float = 0.5, salts: int = 16
) -> DataFrame:
    """page_id, host, path, rule, verdict, bound for every row of pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    salted = seen.select("*", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int").alias("salt"))
    scored = host_reputation(pages, outcomes, z=z, threshold=threshold).select("host", "bound", F.col("verdict").alias("by_host"))
    spread = scored.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    return (
        salted.join(spread, ["host", "salt"], "left")
        .withColumn("ruled", ruled)
        .select(
            "page_id", "host", "path", F.col("ruled.rule").alias("rule"),
            F.coalesce(F.col("ruled.verdict"), F.col("by_host"), F.lit("block")).alias("verdict"), "bound",
        )
    )


# The rules of the query's contract.
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

SQL = r"""
WITH seen AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
judged AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS x FROM labels
           WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
parts AS (SELECT host, string_split(host, '.') AS p, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(x), 0)::DOUBLE AS x
          FROM seen LEFT JOIN judged USING (page_id) GROUP BY host),
named AS (SELECT *, CASE WHEN array_to_string(p[-2:], '.') IN ('ac.uk','co.jp','co.uk','com.au','com.br','com.cn','gov.uk','org.uk') THEN 2 ELSE 1 END AS s FROM parts),
hosts AS (SELECT host, n, x, array_to_string(p[-s:], '.') AS suffix, array_to_string(p[-(s + 1):], '.') AS domain FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY ALL),
levels AS (SELECT 's' AS l, n, x FROM suffixes UNION ALL SELECT 'd', n, x FROM domains UNION ALL SELECT 'h', n, x FROM hosts),
sums AS (SELECT l, sum(n) AS nn, sum(x) AS xx, count(*) AS k, sum(n * n) AS n2, sum(x * x / n) AS x2n FROM levels WHERE n > 0 GROUP BY l),
moments AS (SELECT *, xx / nn AS p, x2n - nn * (xx / nn) * (xx / nn) - (k - 1) * (xx / nn) * (1 - xx / nn) AS spread, nn - n2 / nn AS weight FROM sums),
strengths AS (SELECT l, greatest(2.0, least(1000.0, CASE WHEN k > 1 AND weight > 0 AND spread > 0 THEN p * (1 - p) * weight / spread - 1 ELSE 1000.0 END)) AS ks FROM moments),
prior AS (SELECT coalesce((SELECT sum(x) / sum(n) FROM suffixes), 0.5) AS rate,
                 coalesce((SELECT ks FROM strengths WHERE l = 's'), 1000.0) AS k_suffix, coalesce((SELECT ks FROM strengths WHERE l = 'd'), 1000.0) AS k_domain,
                 coalesce((SELECT ks FROM strengths WHERE l = 'h'), 1000.0) AS k_host),
by_suffix AS (SELECT suffix, (x + k_suffix * rate) / (n + k_suffix) AS m FROM suffixes, prior),
by_domain AS (SELECT domain, d.suffix, (x + k_domain * m) / (n + k_domain) AS m FROM domains d JOIN by_suffix s ON d.suffix = s.suffix, prior),
post AS (SELECT host, x + k_host * m AS a, n - x + k_host * (1 - m) AS b FROM hosts h JOIN by_domain d ON h.domain = d.domain AND h.suffix = d.suffix, prior),
scored AS (SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= 0.5 THEN 'allow' ELSE 'block' END AS by_host FROM post),
ruled AS (SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM seen)
SELECT page_id, r.host AS host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE by_host END AS verdict
FROM ruled r LEFT JOIN scored s ON r.host = s.host
"""
