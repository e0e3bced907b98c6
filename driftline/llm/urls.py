"""URL filter: explicit rules first, else the empirical-Bayes reputation of the host.

A page outcome is bad when its document is labelled of low quality or toxic.  Pages
carry their document's number as the last number of the path.  Rates shrink from
host to registered domain to public suffix to all pages: at each level the prior is
Beta(strength * m, strength * (1 - m)), where m is the parent's posterior mean and
strength comes from the level's intraclass correlation by the ANOVA estimate of the
beta-binomial.  A host is blocked when the lower bound of its posterior bad rate,
mean - Z * standard deviation, is above ``BLOCK_ABOVE``.  The posterior of a host
without labelled pages is its prior, so it needs a domain that is bad beyond doubt.
A port takes no part in domain and suffix.

A null url, or one without ``://``, has an empty host and path, fits no rule, and is
judged as the empty host.  Repeated rows count as pages of their own.  Labels of one
document that disagree count as bad.  Without any labelled page nothing is blocked.
Columns besides page_id, url and the label columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import small_or_shuffled, table, written

# The rules (host, path, verdict) of the production filter.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Common public suffixes of two labels.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za")

Z = 1.645
BLOCK_ABOVE = 0.5
#: The highest correlation leaves the prior the weight of one page: beyond it the posterior is U-shaped, its lower
#: bound is not mean - Z * deviation, and a single page would decide on a host.
LOWEST_RHO, HIGHEST_RHO = 0.001, 0.5
#: Hosts (about 60 bytes each) up to this number are broadcast to the pages; beyond it the join shuffles.
BROADCAST_HOSTS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def without_port(host: Column) -> Column:
    return F.regexp_replace(host, r":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    host = without_port(host)
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    host = without_port(host)
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct (length, rule, verdict), or null."""
    found = []
    for rule_host, rule_path, verdict in rules:
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found.append(F.when(fits, F.struct(F.lit(len(rule_host + rule_path)).alias("length"), F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*found))


def strength(groups: DataFrame) -> tuple[float, float]:
    """Overall rate, and the beta-binomial strength of groups (n, bad), by the ANOVA estimate."""
    n, bad = F.col("n"), F.col("bad")
    row = groups.where(n > 0).agg(F.count("*").alias("k"), F.sum(n).alias("total"), F.sum(bad).alias("hits"), F.sum(n * n).alias("squares"), F.sum(bad * bad / n).alias("between"), F.sum(bad * (n - bad) / n).alias("within")).first()
    if not row["k"]:
        return 0.0, 1 / LOWEST_RHO - 1
    k, total, rate = row["k"], row["total"], row["hits"] / row["total"]
    if k < 2 or total <= k:
        return rate, 1 / LOWEST_RHO - 1
    msb = (row["between"] - total * rate * rate) / (k - 1)
    msw = row["within"] / (total - k)
    n0 = (total - row["squares"] / total) / (k - 1)
    scale = msb + (n0 - 1) * msw
    rho = min(HIGHEST_RHO, max(LOWEST_RHO, (msb - msw) / scale if scale > 0 else LOWEST_RHO))
    return rate, 1 / rho - 1


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound) for outcomes of (host, bad), where bad is null for pages without a label."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = written(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rate, of_suffix = strength(suffixes)
    of_domain, of_host = strength(domains)[1], strength(hosts)[1]
    suffixes = suffixes.select("suffix", ((of_suffix * rate + F.col("bad")) / (of_suffix + F.col("n"))).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", ((of_domain * F.col("suffix_mean") + F.col("bad")) / (of_domain + F.col("n"))).alias("domain_mean"))
    a = of_host * F.col("domain_mean") + F.col("bad")
    size = of_host + F.col("n")
    mean = a / size
    deviation = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - mean) / (size + 1)))
    bound = mean - Z * deviation
    return hosts.join(domains, "domain").select("host", "n", "bad", mean.alias("mean"), bound.alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", block_above: float = BLOCK_ABOVE) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bound) of each page."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    number = F.expr(r"try_cast(regexp_extract(path, '/([0-9]+)([.]html|/)?$', 1) AS BIGINT)")
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")
    outcomes = parts.select("host", number.alias("doc_id")).join(labels.groupBy("doc_id").agg(bad), "doc_id", "left")
    known = written(reputations(outcomes.select("host", "bad")).select(F.col("host"), F.col("mean").alias("bad_rate"), "bound"), "reputations")
    judged = parts.join(small_or_shuffled(known, known.count(), BROADCAST_HOSTS), "host", "left").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    otherwise = F.when(F.col("bound") > block_above, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", otherwise).alias("verdict"), F.round("bad_rate", 9).alias("bad_rate"), F.round("bound", 9).alias("bound"))


def query(spark, sf_dir):
    """op2: the verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def _rule_case(column: int) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p) if column == 0 else v}'" for h, p, v in ordered)
    return f"CASE {cases} END"


_BARE = "regexp_replace(host, ':[0-9]*$', '')"


def _two(host: str) -> str:
    return f"array_to_string(list_slice(string_split({host}, '.'), -2, -1), '.') IN ({', '.join(repr(x) for x in TWO_LABELS)})"


def _last(host: str, k: int) -> str:
    return f"array_to_string(list_slice(string_split({host}, '.'), -{k}, -1), '.')"


def _moments(name: str, source: str) -> str:
    return f"""
{name} AS (SELECT rate, 1 / CASE WHEN k IS NULL OR k < 2 OR total <= k OR msb + (n0 - 1) * msw <= 0 THEN {LOWEST_RHO} ELSE least({HIGHEST_RHO}, greatest({LOWEST_RHO}, (msb - msw) / (msb + (n0 - 1) * msw))) END - 1 AS strength FROM
 (SELECT k, total, rate, CASE WHEN k > 1 THEN (btw - total * rate * rate) / (k - 1) END AS msb, CASE WHEN total > k THEN within / (total - k) END AS msw, CASE WHEN k > 1 THEN (total - squares / total) / (k - 1) END AS n0 FROM
 (SELECT count(*) AS k, sum(n)::DOUBLE AS total, sum(bad)::DOUBLE / sum(n) AS rate, sum(n * n)::DOUBLE AS squares, sum(bad * bad::DOUBLE / n) AS btw, sum(bad * (n - bad)::DOUBLE / n) AS within FROM {source} WHERE n > 0)))"""


SQL = f"""
WITH parts AS (
 SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
 FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
outcomes AS (SELECT host, bad FROM (SELECT host, try_cast(nullif(regexp_extract(path, '/([0-9]+)([.]html|/)?$', 1), '') AS BIGINT) AS doc_id FROM parts)
 LEFT JOIN (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id) USING (doc_id)),
hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, CASE WHEN {_two(_BARE)} THEN {_last(_BARE, 3)} ELSE {_last(_BARE, 2)} END AS domain, CASE WHEN {_two(_BARE)} THEN {_last(_BARE, 2)} ELSE {_last(_BARE, 1)} END AS suffix FROM outcomes GROUP BY host),
domains AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL),
{_moments('s_suffix', 'suffixes')}, {_moments('s_domain', 'domains')}, {_moments('s_host', 'hosts')},
suffix_means AS (SELECT suffix, (strength * coalesce(rate, 0) + bad) / (strength + n) AS suffix_mean FROM suffixes, s_suffix),
domain_means AS (SELECT domain, (strength * suffix_mean + bad) / (strength + n) AS domain_mean FROM domains JOIN suffix_means USING (suffix), s_domain),
known AS (SELECT host, mean - {Z} * sqrt(greatest(0, mean * (1 - mean) / (size + 1))) AS bound FROM
 (SELECT host, n, domain_mean, strength + n AS size, (strength * domain_mean + bad) / (strength + n) AS mean FROM hosts JOIN domain_means USING (domain), s_host))
SELECT page_id, host, path, {_rule_case(0)} AS rule, coalesce({_rule_case(1)}, CASE WHEN bound > {BLOCK_ABOVE} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN known USING (host)
"""
