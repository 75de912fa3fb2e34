"""URL filters: empirical-Bayes host reputation under explicit rules.

Labelled page outcomes (bad or not) are summed by host, registered domain and suffix. Each level's members have a beta-binomial prior: its mean is the rate
of the member's parent without the member's own outcomes, shrunk in its turn towards the next level (without that parent's), so no outcome is counted
twice; its strength is fitted to the spread between the members by the method of moments. Hosts without labelled pages have the
posterior of no outcomes. A page is blocked if the posterior quantile of its host's bad rate that is exceeded with probability 1 - tail lies above the
threshold. The longest fitting rule goes first. Sums and joins are DataFrame operations, the quantile is a function over distinct hosts in Arrow batches; one
row of totals and one of moments a level reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialise, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.5
TAIL = 0.05
#: Bounds of a prior's strength, and the strength where no member has two outcomes to tell it by.
LEAST_STRENGTH, MOST_STRENGTH, PLAIN_STRENGTH = 1.0, 10_000.0, 10.0
#: (rule, verdict); a rule is host and path prefix.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Labels that under a country's two letters make a public suffix of two labels; others are one label.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "ne", "net", "nom", "or", "org", "sch")
_ADDRESS = r"\A(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9a-f]*:[0-9a-f:.]*)\z"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """What a host's reputation goes by: without user, port, brackets and a last dot; null if nothing is left."""
    bare = F.regexp_replace(host, r"(?s)\A.*@", "")
    name = F.when(bare.startswith("["), F.regexp_extract(bare, r"\A\[([^\]]*)", 1)).otherwise(F.regexp_replace(bare, r":[0-9]*\z", ""))
    name = F.regexp_replace(name, r"\.+\z", "")
    return F.when(name != "", name)


def suffix_of(site: Column, second: tuple[str, ...] = SECOND) -> Column:
    """The last label, or the last two where they are a public suffix by the rule of SECOND; of an address all of it."""
    two = F.substring_index(site, ".", -2)
    last = F.substring_index(site, ".", -1)
    return F.when(site.rlike(_ADDRESS), site).when(last.rlike(r"\A[a-z]{2}\z") & F.substring_index(two, ".", 1).isin(*second) & (two != last), two).otherwise(last)


def domain_of(site: Column, second: tuple[str, ...] = SECOND) -> Column:
    """The suffix and the label before it, if there is one."""
    suffix = suffix_of(site, second)
    return F.when(suffix == site, site).when(suffix.contains("."), F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null: the rule's host or a subdomain of it, and its path as a prefix. Of rules of like length the smaller text wins."""
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    found = [none]
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*found)


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, elementwise; 0 < x < 1."""
    log_gamma = np.vectorize(__import__("math").lgamma, otypes=[float])
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-12):
            break
    return np.where(swap, 1 - front * h, front * h)


def beta_quantile(a: np.ndarray, b: np.ndarray, tail: float) -> np.ndarray:
    """Where the beta distribution's lower tail holds that probability, by halving."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(40):
        middle = (low + high) / 2
        under = beta_cdf(a, b, middle) < tail
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def _strength(members: DataFrame) -> float:
    """Prior strength of members around their means (n, k: outcomes and bad ones, m: the mean), by moments."""
    excess = F.pow(F.col("k") - F.col("n") * F.col("m"), 2) / (F.col("n") * F.col("m") * (1 - F.col("m"))) - 1
    total, room = members.filter("n >= 2").agg(F.sum(excess), F.sum(F.col("n") - 1)).first()
    if not room:
        return PLAIN_STRENGTH
    rho = float(total) / float(room)
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / rho - 1)) if rho > 0 else MOST_STRENGTH


def reputation(outcomes: DataFrame, site_col: str = "site", bad_col: str = "bad", *, tail: float = TAIL) -> DataFrame:
    """(site, n, bad_rate, lower): posterior mean and lower quantile of each site's bad rate.

    outcomes has a row per page, with a null outcome for those without a label, so every site has a row here, n being its labelled pages; null sites take no
    part. Repeated rows count as often as they occur. A level whose members have fewer than two outcomes each has PLAIN_STRENGTH. Without any labelled page,
    or any row, the result is empty.
    """
    rows = outcomes.select(F.col(site_col).alias("site"), F.col(bad_col).cast("long").alias("bad")).filter("site is not null")
    totals = rows.groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    sites = materialise(totals.withColumns({"domain": domain_of(F.col("site")), "suffix": suffix_of(F.col("site"))}))
    domains = materialise(sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    if not n:
        return sites.filter("false").select("site", "n", F.lit(0.0).alias("bad_rate"), F.lit(0.0).alias("lower"))

    def without(child: DataFrame, parent: DataFrame, on: list[str]) -> tuple[DataFrame, float]:
        """child with m: its parent's rate without the child's own outcomes; and the strength of the children around it."""
        s = _strength(parent)
        up = parent.select(*on, F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("m").alias("_m"))
        joined = child.join(up, on).withColumn("m", (F.col("_m") * s + F.col("_k") - F.col("k")) / (F.col("_n") - F.col("n") + s))
        return materialise(joined.drop("_n", "_k", "_m")), s

    by_suffix = materialise(suffixes.withColumn("m", (F.lit(int(k)) - F.col("k") + 0.5) / (F.lit(int(n)) - F.col("n") + 1)))
    by_domain, _ = without(domains, by_suffix, ["suffix"])
    by_site, _ = without(sites, by_domain, ["domain", "suffix"])
    s = _strength(by_site)
    ship(outcomes.sparkSession)

    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(a.to_numpy(float), b.to_numpy(float), tail), dtype="float64")

    posterior = by_site.withColumns({"a": F.col("m") * s + F.col("k"), "b": (1 - F.col("m")) * s + F.col("n") - F.col("k")})
    return posterior.select("site", "n", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), bound("a", "b").alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", *, rules=RULES, threshold: float = THRESHOLD, tail: float = TAIL) -> DataFrame:
    """(id_col, host, path, rule, verdict, bad_rate, lower), one row per page.

    outcomes: (id_col, bad 0/1), labelled pages; a page with several labels, or a label whose id several pages share, counts once for each pair. Null
    ids have no label. Null urls and those without :// have an empty host and path. A page without a site (an empty host, a port alone) has no
    reputation: the method allows it, with null rate and bound; so it does every page if none is labelled. Hosts that differ in user or port share
    one. Of fitting rules of like length the smaller text wins. Rows that repeat stay. Only id and url are read, so other columns may have any
    name. An empty table gives an empty result.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("_site", site_of(F.col("host")))
    labelled = rows.select("_id", F.col("_site").alias("site")).join(outcomes.select(F.col(id_col).alias("_id"), F.col("bad")), "_id").select("site", F.col("bad").cast("long").alias("bad"))
    every = labelled.unionByName(rows.select(F.col("_site").alias("site"), F.lit(None).cast("long").alias("bad")))
    known = materialise(reputation(every, tail=tail)).select(F.col("site").alias("_site"), "bad_rate", "lower")
    joined = rows.withColumn("_rule", rule_column(F.col("host"), F.col("path"), rules)).join(known, "_site", "left")
    method = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return joined.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"), "bad_rate", "lower")


def oracle(rules=RULES) -> str:
    """DuckDB SQL for the registered query: sums without the own member by window functions, the posterior's tail by summing its density over a grid of log odds."""
    cases = ""
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        cases += f" WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}') THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}"
    strength = lambda name, source: f"""{name} AS (SELECT CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN {PLAIN_STRENGTH} WHEN sum(power(k - n * m, 2) / (n * m * (1 - m)) - 1) <= 0 THEN {MOST_STRENGTH}
  ELSE least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, sum(n - 1) / sum(power(k - n * m, 2) / (n * m * (1 - m)) - 1) - 1)) END AS s FROM {source} WHERE n >= 2)"""  # noqa: E731
    second = ", ".join(f"'{s}'" for s in SECOND)
    return rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '\A(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '\A(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, nullif(rtrim(CASE WHEN starts_with(regexp_replace(host, '^.*@', ''), '[') THEN regexp_extract(host, '\[([^\]]*)', 1) ELSE regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') END, '.'), '') AS site FROM p),
o AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL),
h0 AS (SELECT site, string_split(site, '.') AS l, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM q LEFT JOIN o USING (page_id) WHERE site IS NOT NULL GROUP BY site),
h1 AS (SELECT *, CASE WHEN regexp_full_match(site, '[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}|[0-9a-f]*:[0-9a-f:.]*') THEN 0 WHEN len(l) > 1 AND regexp_full_match(l[-1], '[a-z]{{2}}') AND l[-2] IN ({second}) THEN 2 ELSE 1 END AS c FROM h0),
h2 AS (SELECT *, CASE WHEN c = 0 THEN site ELSE array_to_string(l[-c:], '.') END AS suffix, CASE WHEN c = 0 THEN site ELSE array_to_string(l[-least(len(l), c + 1):], '.') END AS domain FROM h1),
h3 AS (SELECT *, sum(n) OVER d AS dn, sum(k) OVER d AS dk, sum(n) OVER s AS sn, sum(k) OVER s AS sk, sum(n) OVER () AS tn, sum(k) OVER () AS tk FROM h2 WINDOW d AS (PARTITION BY suffix, domain), s AS (PARTITION BY suffix)),
ls AS (SELECT DISTINCT suffix, sn::BIGINT AS n, sk::BIGINT AS k, (tk - sk + 0.5::DOUBLE) / (tn - sn + 1) AS m FROM h3), {strength("ss", "ls")},
ld AS (SELECT DISTINCT h3.suffix, domain, dn::BIGINT AS n, dk::BIGINT AS k, (m * s + sk - dk) / (sn - dn + s) AS m FROM h3 JOIN ls USING (suffix), ss), {strength("sd", "ld")},
lh AS (SELECT site, h3.n AS n, h3.k AS k, (m * s + dk - h3.k) / (dn - h3.n + s) AS m FROM h3 JOIN ld USING (suffix, domain), sd), {strength("sh", "lh")},
post AS (SELECT site, m * s + k AS a, (1 - m) * s + n - k AS b FROM lh, sh),
grid AS (SELECT site, a, b, ln(a / b) + sqrt(1 / a + 1 / b) * sinh(t * 0.01) AS u, cosh(t * 0.01) AS w FROM post, range(-600, 601) r(t)),
mass AS (SELECT site, a, b, u, w * exp(-a * ln(1 + exp(-greatest(u, -700))) - b * ln(1 + exp(least(u, 700))) + a * ln(1 + b / a) + b * ln(1 + a / b)) AS f FROM grid),
tails AS (SELECT site, sum(f) FILTER (u < {f"ln({THRESHOLD}/(1-{THRESHOLD}))"}) / sum(f) AS under FROM mass GROUP BY site),
r AS (SELECT q.*, coalesce(under, 0) < {TAIL} AND (SELECT max(tn) FROM h3) > 0 AND q.site IS NOT NULL AS bad, CASE {cases} END AS r FROM q LEFT JOIN tails USING (site))
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
