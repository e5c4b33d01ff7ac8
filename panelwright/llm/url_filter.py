"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted per host. Beta-binomial priors shrink them down the tree
all pages -> suffix -> registered domain -> host: the posterior mean of a parent is the prior mean of its children, and the strength of the
prior is one number per level, estimated by the analysis-of-variance estimator of the intra-class correlation. A host passes if the lower
bound of its posterior, mean - z * standard deviation, reaches a threshold. A host without labels has its parent's prior as posterior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.skew import heavy_keys, with_copies, with_piece
from panelwright.llm.common import ascii_lower, stored

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: (host, path, verdict); a rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
THRESHOLD = 0.5
Z = 1.645
#: Suffixes of two labels under which names are registered; a parameter, since the public list changes.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
#: Bounds of a prior's strength in labelled pages.
WEAKEST, STRONGEST = 0.1, 1e6


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    on_host = (host == rule_host) | host.endswith("." + rule_host)
    return on_host & path.startswith(rule_path)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in reversed(ordered):
        here = fits(host, path, rule_host, rule_path)
        text = F.when(here, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(here, F.lit(says)).otherwise(verdict)
    return text, verdict


def suffix_of(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(long_suffixes)), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(long_suffixes)), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(children: DataFrame, parent: list[str]) -> Column:
    """One row: the prior strength of a level from (n, k) of its children under their parents."""
    group = children.groupBy(*parent) if parent else children.groupBy(F.lit(0).alias("_all"))
    # Sums of integers and of squares per parent give all terms without a second pass.
    sums = group.agg(
        F.sum("n").alias("n"),
        F.sum("k").alias("k"),
        F.count(F.lit(1)).alias("c"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
        F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"),
    )
    total = sums.agg(
        F.sum("n").alias("n"),
        F.sum("c").alias("c"),
        F.count(F.lit(1)).alias("g"),
        F.sum(F.col("kk") - F.col("k") * F.col("k") / F.col("n")).alias("between"),
        F.sum(F.col("k") - F.col("kk")).alias("within"),
        F.sum(F.col("nn") / F.col("n")).alias("nn"),
    )
    msb = F.try_divide(F.col("between"), F.col("c") - F.col("g"))
    msw = F.try_divide(F.col("within"), F.col("n") - F.col("c"))
    size = F.try_divide(F.col("n") - F.col("nn"), F.col("c") - F.col("g"))
    rho = F.try_divide(msb - msw, msb + (size - 1) * msw)
    strength = F.when(rho <= 0, F.lit(STRONGEST)).otherwise(F.try_divide(1 - rho, rho))
    # Too few children to estimate from: children say no more than the weakest prior lets them.
    return total.select(F.least(F.greatest(F.coalesce(strength, F.lit(1.0)), F.lit(WEAKEST)), F.lit(STRONGEST)).alias("s"))


def reputations(hosts: DataFrame, z: float = Z) -> DataFrame:
    """hosts (host, n, k: labelled pages and good ones, n may be 0) -> host, posterior_mean, lower_bound."""
    tree = stored(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    by_domain = tree.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_domain = stored(by_domain, "domains")
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def strength(children, parent):
        return _strength(children.where("n > 0"), parent).first()["s"]

    s1, s2, s3 = strength(by_suffix, []), strength(by_domain, ["suffix"]), strength(tree, ["suffix", "domain"])
    every = by_suffix.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (every["k"] + 0.5) / (every["n"] + 1.0) if every["n"] else 0.5

    def shrunk(s, prior):
        return (s * prior + F.col("k")) / (s + F.col("n"))

    suffixes = by_suffix.select("suffix", shrunk(F.lit(s1), F.lit(mean)).alias("suffix_mean"))
    domains = by_domain.join(suffixes, "suffix").select("domain", "suffix", shrunk(F.lit(s2), F.col("suffix_mean")).alias("domain_mean"))
    posterior = tree.join(domains, ["suffix", "domain"]).withColumn("posterior_mean", shrunk(F.lit(s3), F.col("domain_mean")))
    m = F.col("posterior_mean")
    lower = m - z * F.sqrt(m * (1 - m) / (s3 + F.col("n") + 1))
    return posterior.select("host", "posterior_mean", F.round(lower, 9).alias("lower_bound"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules=RULES,
    threshold: float = THRESHOLD,
    z: float = Z,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Every page with its host, path, rule and verdict, and the host's posterior mean and lower bound.

    `outcomes` holds (id, good): 1 or 0 for some pages. Ids that occur more than once count once, as good only if all say so;
    null ids and null outcomes count as unlabelled. A null url, or one without "://", has an empty host and path; its host is
    judged like any other. Repeated pages are judged each. Other columns are not looked at. No pages, no rows; no labels, every
    host has the prior mean of one half and strength 1 per level.
    """
    page = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    good = outcomes.select(F.col(outcomes.columns[0]).alias("_id"), F.col(outcomes.columns[1]).alias("_good")).where("_good is not null")
    good = good.groupBy("_id").agg(F.min("_good").alias("_good"))
    judged = page.select(F.col(id_col).alias("_id"), "host").join(good, "_id", "left")
    hosts = judged.groupBy("host").agg(F.count("_good").alias("n"), F.coalesce(F.sum(F.col("_good").cast("long")), F.lit(0)).alias("k"))
    known = reputations(hosts, z)
    # A host may hold a third of all pages: its pages are spread over pieces, its one row is repeated for each.
    salted = page.withColumn("_row", F.coalesce(F.xxhash64(id_col, "path"), F.lit(0)))
    heavy = heavy_keys(page.select("host"), "host")
    left, right = with_piece(salted, heavy, "host", "_row"), with_copies(known, heavy, "host")
    joined = left.join(right, ["host", "_key_piece"])
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("lower_bound") >= threshold, "allow").otherwise("block")
    return joined.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(says, by_method).alias("verdict"), "posterior_mean", "lower_bound")


SQL = f"""
with page as (
  select page_id, coalesce(translate(regexp_extract(url, '{PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
         coalesce(regexp_extract(url, '{PARTS}', 2), '') path from pages),
good as (select doc_id, min(quality) good from labels where quality is not null group by doc_id),
host as (select host, count(good) n, coalesce(sum(good), 0)::bigint k from page left join good on page_id = doc_id group by host),
cut as (select *, split(host, '.') p from host),
tree as (select host, n, k, case when len(p) > 1 and p[-2] || '.' || p[-1] in {LONG_SUFFIXES} then p[-2] || '.' || p[-1] else p[-1] end suffix,
         array_to_string(p[case when len(p) > 1 and p[-2] || '.' || p[-1] in {LONG_SUFFIXES} then greatest(1, len(p) - 2) else greatest(1, len(p) - 1) end :], '.') domain from cut),
dom as (select suffix, domain, sum(n)::bigint n, sum(k)::bigint k from tree group by all),
suf as (select suffix, sum(n)::bigint n, sum(k)::bigint k from dom group by all),
child as (
  select 1 l, '' a, '' b, n, k from suf union all select 2, suffix, '', n, k from dom union all select 3, suffix, domain, n, k from tree),
sums as (
  select l, a, b, sum(n)::double n, sum(k)::double k, count(*)::double c, sum(k * k / n) kk, sum(n * n)::double nn
  from child where n > 0 group by all),
total as (select l, sum(n) n, sum(c) c, count(*) g, sum(kk - k * k / n) betw, sum(k - kk) inside, sum(nn / n) nn from sums group by l),
ms as (
  select l, betw / nullif(c - g, 0) msb, inside / nullif(n - c, 0) msw, (n - nn) / nullif(c - g, 0) size from total),
rho as (select l, (msb - msw) / nullif(msb + (size - 1) * msw, 0) rho from ms),
st as (select l, least(greatest(coalesce(case when rho <= 0 then {STRONGEST} else (1 - rho) / nullif(rho, 0) end, 1.0), {WEAKEST}), {STRONGEST}) s from rho),
par as (select (select s from st where l = 1) s1, (select s from st where l = 2) s2, (select s from st where l = 3) s3,
  (select (sum(k) + 0.5) / (sum(n) + 1.0) from suf) m),
sm as (select suffix, (s1 * m + k) / (s1 + n) mean from suf, par),
dm as (select domain, suffix, (s2 * mean + k) / (s2 + n) mean from dom join sm using (suffix), par),
post as (select host, (s3 * mean + k) / (s3 + n) mean, s3 + n + 1 size from tree join dm using (suffix, domain), par),
low as (select host, round(mean - {Z} * sqrt(mean * (1 - mean) / size), 9) low from post),
said as (
  select page_id, host, path, low, (host = 'net' or host like '%.net') and path like '/%' r1,
    (host = 'example.net' or host like '%.example.net') and path like '/en/%' r2,
    (host = 'example.com' or host like '%.example.com') and path like '/de/%' r3,
    (host = 'org' or host like '%.org') and path like '/fr/%' r4 from page join low using (host))
select page_id, host, path, case when r2 then 'example.net/en/' when r3 then 'example.com/de/' when r4 then 'org/fr/' when r1 then 'net/' end as rule,
  case when r2 then 'allow' when r3 then 'block' when r4 then 'allow' when r1 then 'block' when low >= {THRESHOLD} then 'allow' else 'block' end as verdict
from said
"""
