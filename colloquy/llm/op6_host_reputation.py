"""URL filters: fixed rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host. A beta-binomial prior is passed down: the suffix's bad share is shrunk towards
the share of all pages, the registered domain's towards its suffix's, the host's towards its domain's. The strength of each
prior comes from the spread between its children (method of moments). A page that no rule fits is blocked if the posterior
bound mean - Z * deviation of its host's bad share is over LIMIT; unlabelled hosts have the domain's posterior mean and a
wide bound.

Null urls and those without "://" have an empty host and path. A page counts as labelled once, by its id; with several labels
the bad one holds. Repeated pages give a row each. Hosts are joined by equality, so a hot host is split by adaptive execution;
the counts are pre-aggregated before the shuffle. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import checkpoint

#: Action, host, path prefix.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Names that form a suffix together with a country code.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
Z, LIMIT, STRENGTH = 1.64, 0.5, (1.0, 200.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    long = F.regexp_extract(host, rf"((?:^|\.)(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z])$", 1)
    return F.when(long != "", F.ltrim(long, F.lit("."))).otherwise(F.element_at(F.split(host, r"\."), -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the name before it."""
    before = F.rtrim(F.substr(host, F.lit(1), F.greatest(F.length(host) - F.length(suffix), F.lit(0))), F.lit("."))
    return F.when(before == "", suffix).otherwise(F.concat_ws(".", F.element_at(F.split(before, r"\."), -1), suffix))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; null if none does."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        text, action = F.when(fits, name + prefix).otherwise(text), F.when(fits, verdict).otherwise(action)
    return text, action


def strength(counts: DataFrame, parent: str) -> float:
    """The prior's weight in pages, from how far children's shares lie from their parent's beyond chance.

    For children with n pages and share p under a parent's mean m: E[n (p - m)^2] = m (1 - m) (1 + (n - 1) / (w + 1)).
    """
    counts = counts.where("n > 0")
    grouped = counts.groupBy(parent).agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
    row = counts.join(grouped, parent).withColumn("m", F.col("all_bad") / F.col("all_n")).agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).alias("spread"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("chance"),
        F.sum(F.col("m") * (1 - F.col("m")) * (F.col("n") - 1)).alias("room"),
    ).collect()[0]
    low, high = STRENGTH
    if row.spread is None or row.spread <= row.chance or not row.room:
        return high
    return float(min(max(row.room / (row.spread - row.chance) - 1, low), high))


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Posterior (bad, good) pseudo-counts a, b of every host of the pages."""
    outcome = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("long")).alias("bad"))
    own = pages.select(F.col("page_id").alias("doc_id"), host_of(F.col("url")).alias("host"))
    # labels first: few pages have one, and only these need to be told apart
    counted = own.join(outcome, "doc_id").distinct().groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = own.select("host").distinct().join(counted, "host", "left").fillna(0, ["n", "bad"])
    hosts = hosts.withColumn("name", F.regexp_replace("host", ":[0-9]*$", "")).withColumn("suffix", suffix_of(F.col("name"))).withColumn("domain", domain_of(F.col("name"), F.col("suffix")))
    hosts = checkpoint(hosts)  # one small row a host feeds all statistics; the pages are read once for them
    up = lambda key, *more: hosts.groupBy(key, *more).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains, suffixes = up("domain", "suffix"), up("suffix").withColumn("root", F.lit(""))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).collect()[0]
    share = ((total.bad or 0) + 1) / ((total.n or 0) + 2)
    w_suffix, w_domain, w_host = strength(suffixes, "root"), strength(domains, "suffix"), strength(hosts, "domain")
    mean = lambda prior, w: (F.col("bad") + w * prior) / (F.col("n") + w)
    suffixes = suffixes.select("suffix", mean(F.lit(share), w_suffix).alias("suffix_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", mean(F.col("suffix_mean"), w_domain).alias("domain_mean"))
    return hosts.join(domains, "domain").select("host", (F.col("bad") + w_host * F.col("domain_mean")).alias("a"), (F.col("n") - F.col("bad") + w_host * (1 - F.col("domain_mean"))).alias("b"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    hosts = reputation(pages, labels)
    mean = F.col("a") / (F.col("a") + F.col("b"))
    lower = mean - Z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    blocked = hosts.where(lower > LIMIT).select("host", F.lit("block").alias("reputation"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return found.join(blocked, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, "reputation", F.lit("allow")).alias("verdict"))
