"""URL filters: explicit rules, then empirical-Bayes host reputation. DataFrame functions only.

Reputation: the labelled outcomes of a host's pages (poor or toxic: bad) shrink through beta-binomial priors, from the
whole table to the public suffix, from there to the registered domain, from there to the host. A level's prior has the
mean of its parent's posterior and a strength fitted by moments to how much the level's rates differ beyond what
their sizes explain. A url is blocked if the lower posterior bound of its host's bad rate (normal approximation of the
beta posterior) is above a limit, so a host with few labelled pages is judged by its domain and not blocked on a whim.

Pages are reduced to hosts before anything is joined, with a map-side sum; a host with a third of all pages is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldengine.staging import stage

#: (action, host, path prefix); the longest rule that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A url is blocked if its host's bad rate is above LIMIT with the certainty of BOUND standard deviations.
LIMIT, BOUND = 0.3, 1.2816
#: Range of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path prefix) and its action; null where none fits."""
    name = action = F.lit(None).cast("string")
    for what, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def _posterior(level: DataFrame, strength: Column, prior: str, mean: str) -> DataFrame:
    return level.withColumn(mean, (F.col("bad") + strength * F.col(prior)) / (F.col("n") + strength))


def _strength(level: DataFrame, prior: str) -> Column:
    """Prior strength by moments: between-group variance beyond what binomial sampling explains, over the whole level.

    One aggregate row; it comes to the driver as a number.
    """
    expected = F.col(prior) * (1 - F.col(prior))
    excess = F.sum(F.pow(F.col("bad") - F.col("n") * F.col(prior), 2) - F.col("n") * expected)
    row = level.where("n > 0").agg(F.try_divide(excess, F.sum(F.col("n") * (F.col("n") - 1) * expected)).alias("r")).first()
    share = row["r"]
    value = STRONGEST if share is None or share <= 0 else (1 - share) / share
    return F.lit(float(min(max(value, WEAKEST), STRONGEST)))


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per host: n and bad (labelled pages), domain, suffix, host_mean and lower (posterior bound of the bad rate).

    pages: page_id, host. outcomes: page_id, bad (0 or 1; nulls and null ids are ignored, the largest of repeats holds).
    The registered domain is the last two labels of a host, the suffix the last one; an empty host is its own domain
    and suffix. Without outcomes every mean is one half and no bound is above any limit of interest.
    """
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = stage(
        pages.join(known, "page_id", "left").groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
        .withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1)),
        "host-outcomes",
    )
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(*sums).first()
    overall = ((total["bad"] or 0.0) + 0.5) / ((total["n"] or 0) + 1.0)
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(overall))
    suffixes = _posterior(suffixes, _strength(suffixes, "prior"), "prior", "suffix_mean").select("suffix", "suffix_mean")
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    domains = _posterior(domains, _strength(domains, "suffix_mean"), "suffix_mean", "domain_mean").select("domain", "domain_mean")
    hosts = hosts.join(domains, "domain")
    strength = _strength(hosts, "domain_mean")
    hosts = _posterior(hosts, strength, "domain_mean", "host_mean")
    spread = F.sqrt(F.col("host_mean") * (1 - F.col("host_mean")) / (F.col("n") + strength + 1))
    return hosts.withColumn("lower", F.col("host_mean") - BOUND * spread)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """Per row of `pages` (page_id, url): host, path, rule (null if none fits), verdict (block or allow), lower.

    A null url, or one without ://, has an empty host and path; the reputation of the empty host judges it. Repeated
    rows give repeated results, a null page_id stays and has no outcome, other columns are ignored.
    """
    given = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    reputation = stage(host_reputation(given.select("page_id", "host"), outcomes).select("host", "lower"), "host-reputation")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("lower") > LIMIT, "block").otherwise("allow")
    return given.join(reputation, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, learned).alias("verdict"), "lower"
    )
