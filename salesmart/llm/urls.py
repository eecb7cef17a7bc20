"""URL filters: explicit rules first, then the reputation of the host.

Labelled pages give each host a number of pages and of good ones. Rates are shrunk from
above: suffixes towards the overall rate, registered domains towards their suffix, hosts
towards their domain. How strongly follows from the data: at each level the spread of the
units' rates around their parents', beyond what chance explains, gives the strength of a
beta prior (by moments of the beta-binomial). A host is blocked if even the upper bound of
its good rate, by its beta posterior, is below a share of the overall rate: a bar that follows
the data, since what is good is rare in one crawl and usual in another. Hosts without labelled
pages have the posterior of their domain's, suffix's or the overall prior.

A suffix is the last label of a host, or the last two where a country's label follows one of
the labels under which names are registered there (`co.uk`). This rule stands in for the
public list of suffixes, which changes and names thousands.

A rule names a host and the beginning of a path; it fits that host and its subdomains. The
longest fitting rule wins, then the longer host, then blocking.

Defined cases: a null url, or one without `://`, has an empty host and path and is judged
as the host without a name; repeated rows are judged alike; without labelled pages nothing
but rules decides; empty tables give no rows; further columns are not looked at.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .storage import written

# Labels under which names are registered below a country's.
REGISTRIES = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "or", "org", "sch")
TWO_LABEL_SUFFIX = f"^({'|'.join(REGISTRIES)})[.][a-z]{{2}}$"


@dataclass(frozen=True)
class Rule:
    """verdict: 'allow' or 'block'; path begins with a slash."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """A host passes unless its good rate is below `bar` times the overall rate by `deviations`."""

    bar: float = 1.0
    deviations: float = 1.64
    weakest: float = 1e-3
    strongest: float = 0.95


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def _bare(host: Column) -> Column:
    """Without user, port and the dot at the end."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:\d*)?$", "")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(_bare(host), ".", -2)
    return F.when(two.rlike(TWO_LABEL_SUFFIX), two).otherwise(F.substring_index(_bare(host), ".", -1))


def domain_of(host: Column) -> Column:
    bare, two = _bare(host), F.substring_index(_bare(host), ".", -2)
    address = bare.rlike(r"^(\d+\.){3}\d+$|^\[")
    return F.when(address, bare).when(two.rlike(TWO_LABEL_SUFFIX), F.substring_index(bare, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the winning rule, or nulls."""
    name = verdict = None
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block"))
    for rule in order:
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _strength(units: DataFrame, rate: str, settings: Reputation) -> DataFrame:
    """One row: the prior strength that the spread of k / n around the parent rates asks for."""
    chance = F.col(rate) * (1 - F.col(rate))
    spread = F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col(rate)) ** 2)
    correlation = F.try_divide(spread - F.sum(chance), F.sum(chance * (F.col("n") - 1)))
    bounded = F.greatest(F.lit(settings.weakest), F.least(F.lit(settings.strongest), F.coalesce(correlation, F.lit(settings.weakest))))
    return units.agg((1 / bounded - 1).alias("strength"))


def reputations(outcomes: DataFrame, settings: Reputation) -> DataFrame:
    """host, domain, suffix and the beta posterior (good, bad) of every host with outcomes,
    and with null host (and domain) what holds for the others below a domain or suffix.

    `outcomes` has host and good (0 or 1).
    """
    counts = outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k"))
    counts = written(counts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"))

    def level(*keys):
        return counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    overall = level().select(F.try_divide("k", "n").alias("rate0"))
    suffixes = level("suffix").join(overall)
    domains = level("suffix", "domain").join(level("suffix").select("suffix", (F.col("k") / F.col("n")).alias("raw")), "suffix")
    hosts = counts.join(level("suffix", "domain").select("suffix", "domain", (F.col("k") / F.col("n")).alias("raw")), ["suffix", "domain"])
    # Each of these is one row.
    by_suffix = _strength(suffixes, "rate0", settings).withColumnRenamed("strength", "s1")
    by_domain = _strength(domains, "raw", settings).withColumnRenamed("strength", "s2")
    by_host = _strength(hosts, "raw", settings).withColumnRenamed("strength", "s3")
    strengths = written(overall.join(by_suffix).join(by_domain).join(by_host))

    suffixes = level("suffix").join(F.broadcast(strengths))
    suffixes = suffixes.withColumn("rate1", (F.col("k") + F.col("s1") * F.col("rate0")) / (F.col("n") + F.col("s1")))
    upper = suffixes.select("suffix", "rate1", "s2", "s3")
    domains = level("suffix", "domain").join(upper, "suffix")
    domains = domains.withColumn("rate2", (F.col("k") + F.col("s2") * F.col("rate1")) / (F.col("n") + F.col("s2")))
    hosts = counts.join(domains.select("suffix", "domain", "rate2", "s3"), ["suffix", "domain"])
    known = hosts.select(
        "host",
        (F.col("k") + F.col("s3") * F.col("rate2")).alias("a"),
        (F.col("n") - F.col("k") + F.col("s3") * (1 - F.col("rate2"))).alias("b"),
    )
    prior = [
        domains.select("suffix", "domain", (F.col("s3") * F.col("rate2")).alias("a"), (F.col("s3") * (1 - F.col("rate2"))).alias("b")),
        suffixes.select("suffix", F.lit(None).cast("string").alias("domain"), (F.col("s2") * F.col("rate1")).alias("a"), (F.col("s2") * (1 - F.col("rate1"))).alias("b")),
        strengths.select(F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("domain"), (F.col("s1") * F.col("rate0")).alias("a"), (F.col("s1") * (1 - F.col("rate0"))).alias("b")),
    ]
    none = F.lit(None).cast("string")
    return known.select("host", none.alias("domain"), none.alias("suffix"), "a", "b").unionByName(
        prior[0].unionByName(prior[1]).unionByName(prior[2]).select(none.alias("host"), "domain", "suffix", "a", "b")
    )


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", good: str = "good", settings: Reputation | None = None) -> DataFrame:
    """key, host, path, rule, verdict, good_rate and good_rate_bound per row of `pages`.

    `outcomes` are labelled pages: their url and whether they are good (0 or 1).
    """
    settings = settings or Reputation()
    labelled = outcomes.where(quoted(good).isNotNull()).select(host_of(quoted(url)).alias("host"), quoted(good).cast("int").alias("good"))
    known = written(reputations(labelled, settings))
    own = pages.select(quoted(key).alias("key"), host_of(quoted(url)).alias("host"), path_of(quoted(url)).alias("path"))
    # One row per host of the pages. Written, so that the join with the pages, where a host
    # may have a large share of the rows, is between plain scans and can be split.
    hosts = own.select("host").distinct().select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    by_host = known.where(F.col("host").isNotNull()).select("host", F.struct("a", "b").alias("p0"))
    by_domain = known.where(F.col("domain").isNotNull()).select("suffix", "domain", F.struct("a", "b").alias("p1"))
    by_suffix = known.where(F.col("suffix").isNotNull() & F.col("domain").isNull()).select("suffix", F.struct("a", "b").alias("p2"))
    overall = known.where(F.coalesce("host", "domain", "suffix").isNull()).select(F.struct("a", "b").alias("p3"))
    found = hosts.join(by_host, "host", "left").join(by_domain, ["suffix", "domain"], "left").join(by_suffix, "suffix", "left")
    found = found.join(F.broadcast(overall), how="left").select("host", F.coalesce("p0", "p1", "p2", "p3").alias("p"), "p3")
    a, b = F.col("p.a"), F.col("p.b")
    usual = F.try_divide(F.col("p3.a"), F.col("p3.a") + F.col("p3.b"))
    rate = F.try_divide(a, a + b)
    deviation = F.sqrt(F.try_divide(a * b, (a + b) * (a + b) * (a + b + 1)))
    found = written(found.select("host", rate.alias("good_rate"), (rate + settings.deviations * deviation).alias("good_rate_bound"), (settings.bar * usual).alias("least")))
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    blocked = F.coalesce(F.col("good_rate_bound") < F.col("least"), F.lit(False))
    judged = own.join(found, "host", "left")
    return judged.select(
        F.col("key").alias(key),
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        "good_rate",
        "good_rate_bound",
    )
