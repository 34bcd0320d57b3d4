"""URL filter: path rules, then empirical-Bayes host reputation.  DataFrame functions only.

Labelled page outcomes are shrunk through beta-binomial priors: the corpus gives the
prior of a suffix, the suffix that of a registered domain, the domain that of a host; the
strength of each level's prior follows from how far its groups differ.  A host is blocked where
the lower posterior bound of its share of bad pages exceeds ``threshold``.  The bound lies ``z``
deviations under the mean (0.6745: the lower quartile).  By default the threshold is ``worse``
times the share of bad pages in the whole corpus, so a host is blocked when it is worse than the
corpus with a posterior probability of three quarters, whatever the corpus is like.

A public suffix is the last label of a host, or its last two where they are in ``SUFFIXES``; a
registered domain has one label more.

Outcomes are counted per host once and written; all levels are sums of that table, and three rows
of sums come to the driver.

Edge cases: a null url, or one without ``://``, has empty host and path and belongs to
the host ``''``; a null or repeated outcome counts as it stands (null: unlabelled); without
outcomes nothing is blocked but by rules; a host whose bound equals the threshold is allowed; of
rules of equal length the one that is last in the alphabet wins; a url of any length is taken
whole; repeated rows are judged each; an empty table gives an empty result; other columns of
``pages`` are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


# Public suffixes of two labels.
SUFFIXES = (
    "ac.jp ac.uk co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.hk com.mx com.sg com.tr com.tw com.ua "
    "edu.au edu.cn gov.au gov.cn gov.in gov.uk ne.jp net.au net.br net.cn or.jp org.au org.br org.cn org.uk"
).split()


def _last(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def suffix_of(host: Column) -> Column:
    return F.when(_last(host, 2).isin(SUFFIXES), _last(host, 2)).otherwise(_last(host, 1))


def domain_of(host: Column) -> Column:
    return F.when(_last(host, 2).isin(SUFFIXES), _last(host, 3)).otherwise(_last(host, 2))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule ``host/path`` that fits; null if none does.
    A rule fits its host and all subdomains, where the path starts with the rule's."""
    rule = verdict = F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[text])).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, prior: Column, least: float, most: float) -> float:
    """Beta-binomial prior strength by the method of moments: one row comes to the driver."""
    n, k = F.col("n"), F.col("k")
    row = groups.filter(n > 0).agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("all"),
        F.sum(n * n).alias("squares"),
        F.sum(n * (k / n - prior) * (k / n - prior)).alias("between"),
        F.sum(n * prior * (1 - prior)).alias("within"),
    ).first()
    if not row["groups"] or row["groups"] < 2 or not row["within"]:
        return most
    variance = row["within"] / row["all"]
    free = row["groups"] - 1
    spread = row["all"] - row["squares"] / row["all"] - free
    if spread <= 0:
        return most
    rho = (row["between"] - variance * free) / (variance * spread)
    return min(most, max(least, 1 / rho - 1)) if rho > 0 else most


def _base(k, n) -> float:
    """The share of bad pages in the corpus, with one page of either kind added."""
    return ((k or 0.0) + 1.0) / ((n or 0.0) + 2.0)


def host_counts(outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, n, k) from rows (host, bad): labelled pages and bad ones, as a
    table.  Counts are added up map-side, so a host with a third of all pages costs one row a task."""
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k")
    )
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    return materialize(hosts, "host-counts")


def base_rate(hosts: DataFrame) -> float:
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    return _base(whole["k"], whole["n"])


def reputation(hosts: DataFrame, least: float = 2.0, most: float = 200.0, z: float = 0.6745) -> DataFrame:
    """(host, n, k, bad_mean, bad_lower) from rows of ``host_counts``."""
    base = base_rate(hosts)

    def shrunk(groups: DataFrame, prior: Column, name: str) -> DataFrame:
        s = _strength(groups, prior, least, most)
        return groups.withColumn(name, (F.col("k") + s * prior) / (F.col("n") + s))

    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = materialize(shrunk(suffixes, F.lit(base), "suffix_mean"), "suffix-means")
    domains = domains.join(suffixes.select("suffix", "suffix_mean"), "suffix")
    domains = materialize(shrunk(domains, F.col("suffix_mean"), "domain_mean"), "domain-means")
    hosts = hosts.join(domains.select("domain", "domain_mean"), "domain")
    s = _strength(hosts, F.col("domain_mean"), least, most)
    a = F.col("k") + s * F.col("domain_mean")
    b = F.col("n") - F.col("k") + s * (1 - F.col("domain_mean"))
    mean = a / (a + b)
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "k", mean.alias("bad_mean"), (mean - z * spread).alias("bad_lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], threshold: float | None = None, worse: float = 1.0, **options) -> DataFrame:
    """``pages`` with host, path, rule and verdict (``allow`` or ``block``).

    ``outcomes`` has rows (host, bad).  Existing columns of these names are replaced."""
    own = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(F.struct(*own).alias("row"), host.alias("host"), path.alias("path"))  # names cannot clash
    hosts = host_counts(outcomes)
    most = worse * base_rate(hosts) if threshold is None else threshold
    blocked = reputation(hosts, **options).filter(F.col("bad_lower") > most)
    known = materialize(blocked.select(F.col("host").alias("known_host")), "blocked-hosts")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = urls.join(known, urls["host"] == known["known_host"], "left")
    mine = F.when(F.col("known_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("row.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, mine).alias("verdict"))
