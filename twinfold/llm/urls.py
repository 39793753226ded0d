"""URL filters: rules by host and path, and empirical-Bayes host reputation for what no rule decides.

Labelled page outcomes are counted per host. Each level's bad rate is shrunk
towards the level above through a beta-binomial prior: host to registered
domain to public suffix to all pages. The strength of each prior is estimated
from how much the units of that level differ. A host is blocked if the lower
bound of its posterior bad rate is above ``BLOCK_RATE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.tables import column, stored

#: Fixed values: (host, path) of each rule and its verdict.
RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}
#: Public suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in")
#: One-sided 95% bound, and the bad rate that it must exceed.
Z, BLOCK_RATE = 1.645, 0.5
#: Limits of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 10_000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for a null or other url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    ordered = sorted(rules, key=lambda r: (-len(r), r))
    found = F.lit(None).cast("string")
    for rule in reversed(ordered):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _strength(units: DataFrame) -> float:
    """The beta prior's strength by the method of moments over the units' counts n and k; one row is collected."""
    n, k = F.col("n"), F.col("k").cast("double")
    total = units.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count("*").alias("units"), F.sum(k * k / n).alias("kk")).first()
    if not total["n"]:
        return STRONGEST
    mean = total["k"] / total["n"]
    noise = mean * (1 - mean)
    between = total["kk"] / total["n"] - mean * mean - noise * total["units"] / total["n"]
    return min(max(noise / between - 1, WEAKEST), STRONGEST) if between > 0 else STRONGEST


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(domain, suffix, level, host, n, k, bound): posterior lower bounds of hosts, domains, suffixes and all pages.

    ``outcomes`` has host and bad (0 or 1), one row per labelled page. Rows of the levels above the host have
    null in the finer columns; they serve hosts without any labelled page.
    """
    hosts = stored(
        outcomes.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
        .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"),
        "host-counts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    totals = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = F.lit(totals["k"] / totals["n"] if totals["n"] else 0.0)

    def posterior(k, n, strength: float, above: Column):
        mean = (k + strength * above) / (n + strength)
        return mean, mean - Z * F.sqrt(mean * (1 - mean) / (n + strength + 1))

    mean, bound = posterior(F.col("k"), F.col("n"), _strength(suffixes), overall)
    suffixes = suffixes.select("suffix", "n", "k", mean.alias("suffix_mean"), bound.alias("bound"))
    above = F.col("suffix_mean")
    mean, bound = posterior(F.col("k"), F.col("n"), _strength(domains), above)
    domains = domains.join(suffixes.select("suffix", "suffix_mean"), "suffix").select("suffix", "domain", "n", "k", mean.alias("domain_mean"), bound.alias("bound"))
    mean, bound = posterior(F.col("k"), F.col("n"), _strength(hosts), F.col("domain_mean"))
    hosts = hosts.join(domains.select("domain", "suffix", "domain_mean"), ["domain", "suffix"]).select("suffix", "domain", "host", "n", "k", bound.alias("bound"))
    none = F.lit(None).cast("string")
    return stored(
        hosts.select("suffix", "domain", "host", "n", "k", "bound", F.lit("host").alias("level"))
        .unionByName(domains.select("suffix", "domain", none.alias("host"), "n", "k", "bound", F.lit("domain").alias("level")))
        .unionByName(suffixes.select("suffix", none.alias("domain"), none.alias("host"), "n", "k", "bound", F.lit("suffix").alias("level"))),
        "reputation",
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """One row per page: host, path, the rule that fits best and the verdict, with the host's labelled and bad pages.

    A page whose host has no labelled page takes its domain's verdict, then its suffix's, else it is allowed. A
    null url or one without ``://`` has an empty host and path, no rule, and is allowed. Repeated rows and rows
    without page_id are judged like others; other columns are ignored; empty tables give an empty one, and no
    outcomes at all allow what no rule blocks.
    """
    reputation = host_reputation(outcomes)
    url = column(pages, "url", "string")
    judged = pages.select(column(pages, "page_id", "long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    for level in ("host", "domain", "suffix"):
        known = reputation.where(F.col("level") == level).select(level, F.col("n").alias(f"{level}_n"), F.col("k").alias(f"{level}_k"), F.col("bound").alias(f"{level}_bound"))
        judged = judged.join(known, level, "left")
    bound = F.coalesce("host_bound", "domain_bound", "suffix_bound", F.lit(0.0))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("rule")]
    return judged.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule",
        F.coalesce(by_rule, F.when(bound > BLOCK_RATE, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("host_n", F.lit(0).cast("long")).alias("host_labelled"), F.coalesce("host_k", F.lit(0).cast("long")).alias("host_bad"),
    )


def outcomes_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of pages whose path ends with the id of a labelled document; bad is low quality or toxic."""
    url = column(pages, "url", "string")
    number = F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.html|/)?$", 1)
    named = pages.select(host_of(url).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = (F.coalesce(column(labels, "quality", "int"), F.lit(1)) == 0) | (F.coalesce(column(labels, "toxic", "int"), F.lit(0)) == 1)
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    return named.join(marked, "doc_id").select("host", "bad")
