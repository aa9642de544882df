"""Host reputation by empirical Bayes: labelled page outcomes shrunk from host to domain to suffix.

Each level is a beta-binomial model.  The prior of a level has the posterior mean
of the level above as its mean; its strength comes from how far the groups of the
level scatter around that mean beyond binomial chance (method of moments).  A page
is allowed where an upper bound of its host's posterior good rate reaches a
threshold: only hosts that are surely bad are blocked.  A host without outcomes has
the prior that its domain, suffix and all outcomes give it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.scratch import cut

#: Fixed: host and path of a url.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEVELS = ("suffix", "domain", "host")
#: Strength of a prior, in pseudo pages: the estimate is kept within these bounds.
STRENGTH = (2.0, 1000.0)


def url_part(url: Column, group: int) -> Column:
    part = F.coalesce(F.regexp_extract(url, URL, group), F.lit(""))
    return F.translate(part, string.ascii_uppercase, string.ascii_lowercase) if group == 1 else part


def with_levels(df: DataFrame, host: str = "host") -> DataFrame:
    """Registered domain (last two labels) and suffix (last label) of a host without its port."""
    bare = F.regexp_replace(F.col(host), r":[0-9]*$", "")
    return df.withColumns({"domain": F.regexp_extract(bare, r"([^.]*\.)?[^.]*$", 0), "suffix": F.regexp_extract(bare, r"[^.]*$", 0)})


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule ``host/path`` that fits, and its verdict; null where none fits.

    ``rules`` is a configured list of (verdict, rule); a rule fits its host and all
    subdomains where the path starts with the rule's.  Of equal rules the first wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, rule in sorted(reversed(rules), key=lambda x: len(x[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(word)).otherwise(verdict)
    return name, verdict


def reputation(outcomes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Posterior of every host in ``outcomes`` (host, good 0/1): domain, suffix, pages, post_mean, post_strength.

    Hosts of ``asked`` (host) without an outcome take part with 0 pages: their
    posterior is their prior, with the mean of the domain, which without outcomes
    has that of the suffix, and that the mean of all; the scatter of all levels
    without outcomes adds up.  They move no other posterior.
    Rows without an outcome count for nothing, a null host is the host "".  Counts
    are aggregated map-side first, so a host with a third of all rows is one row.
    No outcomes and no hosts asked for: no rows.
    """
    one = F.col("good").isin(0, 1)
    name = F.coalesce("host", F.lit("")).alias("host")
    hosts = outcomes.where(one).groupBy(name).agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("k"))
    if asked is not None:
        none = asked.select(name).distinct().select("host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"))
        hosts = hosts.unionByName(none).groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    level = cut(with_levels(hosts), "hosts")
    domains = level.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("m"))
    suffixes = shrink(suffixes.withColumns({"m": total.scalar(), "u": F.lit(1.0)})).select("suffix", F.col("post_mean").alias("m"), "u")
    domains = shrink(domains.join(suffixes, "suffix")).select("domain", F.col("post_mean").alias("m"), "u")
    return shrink(level.join(domains, "domain")).select("host", "domain", "suffix", F.col("n").alias("pages"), "post_mean", "post_strength")


def shrink(groups: DataFrame) -> DataFrame:
    """Posterior mean and strength of groups with ``k`` good of ``n`` pages and prior mean ``m``.

    1 - ``u`` is the variance of the level above in units of m (1 - m), as far as no
    page told about it; a group without pages adds its own, c / (c + 1) at strength c.
    The groups are stored first: a scalar subquery would plan all below them again.
    """
    groups = cut(groups, "groups")
    n, k, m = F.col("n"), F.col("k"), F.col("m")
    spread = m * (1 - m)
    # expected square of k - n m: n m (1 - m) (1 + (n - 1) rho)
    rho = groups.agg(F.try_divide(F.sum((k - n * m) * (k - n * m) - n * spread), F.sum(n * (n - 1) * spread)).alias("rho"))
    low, high = STRENGTH
    kept = F.greatest(F.least(F.coalesce(rho.scalar(), F.lit(0.0)), F.lit(1 / (low + 1))), F.lit(1 / (high + 1)))
    strength = 1 / kept - 1
    c = F.col("strength")
    u = F.when(n > 0, 1.0).otherwise(F.col("u") * c / (c + 1))
    return groups.withColumn("strength", strength).select(
        *(x for x in groups.columns if x != "u"),
        ((k + c * m) / (n + c)).alias("post_mean"),
        F.when(n > 0, n + c).otherwise(1 / (1 - u) - 1).alias("post_strength"),
        u.alias("u"),
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], least: float = 0.5, sigmas: float = 2.0, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and upper_bound to every page.

    A fitting rule decides; else a page is blocked where the posterior good rate of
    its host lies below ``least`` by more than ``sigmas`` posterior deviations.
    A host without outcomes is judged by its prior, from its domain, suffix or all
    outcomes; without any outcomes all pages are allowed.  A null url,
    or one without ``://``, has empty host and path.  Repeated rows and rows with
    equal ids are judged one by one; columns of these names are replaced.
    """
    host, path = url_part(F.col(url), 1), url_part(F.col(url), 2)
    rep = reputation(outcomes, pages.select(host.alias("host"))).select(F.col("host").alias("_host"), "post_mean", "post_strength")
    mean, strength = F.col("_rep.post_mean"), F.col("_rep.post_strength")
    bound = mean + sigmas * F.sqrt(mean * (1 - mean) / (strength + 1))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    made = ("host", "path", "rule", "verdict", "upper_bound")
    kept = [c for c in pages.columns if c not in made]
    base = pages.withColumns({"host": host, "path": path}).select(*kept, "host", "path").alias("_page")
    joined = base.join(rep.alias("_rep"), F.col("_page.host") == F.col("_rep._host"), "left")
    return joined.select(
        *(F.col(f"_page.`{c}`") for c in kept),
        F.col("_page.host"),
        F.col("_page.path"),
        name.alias("rule"),
        F.coalesce(verdict, F.when(bound < least, "block").otherwise("allow")).alias("verdict"),
        bound.alias("upper_bound"),
    )
