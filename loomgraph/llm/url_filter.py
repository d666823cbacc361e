"""URL filters: prefix rules first, then empirical-Bayes host reputation. DataFrame expressions only.

Labelled page outcomes (good or bad) are counted by host, registered domain and suffix. A
beta-binomial prior is fitted at each level by the method of moments and handed down: the
suffix is shrunk towards all pages, the domain towards its suffix, the host towards its domain.
A host is blocked if even the upper bound of its posterior, a beta quantile, lies below `floor`
times the share of good pages among all: it is worse than the average host with that confidence.
Unlabelled hosts take their domain's posterior, or the suffix's, or that of all pages.

A suffix is a host's last label, or its last two if the last has two letters and the one before
is a second-level name (fixed list below). Null urls and urls without `://` have an empty host
and path, match no rule and are judged as a host like any other. Ties between rules of equal
length go to the longer host, then to the earlier rule. Repeated pages each get a row. With no
labelled page at all every host is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Names registries use as second level below a two-letter suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "or", "org")


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def levels(host_: Column) -> tuple[Column, Column]:
    """Registered domain and suffix."""
    tail = rf"(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]|[^.]*)$"
    top = F.regexp_extract(host_, rf"(?:^|\.)({tail[:-1]})$", 1)
    domain = F.regexp_extract(host_, rf"(?:^|\.)([^.]+\.{tail[:-1]})$", 1)
    return F.when(domain == "", top).otherwise(domain), top


def matching_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """A struct (verdict, host, path) of the longest rule that fits, or null."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1]), i))
    out = F.lit(None).cast("struct<verdict:string,host:string,path:string>")
    for i in reversed(order):
        verdict, h, p = rules[i]
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))).otherwise(out)
    return out


def beta_quantile(a: Column, b: Column, z: float) -> Column:
    """The quantile of a beta distribution that the normal one has at z, by formula 26.5.22 of Abramowitz and Stegun;
    for parameters of up to a half, where it does not hold, on the arcsine scale."""
    p, q = 1 / (2 * a - 1), 1 / (2 * b - 1)
    h, lam = 2 / (p + q), (z * z - 3) / 6
    w = -z * F.sqrt(h + lam) / h - (q - p) * (lam + 5 / 6 - 2 / (3 * h))
    rough = F.asin(F.sqrt(a / (a + b))) + z / (2 * F.sqrt(a + b))
    rough = F.pow(F.sin(F.least(F.greatest(rough, F.lit(0.0)), F.lit(1.5707963267948966))), 2)
    return F.when((a > 0.5) & (b > 0.5) & (h + lam > 0), a / (a + b * F.exp(2 * w))).otherwise(rough)


def _strength(rows: DataFrame, least: float, most: float) -> float:
    """The prior's weight in pages, from how far shares of groups scatter beyond chance.

    rows: n pages and k good ones of each group, and m, the mean that its prior has.
    With q = sum (k - n m)^2 / (m (1 - m)) over groups and independent pages, E q = sum n (1 + (n - 1) r),
    r = 1 / (weight + 1).
    """
    m = F.least(F.greatest("m", F.lit(1e-6)), F.lit(1 - 1e-6))
    q, n, pairs = F.sum(F.pow(F.col("k") - F.col("n") * m, 2) / (m * (1 - m))), F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))
    r = (q - n) / pairs
    weight = F.when((pairs > 0) & (r > 0), F.least(F.greatest(1 / r - 1, F.lit(least)), F.lit(most))).otherwise(F.lit(most))
    return float(rows.agg(F.coalesce(weight, F.lit(most)).alias("weight")).first()["weight"])


def reputation(outcomes: DataFrame, least: float = 2.0, most: float = 1000.0) -> tuple[DataFrame, DataFrame, DataFrame, float | None]:
    """Posteriors (a, b) by host, domain and suffix, and the share of good pages of all, from outcomes (host, good 0/1).

    Pages are summed by host within each task before anything is shuffled, so one host with a
    third of all pages is one row per task. The sums are written once; the levels above read them.
    Four numbers reach the driver.
    """
    domain_of, suffix_of = levels(F.col("host"))
    hosts = outcomes.filter(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("good").cast("long")).cast("double").alias("k"))
    hosts = common.spill(hosts.withColumns({"domain": domain_of, "suffix": suffix_of}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    share = hosts.agg(F.when(F.sum("n") > 0, (F.sum("k") + 1) / (F.sum("n") + 2)).alias("m")).first()["m"]

    def shrink(rows: DataFrame, keys: list[str]) -> DataFrame:
        weight = _strength(rows, least, most)
        return rows.select(*keys, (F.col("m") * weight + F.col("k")).alias("a"), ((1 - F.col("m")) * weight + F.col("n") - F.col("k")).alias("b"))

    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("m")
    by_suffix = shrink(suffixes.withColumn("m", F.lit(share).cast("double")), ["suffix"])
    by_domain = shrink(domains.join(by_suffix.select("suffix", mean), "suffix"), ["domain"])
    by_host = shrink(hosts.join(by_domain.select("domain", mean), "domain"), ["host"])
    return by_host, by_domain, by_suffix, share


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], floor: float = 1.0, z: float = 1.645, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, reputation (posterior mean of its host, null where a rule decided).

    pages: page_id, url. outcomes: host, good (0/1, null: unlabelled). rules: (allow or block, host, path).
    floor: of the share of good pages. z: the upper bound, as a quantile of the normal distribution.
    least, most: bounds of a prior's weight, in pages.
    """
    pages = common.pick(pages, page_id="long", url="string")
    pages = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    pages = pages.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    by_host, by_domain, by_suffix, share = reputation(outcomes, least, most)

    # Every distinct host is judged once; pages then meet the verdict of their host.
    domain_of, suffix_of = levels(F.col("host"))
    judged = pages.filter("found is null").groupBy("host").agg(F.lit(1).alias("one")).drop("one")
    judged = judged.withColumns({"domain": domain_of, "suffix": suffix_of})
    for rows, key in ((by_host, "host"), (by_domain, "domain"), (by_suffix, "suffix")):
        judged = judged.join(rows.select(key, F.struct("a", "b").alias(f"of_{key}")), key, "left")
    of_all = F.when(F.lit(share is not None), F.struct(F.lit((share or 0) * most).alias("a"), F.lit((1 - (share or 0)) * most).alias("b")))
    judged = judged.withColumn("p", F.coalesce("of_host", "of_domain", "of_suffix", of_all))
    a, b = F.col("p.a"), F.col("p.b")
    judged = judged.select("host", (a / (a + b)).alias("reputation"), (beta_quantile(a, b, z) < floor * (share or 0)).alias("bad"))
    judged = common.spill(judged, "judged")  # one row a host; so the join below may be split where a host has many pages

    out = pages.join(judged, "host", "left")
    rule = F.when(F.col("found").isNotNull(), F.concat("found.host", "found.path"))
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("found.verdict", method).alias("verdict"), F.when(F.col("found").isNull(), F.col("reputation")).alias("reputation"))
