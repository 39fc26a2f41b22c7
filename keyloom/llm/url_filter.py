"""URL filter: explicit rules first, then the reputation of the host by empirical Bayes.

Outcomes of labelled pages (good or not) are counted by host. Three nested levels shrink them: public suffix, registered
domain, host. A level's Beta prior has the posterior mean of the level above as its mean; its strength is fitted by moments
from the spread of the rates of all groups of that level. A host without labels keeps its domain's posterior mean, a domain
without labels its suffix's. A host is blocked if the lower bound of its posterior (mean less Z standard deviations) is under
LEAST_GOOD.

Everything is DataFrame expressions. Counts are summed by host before anything else moves, so a host with a third of all
rows costs no more than any other; the verdicts of hosts are joined back by broadcast while there are at most BROADCAST_HOSTS
of them, and by a salted join beyond.

Defined results: a null url, or one without "://", has empty host and path, fits no rule and is judged as a host without
labels. Very long urls are split whole. Labels that repeat are outcomes of their own, pages that repeat are each judged. Null labels are
no outcomes. Without any labels the prior is 1/2. Empty pages give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace

#: (verdict, host, path) of the rules; a rule holds for the host and all its subdomains.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk"]
#: Numeric addresses, of four numbers or in brackets.
NUMERIC = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"
Z, LEAST_GOOD = 1.645, 0.5
#: Strength of a prior where the spread of rates cannot be told.
DEFAULT_STRENGTH, MAX_STRENGTH = 10.0, 1000.0
#: Hosts with a verdict that are broadcast at most (about 60 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 200_000
SALT = 64


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Host (lower-cased) and path of an url, without a copy of the query or fragment."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    which = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first, as the outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        which, verdict = F.when(fits, F.lit(h + p)).otherwise(which), F.when(fits, F.lit(said)).otherwise(verdict)
    return which, verdict


def domain_of(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without user, port and closing dots. A numeric address is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")
    address = F.regexp_like(name, F.lit(NUMERIC))
    last2 = F.substring_index(name, ".", -2)
    suffix = F.when(address, name).when(last2.isin(TWO_LABEL_SUFFIXES), last2).otherwise(F.substring_index(name, ".", -1))
    return F.when(address, name).when(last2.isin(TWO_LABEL_SUFFIXES), F.substring_index(name, ".", -3)).otherwise(last2), suffix


def strength(counts: DataFrame, mean: Column) -> float:
    """Of the Beta prior of a level, by moments: rates vary around the prior mean by m(1-m)/(s+1) and by sampling."""
    n, rate = F.col("n").cast("double"), F.col("good") / F.col("n")
    # E[n (rate - m)^2] = m(1-m) (1 + (n-1)/(s+1)), summed over the groups
    row = counts.filter("n > 0").select(
        F.sum(n * (rate - mean) * (rate - mean)).alias("seen"), F.sum(mean * (1 - mean)).alias("base"), F.sum(mean * (1 - mean) * (n - 1)).alias("more")
    ).first()
    if not row["base"] or not row["more"]:
        return DEFAULT_STRENGTH
    excess = (row["seen"] - row["base"]) / row["more"]  # = 1/(s+1)
    return MAX_STRENGTH if excess <= 1 / (MAX_STRENGTH + 1) else max(1e-3, 1 / excess - 1)


def reputation(hosts: DataFrame) -> DataFrame:
    """hosts: host, good, n (n may be 0). Adds the posterior mean and its lower bound."""
    domain, suffix = domain_of(F.col("host"))
    hosts = hosts.select("host", "good", "n", domain.alias("domain"), suffix.alias("suffix"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = suffixes.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    root = ((total["good"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)

    def mean(above: Column | float, s: float) -> Column:
        return (F.lit(s) * above + F.col("good")) / (F.lit(s) + F.col("n"))

    s1 = strength(suffixes, F.lit(root))
    suffixes = suffixes.select("suffix", mean(F.lit(root), s1).alias("m1"))
    with_suffix = domains.join(suffixes, "suffix")
    s2 = strength(with_suffix, F.col("m1"))
    with_domain = hosts.join(with_suffix.select("domain", mean(F.col("m1"), s2).alias("m2")), "domain")
    s3 = strength(with_domain, F.col("m2"))
    m, size = mean(F.col("m2"), s3), F.lit(s3) + F.col("n")
    return with_domain.select("host", "good", "n", m.alias("mean"), (m - Z * F.sqrt(m * (1 - m) / (size + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages: page_id, url. outcomes: url_id (the number in a path that names its document), good (boolean). One row per page."""
    spark = pages.sparkSession
    work = Workspace(spark, "urls")
    host, path = split_url()
    split = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    which, said = rule_of(F.col("host"), F.col("path"), rules)
    split = split.withColumns({"rule": which, "said": said})
    url_id = F.regexp_extract("path", r"^/[^/]+/([0-9]{1,18})(?:/|\.html)?$", 1)
    sums = outcomes.filter("url_id is not null and good is not null").groupBy("url_id").agg(F.sum(F.col("good").cast("bigint")).alias("good"), F.count("*").alias("n"))
    named = split.select("host", F.when(url_id != "", url_id.cast("bigint")).alias("url_id"))
    # hosts and document numbers are summed first: a number on a third of the pages is one row a host here
    seen = named.groupBy("host", "url_id").agg(F.count("*").alias("pages")).join(sums, "url_id", "left")
    hosts = seen.groupBy("host").agg(F.coalesce(F.sum(F.col("good") * F.col("pages")), F.lit(0)).alias("good"), F.coalesce(F.sum(F.col("n") * F.col("pages")), F.lit(0)).alias("n"))
    hosts = work.stage(hosts, "hosts")
    judged = work.stage(reputation(hosts).select("host", "good", "n", "bound"), "judged")
    verdict = judged.select("host", F.when(F.col("bound") < LEAST_GOOD, F.lit("block")).otherwise(F.lit("allow")).alias("by_host"), "n")
    if judged.count() <= BROADCAST_HOSTS:
        both = split.join(F.broadcast(verdict), "host", "left")
    else:
        salted = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = split.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    return both.select("page_id", "host", "path", "rule", F.coalesce("said", "by_host").alias("verdict"), F.coalesce("n", F.lit(0)).alias("host_outcomes"))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Labelled outcomes: good is of quality and not toxic."""
    return labels.select(F.col("doc_id").alias("url_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
