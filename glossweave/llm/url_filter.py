"""URL filters: explicit rules, then empirical-Bayes reputation of hosts.

Labelled pages are outcomes of hosts. At each level (suffix, registered domain, host) the spread of the
rates among children of a parent sets how strongly a child is drawn to its parent: a beta-binomial prior with the
parent's mean and the level's strength, by the method of moments. A page is blocked when the upper posterior
bound of its host's rate of good pages is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The last label, or the longest of the given suffixes of several labels."""
    out = F.substring_index(host, ".", -1)
    for s in sorted(suffixes, key=len):
        out = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(out)
    return out


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more; the host itself where there is none."""
    rest = F.substr(host, F.lit(1), F.greatest(F.lit(0), F.length(host) - F.length(suffix) - 1))
    return F.when(rest == "", host).otherwise(F.concat_ws(".", F.substring_index(rest, ".", -1), suffix))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is `host/path`; at most 1,000 of them."""
    if len(rules) > 1000:
        raise ValueError("more than 1,000 rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one is asked first
        own, begin = text.split("/", 1)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + begin)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, parent_mean: Column) -> float:
    """Prior strength of a level by moments: how much more the children's rates differ from their parents' means
    than binomial chance allows. One row comes to the driver."""
    m = parent_mean
    spread = F.col("n") * F.pow(F.col("x") / F.col("n") - m, 2)
    row = children.agg(F.count("*").alias("k"), F.sum(spread).alias("s"), F.sum(m * (1 - m)).alias("v"), F.sum(m * (1 - m) * F.col("n")).alias("w")).first()
    if not row.k or not row.v or row.w <= row.v:
        return 10.0
    share = min(max((row.s - row.v) / (row.w - row.v), 1e-3), 0.99)  # the correlation of pages of one child
    return 1 / share - 1


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = (), z: float = 1.6448536269514722) -> DataFrame:
    """(level, name, n, x, mean, upper): for each suffix, domain and host of outcomes (host, n, x: of n pages x are
    good; a host may have several rows), and one row of level `all`; mean and upper are of the posterior (normal approximation, z deviations)."""
    suffix = suffix_of(F.col("host"), suffixes)
    hosts = outcomes.where("host is not null and n > 0").groupBy("host").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    hosts = written(hosts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "host-outcomes")  # each level is summed from it
    sums = [F.sum("n").alias("n"), F.sum("x").alias("x")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    tops = domains.groupBy("suffix").agg(*sums)
    total = tops.agg(*sums).first()
    n, x = (total.n or 0), (total.x or 0)
    mean = (x + 1) / (n + 2)

    def posterior(level: DataFrame, prior: Column, k: float) -> DataFrame:
        a, b = F.lit(k) * prior + F.col("x"), F.lit(k) * (1 - prior) + F.col("n") - F.col("x")
        m = a / (a + b)
        return level.withColumn("mean", m).withColumn("upper", F.least(F.lit(1.0), m + z * F.sqrt(m * (1 - m) / (a + b + 1))))

    tops = posterior(tops, F.lit(mean), _strength(tops, F.lit(mean)))
    domains = domains.join(tops.select("suffix", F.col("mean").alias("prior")), "suffix")
    domains = posterior(domains, F.col("prior"), _strength(domains, F.col("prior")))
    hosts = hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain")
    hosts = posterior(hosts, F.col("prior"), _strength(hosts, F.col("prior")))
    spark = outcomes.sparkSession
    everything = spark.range(1).select(F.lit("all").alias("level"), F.lit("").alias("name"), F.lit(n).cast("long").alias("n"), F.lit(x).cast("long").alias("x"), F.lit(mean).alias("mean"), F.lit(min(1.0, mean + z * (mean * (1 - mean) / (n + 3)) ** 0.5)).alias("upper"))
    rows = [df.select(F.lit(level).alias("level"), F.col(level).alias("name"), "n", "x", "mean", "upper") for level, df in (("suffix", tops), ("domain", domains), ("host", hosts))]
    return everything.unionByName(rows[0]).unionByName(rows[1]).unionByName(rows[2])


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", suffixes: tuple[str, ...] = (), least_good: float = 0.5) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, level, upper.

    verdict is the longest fitting rule's, else block where the upper posterior bound of the most specific
    known level (host, domain, suffix, all) is below least_good, else allow. A null url, or one without
    `://`, has an empty host and path and is judged by all outcomes. Null and repeated ids pass through; without
    outcomes every page without a rule is allowed; an empty table gives no rows.
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "told": verdict, "suffix": suffix_of(F.col("host"), suffixes)})
    known = reputations(outcomes, suffixes)
    every = known.where("level = 'all'").first()
    hosts = own.groupBy("host", "suffix").agg(F.count("*").alias("pages")).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))
    of = {level: known.where(F.col("level") == level).select(F.col("name").alias(level), F.col("upper").alias(f"{level}_upper")) for level in ("host", "domain", "suffix")}
    hosts = hosts.join(of["host"], "host", "left").join(of["domain"], "domain", "left").join(of["suffix"], "suffix", "left")
    upper = F.coalesce("host_upper", "domain_upper", "suffix_upper", F.lit(every.upper if every.n else 1.0))
    level = F.when(F.col("host_upper").isNotNull(), "host").when(F.col("domain_upper").isNotNull(), "domain").when(F.col("suffix_upper").isNotNull(), "suffix").otherwise("all")
    judged = hot_join(own.drop("suffix"), hosts.select("host", "pages", level.alias("level"), upper.alias("upper")), "host", "pages")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("told", F.when(F.col("upper") < least_good, "block").otherwise("allow")).alias("verdict"), "level", "upper")


def page_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, n, x) of the pages whose path ends in the number of a labelled document: x of n serve a document of
    quality 1 that is not toxic.

    A document with several label rows is good if all of them are; labels with a null id or without both marks give nothing.
    """
    url = F.col(url_col)
    number = F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    served = pages.select(host_of(url).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id")).where("doc_id is not null").groupBy("host", "doc_id").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(((F.col("quality") > 0) & (F.col("toxic") <= 0)).cast("long")).alias("good")).where("good is not null")
    return served.join(marks, "doc_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("x"))
