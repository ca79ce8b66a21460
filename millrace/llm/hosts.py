"""URL filters: explicit rules, then host reputations shrunk through beta-binomial priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import materialized

#: (verdict, host, path prefix); a rule holds for its host and all subdomains, the longest that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Second-level labels under which names are registered in country domains.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A host is blocked if, by the posterior's lower bound of so many deviations, the odds of a bad page of it are more
#: than so many times the odds over all labelled pages.
ODDS, DEVIATIONS = 1.5, 1.645
#: Weight of the prior of one level, in pages, where the data don't say: least, most.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``.  Both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its port."""
    name = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"\.+$", "")
    suffix = F.regexp_extract(name, r"((?:(?:%s)\.[a-z]{2})|[^.]*)$" % "|".join(SECOND_LEVEL), 1)
    domain = F.regexp_extract(name, r"([^.]*\.(?:(?:%s)\.[a-z]{2}|[^.]*))$" % "|".join(SECOND_LEVEL), 1)
    return F.when(domain == "", name).otherwise(domain), suffix


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does.  Of equally long rules the first wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _weight(children: DataFrame, n: str, k: str, mean: str) -> float:
    """How many pages a level's prior counts as, from how much children differ from their parent (moments)."""
    one = children.filter(f"{n} > 0").select(
        F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - F.col(mean), F.lit(2)) / (F.col(mean) * (1 - F.col(mean)))).alias("spread"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(n).alias("pages"),
    )
    r = one.first()
    if not r["groups"] or r["pages"] <= r["groups"]:
        return MOST_WEIGHT
    excess = (r["spread"] - r["groups"]) / (r["pages"] - r["groups"])
    return MOST_WEIGHT if excess <= 1 / (1 + MOST_WEIGHT) else max(LEAST_WEIGHT, (1 - excess) / excess)


def most_bad(overall: float, odds: float = ODDS) -> float:
    """The rate of bad pages whose odds are ``odds`` times those of the overall rate; below one as long as that is."""
    return odds * overall / (1.0 - overall + odds * overall)


def reputations(pages: DataFrame, odds: float = ODDS, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, n, bad, mean, bound, verdict) per host of (host, labelled, bad) rows.

    Bad pages of a suffix are drawn to the overall rate, a registered domain's to
    its suffix's and a host's to its domain's, by beta priors whose weight comes
    from how much each level's members differ.  ``bound`` is the lower bound of
    the posterior bad rate; hosts are blocked where it is beyond the rate that
    :func:`most_bad` gives for all labelled pages, so the threshold follows the
    labels.  Labels that don't differ by host block none.  Hosts without labels
    rest on their domain.
    """
    domain, suffix = domain_parts(F.col("host"))
    hosts = pages.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("k"))
    hosts = materialized(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    total = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)), F.coalesce(F.sum("sk"), F.lit(0))).first()
    overall = (total[1] + 1.0) / (total[0] + 2.0)
    suffixes = suffixes.withColumn("sp", F.lit(overall))
    w = _weight(suffixes, "sn", "sk", "sp")
    suffixes = suffixes.select("suffix", ((F.col("sk") + w * overall) / (F.col("sn") + w)).alias("sm"))
    domains = domains.join(suffixes, "suffix")
    w = _weight(domains, "dn", "dk", "sm")
    domains = domains.select("domain", "suffix", ((F.col("dk") + w * F.col("sm")) / (F.col("dn") + w)).alias("dm"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    w = _weight(hosts, "n", "k", "dm")
    mean = (F.col("k") + w * F.col("dm")) / (F.col("n") + w)
    bound = F.col("mean") - deviations * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + w + 1))
    out = hosts.select("host", "n", F.col("k").alias("bad"), mean.alias("mean")).withColumn("bound", bound)
    return out.withColumn("verdict", F.when(F.col("bound") > most_bad(overall, odds), "block").otherwise("allow"))


def judge(pages: DataFrame, url: str, labelled: str, bad: str, rules: Sequence[tuple[str, str, str]] = RULES, odds: float = ODDS, deviations: float = DEVIATIONS) -> DataFrame:
    """Add host, path, rule and verdict (allow or block) to each page.

    ``labelled`` and ``bad`` are 0/1 columns: whether a page's outcome is known,
    and is bad; nulls count as 0.  A rule decides where one fits, else the host's
    reputation, which all labelled pages make, under rules or not.  Null urls
    have the empty host, which is a host like others.  Columns of these names are
    replaced, all others and all rows stay; no pages give no rows.

    Pages are aggregated to hosts before anything is shuffled by host; a host
    with most of the pages is the hot side of a join with one row per host,
    which AQE splits.
    """
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col(f"`{url}`"))
    base = pages.select(*[F.col(f"`{c}`") for c in names], host.alias("host"), path.alias("path"))
    known = base.select("host", F.coalesce(F.col(f"`{labelled}`"), F.lit(0)).cast("bigint").alias("labelled"), F.coalesce(F.col(f"`{bad}`"), F.lit(0)).cast("bigint").alias("bad"))
    hosts = reputations(known, odds, deviations).select(F.col("host").alias("__host"), F.col("verdict").alias("__verdict"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    joined = base.join(hosts, F.col("host") == F.col("__host"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in names], "host", "path", rule.alias("rule"), F.coalesce(verdict, "__verdict").alias("verdict"))
