"""URL filter: rules first, then the reputation of the host.

Reputation is empirical Bayes. Outcomes of labelled pages (bad or not) are counted per host, registered domain and
public suffix. Each level's rate is drawn towards its parent's (all pages, suffix, domain, host) by a beta-binomial
prior whose strength is estimated from how far that level's groups scatter around their parents. A host is blocked if
the lower bound of its rate's posterior is above `worst`: seldom seen hosts of good domains pass, and so does bad luck.
"""

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import durable, join_groups

#: Second-level names that are public suffixes below a country's two letters.
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: A host is blocked if its rate of bad pages is above this with the certainty of Z standard deviations of its posterior.
WORST, Z = 0.5, 1.645
#: Bounds of the correlation inside a group, 1 / (prior's strength + 1).
LEAST_RHO, MOST_RHO = 0.001, 0.999


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as written in the URL, host in lower case (A-Z); both empty without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(F.regexp_replace(url, "(?s)^.*?://", ""), "(?s)[?#].*$", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of `rules` ("host/path", verdict) that fits the host or a parent of it; nulls if none.

    Of equally long ones the one with the longer host, then the first in order of text.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"), [-ord(c) for c in r[0]])):
        name, at = text[: text.index("/")].lower(), text[text.index("/") :]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(at)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host; port and user are no part of them. An IP address is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "[.]?(:[0-9]*)?$", "")
    parts = F.split(bare, "[.]")
    n = F.size(parts)
    two = (n > 2) & (F.length(F.get(parts, n - 1)) == 2) & F.get(parts, n - 2).isin(SECOND)
    k = F.when(two, 2).otherwise(1)
    tail = lambda m: F.array_join(F.slice(parts, n - m + 1, m), ".")
    ip = bare.rlike("^[0-9]+([.][0-9]+){3}$") | bare.startswith("[")
    return F.when(ip | (n <= k), bare).otherwise(tail(k + 1)), F.when(ip, bare).otherwise(tail(k))


def drawn(groups: DataFrame) -> DataFrame:
    """Groups (n, bad, mean: of their parent) with a, b: their rate's beta posterior; without outcomes it is the prior.

    The prior's strength comes from the moment estimate of the correlation inside the groups: two sums, one row.
    """
    spread = F.col("mean") * (1 - F.col("mean"))
    over = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2) - F.col("n") * spread)
    rho = groups.agg((over / F.nullif(F.sum(F.col("n") * (F.col("n") - 1) * spread), F.lit(0.0))).alias("rho")).first()[0]
    k = 1 / max(LEAST_RHO, min(MOST_RHO, LEAST_RHO if rho is None else rho)) - 1
    return groups.withColumn("a", k * F.col("mean") + F.col("bad")).withColumn("b", k * (1 - F.col("mean")) + F.col("n") - F.col("bad"))


def reputation(hosts: DataFrame) -> DataFrame:
    """Per host, from (host, pages, n, bad): pages, n, bad, rate (posterior mean) and bound (its lower end).

    One row per host goes in; domains and suffixes are sums over it, so nothing here is larger than the list of hosts.
    """
    domain, suffix = levels(F.col("host"))
    hosts = durable(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("hosts"))
    suffixes = domains.groupBy("suffix").agg(*sums)
    bad, n = hosts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rate, total = F.col("a") / (F.col("a") + F.col("b")), F.col("a") + F.col("b")
    suffixes = drawn(suffixes.withColumn("mean", F.lit((bad + 0.5) / (n + 1.0) if n else 0.0))).select("suffix", rate.alias("mean"))
    domains = drawn(domains.join(suffixes, "suffix")).select("domain", rate.alias("mean"), F.col("hosts").alias("n"))
    bound = rate - Z * F.sqrt(rate * (1 - rate) / (total + 1))
    below = join_groups(hosts.withColumnRenamed("n", "labelled"), domains, ["domain"], hosts.count())  # a domain may have most hosts
    return drawn(below.drop("n").withColumnRenamed("labelled", "n")).select("host", "pages", "n", "bad", rate.alias("rate"), bound.alias("bound"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules, worst=WORST, id_col="page_id", url_col="url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (allow or block), host_labelled, host_bad, host_bound_milli.

    `outcomes` has page_id and bad (boolean): labelled pages; an id with several outcomes is bad if any says so, null ids
    and outcomes are left out. A page without a rule is blocked if its host's bound is above `worst`. A null URL, or one without
    `://`, has the empty host, judged by its pages' outcomes like any other. Repeated ids are judged row by row, and
    each of their rows counts for its host; other columns are ignored. Without outcomes nothing is blocked but by rules.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    told = outcomes.filter(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("bad").alias("bad"))
    # rows of one id and host are counted before the join, so that no repeated id floods it
    met = rows.groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("pages")).join(told, "page_id", "left")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("pages"))), F.lit(0)).alias
    hosts = met.groupBy("host").agg(F.sum("pages").alias("pages"), count(F.col("bad").isNotNull())("n"), count(F.col("bad"))("bad"))
    known = reputation(hosts).select("host", F.col("pages").alias("_n"), F.col("n").alias("host_labelled"), F.col("bad").alias("host_bad"), "bound")
    total = pages.count()
    judged = join_groups(rows, known.withColumnRenamed("_n", "n"), ["host"], total).drop("n")
    rule, says = matched_rule(F.col("host"), F.col("path"), list(rules))
    by_method = F.when(F.col("bound") > worst, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, by_method).alias("verdict"),
        "host_labelled", "host_bad", F.floor(F.col("bound") * 1000).cast("long").alias("host_bound_milli"),
    )
