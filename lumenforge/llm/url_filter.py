"""Host reputation by empirical Bayes: beta-binomial shrinkage from suffix to registered domain to host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenforge.plans.lineage import materialize
from lumenforge.plans.skew import join_groups

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which registries sell names, when the last label has two letters.
REGISTRY_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where no ``://`` stands."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host; ports and user names don't count, an IPv4 address is its own domain."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    suffix = F.regexp_extract(bare, rf"(?:^|\.)((?:(?:{'|'.join(REGISTRY_LABELS)})\.[a-z]{{2}})|[^.]*)$", 1)
    domain = F.regexp_extract(bare, rf"([^.]*\.?(?:(?:(?<=\.)(?:{'|'.join(REGISTRY_LABELS)})\.[a-z]{{2}})|[^.]*))$", 1)
    return suffix, F.when(bare.rlike(r"^[0-9]+(\.[0-9]+){3}$"), bare).otherwise(domain)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = None, None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return rule, verdict


def host_reputation(labelled: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, n, k, mean, lower``-ready posterior for every row of ``hosts`` (``host, domain, suffix``, distinct).

    ``labelled`` has ``host, domain, suffix, bad`` with one row per judged page. At each level the
    between-group variance (one-way ANOVA of the outcomes) gives the concentration s of the beta
    prior; a group's prior mean is its parent's posterior mean, so a host without pages of its own
    has its domain's, and a new domain its suffix's. The counts of each level are sums of the level
    below, so pages are shuffled once and combined map-side.

    The share of variance between groups is held within 0.02 to 0.98, so that no level's prior is worth less than 1/49
    or more than 49 pages; a level with one group, or none with two pages, has nothing to estimate it
    from and takes 0.1, a prior worth 9 pages.
    """
    by_host = labelled.groupBy("suffix", "domain", "host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
    by_domain = by_host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = by_suffix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n0"), F.coalesce(F.sum("k"), F.lit(0)).alias("k0"))

    def concentration(groups: DataFrame, name: str) -> DataFrame:
        """One row: s at this level, from sums over its groups."""
        p = F.col("k") / F.col("n")
        sums = groups.agg(F.count(F.lit(1)).alias("g"), F.sum("n").cast("double").alias("t"), F.sum("k").cast("double").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("t2"), F.sum(F.col("k") * p).alias("kp"))
        between = F.col("kp") - F.col("k") * F.col("k") / F.col("t")  # sum n (p - m)^2
        within = F.col("k") - F.col("kp")  # sum n p (1 - p)
        msb, msw = between / (F.col("g") - 1), within / (F.col("t") - F.col("g"))
        n0 = (F.col("t") - F.col("t2") / F.col("t")) / (F.col("g") - 1)
        rho = F.when((F.col("g") > 1) & (F.col("t") > F.col("g")) & (msb + (n0 - 1) * msw > 0), (msb - msw) / (msb + (n0 - 1) * msw)).otherwise(F.lit(0.1))
        rho = F.least(F.greatest(rho, F.lit(0.02)), F.lit(0.98))
        return sums.select((1 / rho - 1).alias(name))

    # four single-row tables: their broadcast is one row each
    whole = whole.select(((F.col("k0") + 1.0) / (F.col("n0") + 2.0)).alias("m0"))
    for groups, name in ((by_suffix, "s_suffix"), (by_domain, "s_domain"), (by_host, "s_host")):
        whole = whole.join(F.broadcast(concentration(groups, name)))

    def counts(groups: DataFrame, level: str) -> DataFrame:
        return groups.select(*LEVELS[: LEVELS.index(level) + 1], F.col("n").alias(f"n_{level}"), F.col("k").alias(f"k_{level}"))

    out = hosts.join(counts(by_suffix, "suffix"), ["suffix"], "left").join(counts(by_domain, "domain"), ["suffix", "domain"], "left").join(counts(by_host, "host"), ["suffix", "domain", "host"], "left")
    out = out.na.fill(0, [f"{c}_{level}" for c in "nk" for level in LEVELS]).join(F.broadcast(whole))
    mean = F.col("m0")
    for level in LEVELS:
        s = F.col(f"s_{level}")
        a, total = F.col(f"k_{level}") + s * mean, F.col(f"n_{level}") + s
        mean = a / total
    return out.select("host", F.col("n_host").alias("n"), F.col("k_host").alias("k"), mean.alias("mean"), total.alias("strength"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, z: float = 1.64, limit: float = 0.5) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, n_labelled, n_bad``.

    ``labels`` has ``id, bad`` (0 or 1) for some pages. A page is blocked if the lower bound
    ``mean - z * sd`` of its host's posterior rate of bad pages lies above ``limit`` (a normal approximation
    of the beta posterior's quantile, as no SQL function gives that); a rule that fits
    the url decides before that. Pages meet their host's verdict by shuffle, hosts of very many pages by broadcast. Null urls and urls without ``://`` have empty host and path, and
    the verdict of the empty host. Repeated pages are judged alike. Without labels nothing is
    blocked but by rule. Only the two named columns of ``pages`` are read.
    """
    host, path = url_parts(F.col(url_col))
    urls = materialize(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "urls")
    suffix, domain = domain_parts(F.col("host"))
    marks = labels.select(F.col("id").alias("_id"), "bad").filter("_id is not null and bad is not null").groupBy("_id").agg(F.max("bad").cast("long").alias("bad"))
    labelled = urls.select("id", "host").join(marks, F.col("id") == F.col("_id")).withColumns({"suffix": suffix, "domain": domain})
    hosts = materialize(urls.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumns({"suffix": suffix, "domain": domain}), "hosts")
    known = host_reputation(labelled, hosts.drop("pages"))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    known = known.withColumn("_bad", F.col("mean") - z * sd > limit).select("host", "n", "k", "_bad").join(hosts.select("host", "pages"), "host")
    known = materialize(known, "known-hosts")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    out = join_groups(urls, known, ["host"], "pages", urls.count()).withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("_bad"), F.lit("block")).otherwise(F.lit("allow"))))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"))
