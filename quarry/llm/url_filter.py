"""URL filter by rules and, beyond them, by empirical-Bayes host reputation.

Pages that a rule decides are the labelled outcomes (1 blocked, 0 allowed); an own outcome column
may be given instead. Outcomes are counted per host and shrunk through beta-binomial priors: a
host's prior mean is the posterior mean of its registered domain, whose prior mean is that of its
suffix, whose prior mean is the corpus's. The strength of the prior at each level comes from the
spread of the children around their parents (method of moments). A host is blocked when the lower
bound of its posterior, ``mean - Z * sd``, is above ``BLOCK_ABOVE``.

Everything is SQL expressions and aggregates; a host with a third of all pages costs one row per
task in its aggregate, and the join of the verdicts to the pages is free to split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, quoted, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z = 1.645
BLOCK_ABOVE = 0.5
STRENGTH = (1.0, 1000.0)
# Second-level labels under which names are registered.
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "edu", "ac"]

COLUMNS = ["host", "path", "rule", "verdict", "n_outcomes", "bad_mean", "bad_bound"]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """Registered domain: the last two labels, three below a second-level label of a country."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    deep = (n >= 3) & (F.length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(SECOND_LEVEL)
    return F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, null if none. A rule ``(host,
    path, verdict)`` fits its host and all subdomains where the path starts with its own; of
    equally long ones the one with the longer host wins. ``rules`` is a list in memory: its hosts
    are looked up by each suffix of the url's host, so the cost does not grow with the list."""
    kind = "struct<size:int,host_size:int,rule:string,verdict:string>"
    if not rules:
        return F.lit(None).cast(kind)
    by_host: dict[str, list] = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((p, h + p, v))
    entries = []
    for h, own in by_host.items():
        entries += [F.lit(h), F.array(*[F.struct(F.lit(len(r)).alias("size"), F.lit(len(h)).alias("host_size"), F.lit(r).alias("rule"),
                                                 F.lit(v).alias("verdict"), F.lit(p).alias("path")) for p, r, v in own])]
    table = F.create_map(*entries)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = F.flatten(F.filter(F.transform(suffixes, lambda s: F.element_at(table, s)), lambda a: a.isNotNull()))
    fits = F.filter(near, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"),
                                                            r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _strength(children: DataFrame) -> float:
    """Prior strength from ``(n, k, mu)`` per child: how far the children's shares spread around
    their parents' means ``mu`` beyond what chance does."""
    v = "greatest(mu * (1 - mu), 1e-6)"
    r = children.filter("n > 0").agg(F.expr(f"sum(n * power(k / n - mu, 2) / {v})").alias("spread"),
                                     F.count(F.lit(1)).alias("groups"), F.expr("sum(n - 1)").alias("freedom")).first()
    if not r["groups"] or not r["freedom"]:
        return STRENGTH[0]
    rho = (r["spread"] - r["groups"]) / r["freedom"]
    return STRENGTH[1] if rho <= 0 else min(max((1 - rho) / rho, STRENGTH[0]), STRENGTH[1])


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``(host, n, bad_mean, bad_bound)`` from outcome counts ``(host, n, k)``, one row per host."""
    h = materialise(hosts.select("host", domain_of(F.col("host")).alias("domain"), "n", "k")
                    .withColumn("suffix", F.when(F.instr("domain", ".") > 0, F.expr("substring(domain, instr(domain, '.') + 1)"))
                                .otherwise(F.col("domain"))), "urls-hosts")
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffixes = h.groupBy("suffix").agg(*counts)
    total = h.agg(*counts).first()
    top = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1)  # of no outcomes, half

    def posterior(level: DataFrame, name: str) -> DataFrame:
        s = _strength(level)
        return level.withColumn("a", F.col("k") + F.lit(s) * F.col("mu")).withColumn("b", F.col("n") - F.col("k") + F.lit(s) * (1 - F.col("mu"))).withColumn(
            name, F.col("a") / (F.col("a") + F.col("b")))

    s = materialise(posterior(suffixes.withColumn("mu", F.lit(top)), "suffix_mean"), "urls-suffixes")
    domains = h.groupBy("suffix", "domain").agg(*counts).join(s.select("suffix", F.col("suffix_mean").alias("mu")), "suffix")
    d = materialise(posterior(domains, "domain_mean"), "urls-domains")
    own = posterior(h.join(d.select("domain", F.col("domain_mean").alias("mu")), "domain"), "bad_mean")
    sd = F.expr("sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))")
    return own.select("host", "n", "bad_mean", (F.col("bad_mean") - F.lit(Z) * sd).alias("bad_bound"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url",
               outcome_col: str | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block: the rule's, else
    the host's), and the host's ``n_outcomes``, ``bad_mean`` and ``bad_bound``.

    A null url and one without ``://`` has an empty host and path, which is a host like any other;
    without any outcome nothing but rules blocks; repeated rows are each judged; an empty table
    gives an empty table. Columns of ``pages`` with these names are replaced (but ``url_col`` and
    ``outcome_col`` must not be among them), all others are kept.
    """
    base = without(pages, COLUMNS)
    found = base.withColumn("__host", host_of(quoted(url_col))).withColumn("__path", path_of(quoted(url_col)))
    found = found.withColumn("__rule", matched_rule(F.col("__host"), F.col("__path"), rules))
    bad = quoted(outcome_col).cast("int") if outcome_col else F.when(F.col("__rule.verdict") == "block", 1).when(
        F.col("__rule").isNotNull(), 0)
    hosts = found.select(F.col("__host").alias("host"), bad.alias("bad")).groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    known = materialise(host_reputation(hosts), "urls-reputation").select(
        F.col("host").alias("__of"), F.col("n").alias("n_outcomes"), F.round("bad_mean", 6).alias("bad_mean"),
        F.round("bad_bound", 6).alias("bad_bound"))
    out = found.join(known, F.col("__host") == F.col("__of"))
    own = F.when(F.col("bad_bound") > BLOCK_ABOVE, "block").otherwise("allow")
    return out.select(*[quoted(c) for c in base.columns], F.col("__host").alias("host"), F.col("__path").alias("path"),
                      F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"),
                      "n_outcomes", "bad_mean", "bad_bound")
