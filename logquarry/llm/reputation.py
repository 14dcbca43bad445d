"""URL filters from host reputation, shrunk through empirical-Bayes beta-binomial priors.

Labelled pages are counted by host.  The share of bad pages of a host is drawn towards that of its
registered domain, the domain's towards its suffix, the suffix's towards all pages.  How strongly is
learned from the counts themselves: at each level the spread of the children around their parents,
beyond what counting alone would give, is the correlation ``rho`` of a beta-binomial, and the prior
weighs as much as ``(1 - rho) / rho`` labelled pages.  A host is blocked when the lower bound of its
posterior share of bad pages exceeds ``limit``: a few bad pages block nothing, and many do.

Fixed rules come before the method.  Only DataFrame functions are used.  Pages meet a table of hosts
in one equi join, of which adaptive execution splits a hot host; all counts are combined first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquarry.llm.common import materialize, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels; every other suffix is the last label.
WIDE_SUFFIXES = (
    "ac.uk co.uk gov.uk org.uk com.au net.au org.au co.jp ne.jp or.jp co.kr or.kr co.nz co.in co.za "
    "com.ar com.br com.cn com.hk com.mx com.sg com.tr com.tw com.ua"
).split()
# Share of bad pages that a host may have, and the deviations between its mean and its bound.
LIMIT = 0.5
DEVIATIONS = 1.645
# Correlation of the pages of one group: bounds of the estimate.
LEAST_RHO, MOST_RHO = 1e-4, 0.9
LEVELS = ("suffix", "domain", "host")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and its subdomains, where the path begins with ``path``."""

    host: str
    path: str
    verdict: str


def host_of(url: str | Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: str | Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    text = text_or_empty(url)
    at = F.locate("://", text)
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def suffix_of(host: str | Column) -> Column:
    """The public suffix of a host; a host of digits alone is its own."""
    host = F.col(host) if isinstance(host, str) else host
    wide = F.substring_index(host, ".", -2)
    named = F.when(wide.isin(WIDE_SUFFIXES), wide).otherwise(F.substring_index(host, ".", -1))
    return F.when(host.rlike("^[0-9.:]*$"), host).otherwise(named)


def domain_of(host: str | Column) -> Column:
    """The registered domain: the suffix and one label more."""
    host = F.col(host) if isinstance(host, str) else host
    wide = F.substring_index(host, ".", -2).isin(WIDE_SUFFIXES)
    named = F.when(wide, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(host.rlike("^[0-9.:]*$"), host).otherwise(named)


def outcomes_of(labels: DataFrame) -> DataFrame:
    """``(id, bad)`` of labelled rows: low quality or toxic; of several rows of an id a bad one counts."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("doc_id IS NOT NULL AND coalesce(quality, toxic) IS NOT NULL")
    return known.groupBy(F.col("doc_id").alias("id")).agg(F.max(bad.cast("int")).alias("bad"))


def _weight(groups: DataFrame) -> float:
    """Labelled pages that the prior weighs, from groups of ``(n, bad, mean)``, their parents' mean."""
    noise = F.col("mean") * (1 - F.col("mean"))
    seen = groups.where("n > 0").agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mean"), 2) / F.col("n")).alias("found"),
        F.sum(noise).alias("expected"),
        F.sum(noise * (F.col("n") - 1)).alias("pairs"),
    )
    row = seen.first()
    if not row.pairs:
        return 1.0
    rho = min(MOST_RHO, max(LEAST_RHO, (row.found - row.expected) / row.pairs))
    return (1 - rho) / rho


def host_reputation(hosts: DataFrame) -> DataFrame:
    """``(host, n, bad, mean, bound)`` from the counts ``(host, n, bad)`` of every host.

    ``mean`` is the posterior share of bad pages and ``bound`` its lower bound, by the deviation of the
    posterior beta distribution.  A host without labelled pages has its domain's mean.
    """
    counts = materialize(hosts.select("host", domain_of("host").alias("domain"), suffix_of("host").alias("suffix"), "n", "bad"), "host_counts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    keys: list[str] = []
    means, mean = counts, ((total.bad or 0) + 0.5) / ((total.n or 0) + 1)
    for level in LEVELS:
        groups = counts.groupBy(*keys, level).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        groups = groups.join(means, keys) if keys else groups.withColumn("mean", F.lit(mean))
        weight = _weight(groups)
        keys.append(level)
        shrunk = ((F.col("bad") + weight * F.col("mean")) / (F.col("n") + weight)).alias("mean")
        scored = materialize(groups.select(*keys, "n", "bad", shrunk, (F.col("n") + weight).alias("size")), f"{level}_reputation")
        means = scored.select(*keys, "mean")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    return scored.select("host", "n", "bad", "mean", (F.col("mean") - DEVIATIONS * spread).alias("bound"))


def _rules_of_hosts(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(host, rules)``: the rules that fit a host, whatever the path."""
    spark = hosts.sparkSession
    if not rules:
        return hosts.select("host", F.array().cast("array<struct<hosts:int,paths:int,path:string,rule:string,verdict:string>>").alias("rules"))
    rows = [
        F.struct(F.lit(r.host).alias("at"), F.lit(len(r.host)).alias("hosts"), F.lit(len(r.path)).alias("paths"),
                 F.lit(r.path).alias("path"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        for r in rules
    ]
    known = spark.range(1).select(F.inline(F.array(*rows)))
    depths = sorted({r.host.count(".") + 1 for r in rules})
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in depths]))
    fits = hosts.select("host", F.explode(ends).alias("at")).join(known, "at")
    return fits.groupBy("host").agg(F.collect_set(F.struct("hosts", "paths", "path", "rule", "verdict")).alias("rules"))


def judged_pages(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    limit: float = LIMIT,
) -> DataFrame:
    """``(<id_col>, host, path, rule, verdict, bad_bound)``, one row per row of ``pages``.

    ``outcomes`` holds ``(id, bad)``, one row for each labelled page.  Of the rules that fit, that with
    the longest host and then the longest path gives the verdict; elsewhere the verdict is ``block``
    where ``bad_bound``, the lower bound of the host's share of bad pages, exceeds ``limit``, else
    ``allow``.  A null url, or one without ``://``, has an empty host, which is a host like any other;
    so is one of any length.  Rows with a null id are judged and never labelled; repeated rows are
    judged each, and count each.  Without outcomes no host is blocked.  An empty table gives no rows.
    Other columns are not read.
    """
    named = pages.select(F.col(id_col).alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    known = named.select("id", "host").join(outcomes.select("id", F.col("bad").cast("long").alias("bad")), "id", "left")
    hosts = known.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    scored = host_reputation(hosts).select("host", F.col("bound").alias("bad_bound"))
    table = scored.join(_rules_of_hosts(scored.select("host"), rules), "host", "left")
    # Written, so that both sides of the join are plain shuffles, of which Spark can split hot hosts.
    met = named.join(materialize(table, "host_verdicts"), "host")
    fitting = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    met = met.withColumn("best", F.array_max(fitting))
    own = F.when(F.col("bad_bound") > limit, "block").otherwise("allow")
    verdict = F.coalesce(F.col("best.verdict"), own).alias("verdict")
    return met.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict, "bad_bound")
