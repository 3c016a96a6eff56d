"""Host rules of any number as a table, joined by equality with the label suffixes of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import base_domain

KINDS = ("block", "allow", "subdomain", "seed")


def rule_table(rules: DataFrame, kind: str = "kind", value: str = "value") -> DataFrame:
    """(kind, value) in lower case, without repeats, blanks and kinds that are none."""
    tidy = rules.select(F.lower(F.trim(kind)).alias("kind"), F.lower(F.trim(value)).alias("value"))
    return tidy.where(F.col("kind").isin(*KINDS) & (F.col("value") != "")).distinct()


def label_suffixes(host: Column, most: Column) -> Column:
    """The suffixes of ``host`` that consist of whole labels, ``most`` labels at most, from long to short."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    first = F.greatest(F.lit(1), n - most + 1)
    return F.transform(F.sequence(first, n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def judge_hosts(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """Every distinct host in lower case with the rule that decides and whether it is allowed: (host, rule, allowed).

    ``rules`` (kind, value): block and allow hold for a host and its subdomains, of those that match the
    one with most labels decides, and block if both are given for the same host; subdomain blocks hosts whose part before the
    registrable domain is the value; with any seed, only hosts that equal a seed are allowed. A host
    no rule matches is allowed, unless there are seeds. ``rule`` is null where no block or allow rule matches.

    Suffixes meet rules by equality, so the plan is the same for one rule and for millions. A host
    gives as many rows as it has labels, or as many as the longest rule has. A suffix that very many
    hosts share, such as a blocked top-level domain, is split by the adaptive skew join, since rules
    are distinct.
    """
    rules = rule_table(rules)
    names = hosts.select(F.lower(F.col(host)).alias("host")).where("host <> ''").distinct()
    by_suffix = rules.where(F.col("kind").isin("block", "allow")).groupBy(F.col("value").alias("suffix")).agg(
        F.bool_or(F.col("kind") == "block").alias("blocks")
    )
    about = rules.agg(
        F.max(F.when(F.col("kind").isin("block", "allow"), F.size(F.split("value", r"\.", -1)))).alias("most"),
        F.coalesce(F.bool_or(F.col("kind") == "seed"), F.lit(False)).alias("seeded"),
    )
    known = names.join(F.broadcast(about))  # one row
    suffixes = known.where("most is not null").select("host", F.posexplode(label_suffixes(F.col("host"), F.col("most"))).alias("place", "suffix"))
    decided = suffixes.join(by_suffix, "suffix").groupBy("host").agg(
        F.min_by(F.struct("suffix", "blocks"), "place").alias("rule")  # the first that matches has most labels
    )
    domain = base_domain("host")
    part = F.when(F.col("host") != domain, F.substr("host", F.lit(1), F.length("host") - F.length(domain) - 1))
    of_kind = lambda kind, name: rules.where(F.col("kind") == kind).select(F.col("value").alias(name), F.lit(True).alias(f"is_{kind}"))
    judged = (
        known.withColumn("part", part)
        .join(decided, "host", "left")
        .join(of_kind("subdomain", "part"), "part", "left")
        .join(of_kind("seed", "host"), "host", "left")
    )
    blocked = F.coalesce(F.col("rule.blocks"), F.lit(False)) | F.coalesce("is_subdomain", F.lit(False))
    outside = F.col("seeded") & ~F.coalesce("is_seed", F.lit(False))
    return judged.select("host", F.col("rule.suffix").alias("rule"), (~blocked & ~outside).alias("allowed"))


def with_host_verdict(rows: DataFrame, rules: DataFrame, host: str, name: str = "allowed") -> DataFrame:
    """``rows`` with whether the rules allow their host; null where there is no host.

    ``rows`` is read twice, for its distinct hosts and for the rows themselves.
    """
    judged = judge_hosts(rows, rules, host).select(F.col("host").alias("_judged"), F.col("allowed").alias(name))
    return rows.drop(name).join(judged, F.lower(F.col(host)) == F.col("_judged"), "left").drop("_judged")
