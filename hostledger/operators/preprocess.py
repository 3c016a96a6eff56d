"""Normalise, dedupe and cap look-alike URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.patterns import pattern_text
from ..functions.urlparts import UrlParts, drop_parts, stage, stage_parts
from ..functions.urls import normalized_parts

PARTS = "_u_"


def with_normalized(
    df: DataFrame,
    url: str = "url",
    mode: str = "preprocess",
    normalize: dict | None = None,
    pattern: dict | None = None,
) -> DataFrame:
    """Add ``norm`` and ``pattern``; both are null for an unparseable URL.

    The URL is split once into columns. Its pattern is read off the same parts, since normalising
    changes only query and fragment.
    """
    clean = normalized_parts(UrlParts.staged(PARTS), **(normalize or {}))
    staged = stage_parts(df, url, PARTS)
    staged = stage(staged, {PARTS + "query": clean.query, PARTS + "fragment": clean.fragment})
    parts = UrlParts.staged(PARTS)
    shaped = {"norm": F.when(parts.valid, parts.text()), "pattern": pattern_text(parts, mode, **(pattern or {}))}
    return drop_parts(stage(staged, shaped), PARTS)


def dedupe_urls(df: DataFrame, url: str = "norm", pos: str = "pos") -> DataFrame:
    """One row per URL with its first position; combines before the shuffle."""
    return df.groupBy(url).agg(F.min(pos).alias(pos))


def cap_per_pattern(
    df: DataFrame, pattern: str = "pattern", order: str | list = "pos", max_similar: int = 1, url: str = "norm"
) -> DataFrame:
    """The first ``max_similar`` rows of each pattern; rows without a pattern all stay."""
    order = [order] if isinstance(order, str) else order
    key = F.coalesce(F.col(pattern), F.concat(F.lit("\0"), F.col(url)))
    return first_rows(df.withColumn("_pattern_key", key), ["_pattern_key"], order, max_similar).drop("_pattern_key")


def first_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key.

    A rank filter of this form is cut down to ``n`` rows per key and task before the shuffle, so a key
    that owns most rows sends only a few. Spark does so up to a limit, which is lifted to ``n``.
    """
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.windowGroupLimitThreshold"
    conf.set(name, str(max(n, int(conf.get(name)))))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def preprocess_urls(
    df: DataFrame,
    url: str = "url",
    pos: str = "pos",
    max_similar: int = 1,
    enabled: bool = True,
    mode: str = "preprocess",
    normalize: dict | None = None,
    pattern: dict | None = None,
) -> DataFrame:
    """The URLs worth scanning as (pos, norm, pattern), in the order semantics of ``pos``.

    With ``max_similar=1`` the first row of a pattern is the first row of its URL too, so the cap
    dedupes by itself and one shuffle is saved.
    """
    rows = (
        with_normalized(df.select(pos, url), url, mode, normalize, pattern)
        .where(F.col("norm").isNotNull())
        .select(pos, "norm", "pattern")
    )
    if not enabled or max_similar != 1:
        rows = rows.groupBy("norm", "pattern").agg(F.min(pos).alias(pos)).select(pos, "norm", "pattern")
    return cap_per_pattern(rows, order=pos, max_similar=max_similar) if enabled else rows


def preprocess_stats(
    df: DataFrame,
    url: str = "url",
    pos: str = "pos",
    max_similar: int = 1,
    enabled: bool = True,
    mode: str = "preprocess",
    normalize: dict | None = None,
    pattern: dict | None = None,
) -> DataFrame:
    """One row of counters. Repeats of a kept URL are duplicates, all rows of a capped one by-pattern."""
    rows = with_normalized(df.select(pos, url), url, mode, normalize, pattern)
    zero = F.lit(0).cast("long")
    # both branches start from this frame, so URLs are split once
    groups = rows.groupBy("norm", "pattern").agg(
        F.min(pos).alias(pos), F.count("*").alias("n"), F.count_if(F.col("norm") != F.col(url)).alias("n_changed")
    )
    total = lambda c: F.coalesce(F.sum(c), zero)
    totals = groups.agg(
        total("n").alias("total_processed"),
        total("n_changed").alias("normalized"),
        total(F.when(F.col("norm").isNotNull(), F.col("n"))).alias("parsed"),
    ).select("*", zero.alias("final_count"), zero.alias("kept_rows"))
    usable = groups.where(F.col("norm").isNotNull())
    kept = cap_per_pattern(usable, order=pos, max_similar=max_similar) if enabled else usable
    kept = kept.agg(
        F.count("*").alias("final_count"), total("n").alias("kept_rows")
    ).select(zero.alias("total_processed"), zero.alias("normalized"), zero.alias("parsed"), "*")
    return (
        totals.unionByName(kept)
        .agg(*[F.sum(c).alias(c) for c in totals.columns])
        .select(
            "total_processed",
            "normalized",
            (F.col("parsed") - F.col("kept_rows")).alias("skipped_by_pattern"),
            (F.col("kept_rows") - F.col("final_count")).alias("skipped_duplicate"),
            "final_count",
        )
    )


def pattern_stats(kept: DataFrame, min_count: int = 1) -> DataFrame:
    """Accepted URLs per pattern."""
    return (
        kept.where(F.col("pattern").isNotNull())
        .groupBy("pattern")
        .agg(F.count("*").alias("n_urls"))
        .where(F.col("n_urls") >= min_count)
    )
