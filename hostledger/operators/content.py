"""Content versions of pages and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from .preprocess import first_rows
from .probes import latest_per_key


def content_history(
    fetches: DataFrame, url: str = "url", ts: str = "ts", content: str = "content", content_type: str | None = None
) -> DataFrame:
    """One row per fetch: (url, ts, hash, content_type, content)."""
    kind = F.col(content_type) if content_type else F.lit(None).cast("string")
    return fetches.select(
        F.col(url).alias("url"),
        F.col(ts).alias("ts"),
        F.sha2(F.col(content), 256).alias("hash"),
        kind.alias("content_type"),
        F.col(content).alias("content"),
    )


def last_known_record(history: DataFrame) -> DataFrame:
    return latest_per_key(history, ["url"], ["ts"])


def records_for_url(history: DataFrame, limit: int, url: str | None = None) -> DataFrame:
    """The newest ``limit`` records of each URL, or of one."""
    rows = history if url is None else history.where(F.col("url") == url)
    return first_rows(rows, ["url"], [F.col("ts").desc()], limit)


def content_changes(history: DataFrame, old_ts, new_ts) -> DataFrame:
    """new / deleted / changed / identical per URL between two fetches, as (url, change, old_hash, new_hash).

    Only URLs and hashes are read; equal keys of both sides combine before the shuffle.
    """
    at = lambda t: F.max(F.when(F.col("ts") == t, F.col("hash")))
    sides = (
        history.where(F.col("ts").isin(old_ts, new_ts))
        .groupBy("url")
        .agg(at(old_ts).alias("old_hash"), at(new_ts).alias("new_hash"))
    )
    change = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") == F.col("new_hash"), "identical")
        .otherwise("changed")
    )
    return sides.select("url", change.alias("change"), "old_hash", "new_hash")


def version_changes(history: DataFrame, bucket: Column | None = None) -> DataFrame:
    """new / changed / identical of each version against the one before it, as (url, ts, change).

    ``bucket`` is a coarse, growing expression of ``ts``: the day of a timestamp, or thousands of a
    number, unless given. Versions are compared within a bucket; its first one is compared with the
    last of the bucket before, which comes from one row per URL and bucket. So a URL fetched all the
    time spreads over its buckets.
    """
    if bucket is None:
        numeric = isinstance(history.schema["ts"].dataType, T.NumericType)
        bucket = F.floor(F.col("ts") / 1000) if numeric else F.to_date("ts")
    rows = history.select("url", "ts", "hash", bucket.alias("_bucket"))
    lasts = rows.groupBy("url", "_bucket").agg(F.max_by("hash", "ts").alias("_last"))
    carried = lasts.select(
        "url", "_bucket", F.lag("_last").over(Window.partitionBy("url").orderBy("_bucket")).alias("_carried")
    )
    inside = Window.partitionBy("url", "_bucket").orderBy("ts")
    ranked = rows.withColumns({"_inner": F.lag("hash").over(inside), "_place": F.row_number().over(inside)})
    before = F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_inner"))
    compared = ranked.join(carried, ["url", "_bucket"]).withColumn("_before", before)
    change = (
        F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col("hash"), "identical").otherwise("changed")
    )
    return compared.select("url", "ts", change.alias("change"))


def normal_lines(content: Column, strip_comments: bool = True) -> Column:
    """The lines of a text, blanks collapsed and comments dropped, without empty ones."""
    if strip_comments:
        content = F.regexp_replace(content, r"(?s)<!--.*?-->|/\*.*?\*/", "")
    tidy = lambda s: F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" "))
    code = (lambda s: F.regexp_replace(s, r"(^|\s)//.*", "")) if strip_comments else (lambda s: s)
    lines = F.transform(F.split(content, r"\r?\n", -1), lambda s: tidy(code(s)))
    return F.filter(lines, lambda s: s != "")


def line_diff_counts(history: DataFrame, old_ts, new_ts, strip_comments: bool = True) -> DataFrame:
    """Lines added and deleted per URL that both fetches have, as a multiset difference.

    Hashes are compared first. Only texts of URLs whose hash changed are split, each by itself, and
    the lines are counted per (url, line) with a sign, so one huge page spreads over all tasks.
    """
    both = content_changes(history, old_ts, new_ts).where(F.col("change").isin("changed", "identical"))
    changed = both.where("change = 'changed'").select("url")
    sign = F.when(F.col("ts") == new_ts, 1).otherwise(-1)
    texts = history.where(F.col("ts").isin(old_ts, new_ts)).select("url", "content", sign.alias("sign"))
    lines = texts.join(changed, "url", "left_semi").select(
        "url", "sign", F.explode(normal_lines(F.col("content"), strip_comments)).alias("line")
    )
    # every URL has one row without a line, so one without lines is there too
    markers = both.select("url", F.lit(0).alias("sign"), F.lit(None).cast("string").alias("line"))
    net = lines.unionByName(markers).groupBy("url", "line").agg(F.sum("sign").alias("net"))
    added = F.sum(F.greatest(F.col("net"), F.lit(0)))
    deleted = F.sum(F.greatest(-F.col("net"), F.lit(0)))
    return net.groupBy("url").agg(
        added.alias("lines_added"),
        deleted.alias("lines_deleted"),
        ((added == 0) & (deleted == 0)).alias("is_identical"),
    )
