"""Seed lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.urls import extract_host, normalize_target
from .numbering import LOCAL_BITS


def read_target_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files as (pos, raw_url); ``pos`` grows along the files without sorting them.

    A position is the rank of the file split and the place within it. Only the list of splits is
    ranked.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("raw_url"),
    )
    splits = (
        lines.select("_file", "_start")
        .distinct()
        .withColumn("_rank", F.row_number().over(Window.orderBy("_file", "_start")).cast("long"))
    )
    local = F.col("_at").bitwiseAND((1 << LOCAL_BITS) - 1)
    return lines.join(splits, ["_file", "_start"]).select(
        (F.shiftleft("_rank", LOCAL_BITS) + local).alias("pos"), "raw_url"
    )


def parse_targets(lines: DataFrame, raw: str = "raw_url", pos: str = "pos") -> DataFrame:
    """Usable seeds as (pos, url); empty and broken lines are left out, repeats stay."""
    return lines.select(pos, normalize_target(raw).alias("url")).where(F.col("url").isNotNull())


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    return parse_targets(read_target_lines(spark, path))


def target_report(lines: DataFrame, raw: str = "raw_url") -> DataFrame:
    """How many lines there are, and how many are usable or skipped."""
    return lines.select(normalize_target(raw).alias("url")).agg(
        F.count("*").alias("total"),
        F.count("url").alias("ok"),
        F.count_if(F.col("url").isNull()).alias("skipped"),
    )


def seed_hosts(seeds: DataFrame, url: str = "url", pos: str = "pos") -> DataFrame:
    """The distinct hosts of the seeds and the first place each is seen at."""
    return (
        seeds.select(pos, extract_host(url).alias("host"))
        .where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.min(pos).alias("first_pos"))
    )
