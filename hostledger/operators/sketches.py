"""Counters and sketches per session, stored once and combined for any range of sessions.

Distinct counts are HyperLogLog sketches, frequent errors are frequent-item sketches; both combine
without the rows they were made from, so a dashboard over years reads a small table.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import error_digest
from ..functions.urls import effective_url, extract_host

LG_K = 14  # 2^14 registers: a standard error of 0.8 %, nearly exact up to some 1,500 values
TRACKED = 10_000  # error digests a sketch keeps


def session_sketches(probes: DataFrame, session: str = "scan_session_id") -> DataFrame:
    """Counters of every session and effective host: session, host, n_rows, n_success, urls, technologies.

    ``urls`` and ``technologies`` are sketches. Success looks at the status alone, as in
    ``dashboard_stats``. Tasks combine before the shuffle, so a host that owns most rows is one row per task.
    """
    url = effective_url("final_url", "input_url")
    good = F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    items = probes.select(
        F.col(session).alias("session"), extract_host(url).alias("host"), good.alias("good"), url.alias("url"), F.posexplode_outer("technologies").alias("place", "technology")
    )
    own = F.coalesce(F.col("place"), F.lit(0)) == 0  # one item of each row
    return items.groupBy("session", "host").agg(
        F.count_if(own).alias("n_rows"),
        F.count_if(own & F.col("good")).alias("n_success"),
        F.hll_sketch_agg(F.when(own, F.col("url")), F.lit(LG_K)).alias("urls"),
        F.hll_sketch_agg("technology", F.lit(LG_K)).alias("technologies"),
    )


def stored(spark: SparkSession, base: str) -> DataFrame | None:
    """The sketches at ``base``; None if there are none yet."""
    try:
        return spark.read.parquet(base)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _write(made: DataFrame, base: str) -> None:
    made.repartition("session").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(base)


def write_sketches(probes: DataFrame, base: str, session: str = "scan_session_id", only_new: bool = True) -> None:
    """Store ``session_sketches`` of the sessions in ``probes``, a folder per session.

    Sessions that are stored already are left out before any probe row is read, or replaced without ``only_new``.
    """
    known = stored(probes.sparkSession, base) if only_new else None
    if known is not None:
        sessions = known.select(F.col("session").cast(probes.schema[session].dataType).alias(session)).distinct()
        probes = probes.join(sessions, session, "left_anti")
    _write(session_sketches(probes, session), base)


def within(table: DataFrame, first=None, last=None) -> DataFrame:
    """The rows of the sessions from ``first`` to ``last``, both included; folders outside are not read."""
    at = F.col("session").cast("string")
    if first is not None:
        table = table.where(at >= first)
    return table if last is None else table.where(at <= last)


def distinct_estimate(sketches: Column | str) -> Column:
    """How many distinct values a column of sketches holds together; none for no rows."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketches)), F.lit(0).cast("long"))


def dashboard_sketch(table: DataFrame, *keys: str) -> DataFrame:
    """Counters and estimated distinct counts of stored sketches, per ``keys`` (session, host) or of all.

    total, success_count, error_count, unique_hosts, unique_urls, unique_technologies. Hosts are
    sketched from the table's own rows, of which there is one per session and host.
    """
    zero = F.lit(0).cast("long")
    return table.groupBy(*keys).agg(
        F.coalesce(F.sum("n_rows"), zero).alias("total"),
        F.coalesce(F.sum("n_success"), zero).alias("success_count"),
        F.coalesce(F.sum(F.col("n_rows") - F.col("n_success")), zero).alias("error_count"),
        F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg("host", F.lit(LG_K))), zero).alias("unique_hosts"),
        distinct_estimate("urls").alias("unique_urls"),
        distinct_estimate("technologies").alias("unique_technologies"),
    )


def error_sketches(errors: DataFrame, session: str, message: str = "error", tracked: int = TRACKED) -> DataFrame:
    """session, n_errors and a frequent-item sketch of the error digests of every session.

    Each task folds its digests into a sketch of at most ``tracked`` items; only sketches are shuffled.
    """
    digests = errors.where(F.col(message) != "").select(F.col(session).alias("session"), error_digest(message).alias("digest"))
    return digests.groupBy("session").agg(
        F.count("*").alias("n_errors"), F.expr(f"approx_top_k_accumulate(digest, {int(tracked)})").alias("digests")
    )


def write_error_sketches(errors: DataFrame, base: str, session: str, message: str = "error", tracked: int = TRACKED) -> None:
    """Store ``error_sketches``, a folder per session; those of the sessions in ``errors`` are replaced."""
    _write(error_sketches(errors, session, message, tracked), base)


def error_bound(n_errors: Column, tracked: int = TRACKED) -> Column:
    """By how much a count can be off, at most; 0 is off as long as no sketch had to let an item go."""
    slots = 1 << math.ceil(math.log2(tracked / 0.75))
    return F.ceil(n_errors * 3.5 / slots)


def top_errors_between(table: DataFrame, k: int = 10, tracked: int = TRACKED) -> DataFrame:
    """The most frequent digests of stored error sketches: rank, digest, n_errors, bound.

    Sketches are combined, so the range of sessions is free (``within``). Counts are exact while the
    range has fewer than three quarters of the sketch's slots of distinct digests, else within ``bound``. Ties go by digest.
    """
    # grouped by a constant, so that an empty table has no group
    combined = table.groupBy(F.lit(1).alias("one")).agg(F.sum("n_errors").alias("n"), F.expr(f"approx_top_k_combine(digests, {int(tracked)})").alias("all"))
    items = combined.select("n", F.explode(F.expr(f"approx_top_k_estimate(all, {int(tracked)})")).alias("item"))
    best = [F.col("item.count").desc(), F.col("item.item")]
    top = items.orderBy(*best).limit(k)  # of ``tracked`` rows at most
    # the window below runs over k rows
    return top.select(
        F.row_number().over(Window.orderBy(*best)).alias("rank"), F.col("item.item").alias("digest"), F.col("item.count").alias("n_errors"), error_bound(F.col("n"), tracked).alias("bound")
    )
