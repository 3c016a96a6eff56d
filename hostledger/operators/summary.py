"""Run summaries, batches, history and error digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.probes import is_success
from ..functions.text import error_digest, is_cancellation, truncate
from .numbering import number_rows

COUNTERS = [
    "total_probed",
    "successful_probes",
    "failed_probes",
    "discoverable_items",
    "n_new",
    "n_old",
    "n_existing",
    "n_changed",
    "duration_s",
    "retries",
]


def probe_stats(probes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Probe counters, overall or per ``keys``."""
    total = F.count("*")
    good = F.count_if(is_success("error", "status_code"))
    return probes.groupBy(*keys).agg(
        total.alias("total_probed"),
        good.alias("successful_probes"),
        (total - good).alias("failed_probes"),
        total.alias("discoverable_items"),
    )


def run_status(workflow_error: Column, messages: Column) -> Column:
    """Final status of a run from its error and the messages collected on the way."""
    messages = F.coalesce(messages, F.array().cast("array<string>"))
    return (
        F.when(workflow_error.isNotNull() & F.exists(messages, is_cancellation), "INTERRUPTED")
        .when(workflow_error.isNotNull(), "FAILED")
        .when(F.size(messages) == 0, "COMPLETED")
        .otherwise("PARTIAL_COMPLETE")
    )


def report_path(paths: Column) -> Column:
    return (
        F.when(F.coalesce(F.size(paths), F.lit(0)) <= 0, F.lit(""))
        .when(F.size(paths) == 1, F.get(paths, F.lit(0)))
        .otherwise(F.lit("Multiple report files generated"))
    )


def scan_summary(
    probes: DataFrame, diff_by_session: DataFrame, runs: DataFrame, session: str = "scan_session_id"
) -> DataFrame:
    """One row per session of ``runs``: probe and diff counters, duration, status and report path.

    ``runs`` has ``start_ts`` and ``end_ts`` and may have ``target_source``, ``scan_mode``,
    ``targets``, ``retries``, ``workflow_error``, ``error_messages`` and ``report_paths``. A workflow
    error is the last of the messages.
    """
    optional = {
        "target_source": "string", "scan_mode": "string", "targets": "array<string>", "retries": "int",
        "workflow_error": "string", "error_messages": "array<string>", "report_paths": "array<string>",
    }
    for name, kind in optional.items():
        if name not in runs.columns:
            runs = runs.withColumn(name, F.lit(None).cast(kind))
    joined = runs.join(probe_stats(probes, [session]), session, "left").join(diff_by_session, session, "left")
    zero = F.lit(0).cast("long")
    counters = ["total_probed", "successful_probes", "failed_probes", "discoverable_items", "n_new", "n_old", "n_existing"]
    seconds = F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))
    messages = F.array_compact(
        F.concat(F.coalesce("error_messages", F.array().cast("array<string>")), F.array("workflow_error"))
    )
    return joined.select(
        session,
        "target_source",
        "scan_mode",
        F.coalesce(F.greatest(F.size("targets"), F.lit(0)), F.lit(0)).cast("long").alias("total_targets"),
        F.coalesce("retries", F.lit(0)).cast("int").alias("retries"),
        F.array_distinct(messages).alias("messages"),
        *[F.coalesce(c, zero).alias(c) for c in counters],
        zero.alias("n_changed"),
        (seconds / F.lit(1e6)).alias("duration_s"),
        run_status(F.col("workflow_error"), F.col("error_messages")).alias("status"),
        report_path(F.col("report_paths")).alias("report_path"),
    )


def validate_summary(summaries: DataFrame) -> DataFrame:
    """Add ``violations``, the list of rules a summary row breaks; an absent text column counts as empty."""
    texts = ["scan_session_id", "target_source", "scan_mode", "status"]
    counts = ["total_targets", "total_probed", "successful_probes", "failed_probes", "duration_s"]
    value = lambda c: F.coalesce(F.col(c), F.lit("")) if c in summaries.columns else F.lit("")
    broken = [F.when(value(c) == "", F.lit(f"{c} is required")) for c in texts]
    broken += [F.when(F.col(c) < 0, F.lit(f"{c} cannot be negative")) for c in counts if c in summaries.columns]
    return summaries.withColumn("violations", F.array_compact(F.array(*broken)))


def assign_batches(
    rows: DataFrame, order: Sequence[Column | str], size: int = 200, threshold: int = 1000
) -> DataFrame:
    """Add ``batch`` (from 0) by place in ``order``; below ``threshold`` rows there is one batch."""
    if size < 1:
        raise ValueError("batch size must be positive")
    numbered = number_rows(rows, order, "_rn", total="_n")
    batch = F.when(F.col("_n") >= threshold, F.floor((F.col("_rn") - 1) / size)).otherwise(0)
    return numbered.withColumn("batch", batch.cast("long")).drop("_rn", "_n")


def batching_stats(rows: DataFrame, size: int = 200, threshold: int = 1000) -> DataFrame:
    """How many batches there are, and how many rows the incomplete one has."""
    n = F.col("n_rows")
    return rows.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.when(n < threshold, F.lit(1)).otherwise(F.ceil(n / size)).cast("long").alias("n_batches"),
        F.when(n < threshold, n).otherwise(n % size).alias("remaining"),
    )


def merge_summaries(batches: DataFrame, parent: str = "parent_session") -> DataFrame:
    """Batch summaries as one row per parent run: counters added up, status from what happened.

    ``batches`` may carry ``processed`` (the batch ran), ``interrupted`` and ``error``. Messages are
    counted here; ``merged_errors`` lists them.
    """
    present = [c for c in COUNTERS if c in batches.columns]
    ran = F.coalesce(F.col("processed"), F.lit(True)) if "processed" in batches.columns else F.lit(True)
    stopped = F.coalesce(F.col("interrupted"), F.lit(False)) if "interrupted" in batches.columns else F.lit(False)
    failed = F.col("error").isNotNull() if "error" in batches.columns else F.lit(False)
    messages = (
        F.coalesce(F.size("error_messages"), F.lit(0)) if "error_messages" in batches.columns else F.lit(0)
    )
    merged = batches.groupBy(parent).agg(
        *[F.sum(c).alias(c) for c in present],
        F.count("*").alias("total_batches"),
        F.count_if(ran).alias("processed_batches"),
        F.sum(F.greatest(messages, F.lit(0))).alias("n_errors"),
        F.max(stopped).alias("_stopped"),
        F.max(failed).alias("_failed"),
    )
    status = (
        F.when(F.col("_stopped") & (F.col("processed_batches") == 0), "FAILED")
        .when(F.col("_stopped"), "PARTIAL_COMPLETE")
        .when(F.col("_failed"), "FAILED")
        .otherwise("COMPLETED")
    )
    return merged.withColumn("status", status).drop("_stopped", "_failed")


def merged_errors(batches: DataFrame, parent: str = "parent_session", batch: str = "batch") -> DataFrame:
    """All messages of a run's batches in order, one per row."""
    return batches.select(parent, batch, F.posexplode("error_messages").alias("item", "message"))


def top_errors(errors: DataFrame, message: str = "error", max_length: int = 800) -> DataFrame:
    """The most frequent error digests as numbered lines within ``max_length`` characters.

    A line has at least four characters, so ``max_length`` digests are more than can fit and the
    windows below run over that many rows at most. The number of digests is taken from the same grouping,
    counts and all: pruned to the digests alone it would be another plan, which reads ``errors`` again.
    """
    counted = (
        errors.where(F.col(message) != "")
        .groupBy(error_digest(message).alias("digest"))
        .agg(F.count("*").alias("n_errors"))
    )
    whole = counted.agg(F.count_if(F.col("n_errors") > 0).alias("_n")).withColumn("_one", F.lit(1))
    by_count = [F.col("n_errors").desc(), F.col("digest")]
    top = counted.orderBy(*by_count).limit(max_length)
    ranked = top.withColumns({"rank": F.row_number().over(Window.orderBy(*by_count)), "_one": F.lit(1)})
    ranked = ranked.join(F.broadcast(whole), "_one")
    line = F.when(F.col("_n") > 1, F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("digest"))).otherwise(
        F.col("digest")
    )
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    sized = ranked.withColumn("line", line).withColumn(
        "_before", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    )
    everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = F.when(F.col("_before") + F.length("line") > max_length, F.col("rank"))
    marked = sized.withColumn("_stop", F.coalesce(F.min(over).over(everything), F.lit(max_length + 1)))
    cut_first = F.col("_stop") == 1
    kept = F.when(cut_first, F.lit(1)).otherwise(F.col("_stop") - 1)
    suffix = F.concat(F.lit("... and "), (F.col("_n") - kept).cast("string"), F.lit(" more errors"))
    shown = marked.where((F.col("rank") < F.col("_stop")) | (cut_first & (F.col("rank") == 1))).select(
        "rank", F.when(cut_first, truncate(F.col("line"), max_length - 50)).otherwise(F.col("line")).alias("line"),
        "n_errors",
    )
    used = F.when(cut_first, F.lit(0)).otherwise(F.col("_before"))
    rest = marked.where(
        (F.col("rank") == F.col("_stop")) & (F.col("_n") > kept) & (used + F.length(suffix) + 1 <= max_length)
    ).select((kept + 1).alias("rank"), suffix.alias("line"), F.lit(None).cast("long").alias("n_errors"))
    return shown.unionByName(rest)


def sample_targets(
    targets: DataFrame, url: str = "url", pos: str = "pos", shown: int = 8, all_up_to: int = 10
) -> DataFrame:
    """A short list of targets as (rank, line): all of a few, else the first ones and how many more.

    The window runs over ``all_up_to`` rows at most.
    """
    whole = targets.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    first = targets.orderBy(pos).limit(all_up_to).withColumns(
        {"rank": F.row_number().over(Window.orderBy(pos)), "_one": F.lit(1)}
    )
    listed = first.join(F.broadcast(whole), "_one").where((F.col("_n") <= all_up_to) | (F.col("rank") <= shown))
    more = whole.where(F.col("_n") > all_up_to).select(
        F.lit(shown + 1).alias("rank"),
        F.concat(F.lit("... and "), (F.col("_n") - shown).cast("string"), F.lit(" more URLs")).alias("line"),
    )
    return listed.select("rank", F.col(url).alias("line")).unionByName(more)


def scan_history(log: DataFrame, session: str = "scan_session_id", ts: str = "event_ts") -> DataFrame:
    """Current state of each run from its append-only log; a start counts as the oldest event."""
    at = F.struct(F.col(ts), F.col("status") != "STARTED")
    is_start = F.col("status") == "STARTED"
    extra = [c for c in log.columns if c not in (session, ts, "status")]
    return log.groupBy(session).agg(
        F.min(F.when(is_start, F.col(ts))).alias("start_ts"),
        F.max(F.when(~is_start, F.col(ts))).alias("end_ts"),
        F.max_by("status", at).alias("status"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in extra],
    )


def last_completed_scan(history: DataFrame) -> DataFrame:
    """The start of the latest completed run, in one row (null if there is none)."""
    return history.where("status = 'COMPLETED'").agg(F.max("start_ts").alias("last_scan_start"))
