"""Comparing a snapshot with the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .probes import latest_per_key

KEYS = ["host", "url_key"]


def previous_snapshot(
    probes: DataFrame,
    current_session: str,
    session: str = "scan_session_id",
    include_vanished_hosts: bool = False,
) -> DataFrame:
    """The rows of each host's latest session before ``current_session``.

    Hosts without a row in the current session are left out unless asked for. The per-host table is
    one row per host and joins by equality; the rows of a host that owns most of the history are
    split by the adaptive skew join.
    """
    history = probes.where(F.col(session) < current_session)
    latest = history.groupBy("host").agg(F.max(session).alias(session))
    if not include_vanished_hosts:
        present = probes.where(F.col(session) == current_session).select("host").distinct()
        latest = latest.join(present, "host", "left_semi")
    return history.join(latest, ["host", session], "left_semi")


def url_diff(current: DataFrame, previous: DataFrame, order: list[str]) -> DataFrame:
    """All current rows as ``new`` or ``existing`` and the vanished rows as ``old``, in ``url_status``.

    Both frames carry ``host`` and ``url_key``. Repeats of a current row each get a status; of the
    previous rows the last per key counts. A full outer join could not be split where one key owns
    most rows, so the current rows join the distinct previous keys from the left (which can be split)
    and the vanished rows come from an anti join of distinct keys.
    """
    known = previous.select(*KEYS).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known"), F.lit("existing")).otherwise(F.lit("new"))
    fresh = current.join(known, KEYS, "left").withColumn("url_status", status).drop("_known")
    gone = (
        latest_per_key(previous, KEYS, order)
        .join(current.select(*KEYS).distinct(), KEYS, "left_anti")
        .withColumn("url_status", F.lit("old"))
    )
    return fresh.unionByName(gone, allowMissingColumns=True)


def diff_sessions(
    probes: DataFrame,
    current_session: str,
    order: list[str],
    session: str = "scan_session_id",
    include_vanished_hosts: bool = False,
) -> DataFrame:
    """``url_diff`` of one session of a probe table against each host's session before.

    The probe table is read twice: for the session before of each host, then for the rows of both
    sessions, which are written and compared from there.
    """
    at = F.col(session)
    past = probes.where(at <= current_session)
    hosts = past.groupBy("host").agg(
        F.max(F.when(at < current_session, at)).alias("_before"), F.max(at == current_session).alias("_present")
    )
    if not include_vanished_hosts:
        hosts = hosts.where("_present")
    both = past.join(hosts, "host").where((at == current_session) | (at == F.col("_before")))
    both = cut_lineage(both.drop("_before", "_present"))
    return url_diff(both.where(at == current_session), both.where(at < current_session), order)


def diff_every_session(
    probes: DataFrame, order: list[str], session: str = "scan_session_id", only: DataFrame | None = None
) -> DataFrame:
    """``url_diff`` of every session against each host's session before, in one job.

    The rows of a session get a status; a vanished row is ``old`` in the session it is missing from.
    ``only`` (host, session) limits the sessions that are compared. The order of sessions comes from
    one row per host and session; the probe table is read once for either side of the comparison.
    """
    pairs = probes.select("host", F.col(session).alias("_s")).distinct()
    following = pairs.withColumn("_next", F.lead("_s").over(Window.partitionBy("host").orderBy("_s")))
    following = following.where(F.col("_next").isNotNull())
    current = probes
    if only is not None:
        wanted = only.select("host", F.col(session).alias("_s")).distinct()
        following = following.join(wanted.withColumnRenamed("_s", "_next"), ["host", "_next"], "left_semi")
        current = probes.join(wanted.withColumnRenamed("_s", session), ["host", session], "left_semi")
    history = probes.join(following.withColumnRenamed("_s", session), ["host", session])
    before = latest_per_key(history, [*KEYS, "_next"], order).withColumn(session, F.col("_next")).drop("_next")
    place = [*KEYS, session]
    known = before.select(*place, F.lit(True).alias("_known"))
    status = F.when(F.col("_known"), F.lit("existing")).otherwise(F.lit("new"))
    fresh = current.join(known, place, "left").withColumn("url_status", status).drop("_known")
    gone = before.join(current.select(*place).distinct(), place, "left_anti").withColumn("url_status", F.lit("old"))
    return fresh.unionByName(gone)


def diff_keys(keys: DataFrame, sessions: DataFrame, session: str = "scan_session_id") -> DataFrame:
    """What ``diff_every_session`` says of every key, without its rows: ``host``, ``url_key``, the session and ``url_status``.

    ``keys`` has every host, key and session once. ``sessions`` (host, session, ``_wanted``) lists the
    sessions that are compared and the ones before them. An ``old`` key has the session that its last row is in, ``seen_in``.
    """
    ahead = Window.partitionBy("host").orderBy("seen_in")
    following = sessions.select("host", F.col(session).alias("seen_in"), "_wanted").withColumns(
        {"_next": F.lead("seen_in").over(ahead), "_compared": F.lead("_wanted").over(ahead)}
    )
    following = following.where("_compared").select("host", "seen_in", "_next")
    place = [*KEYS, session]
    before = keys.withColumnRenamed(session, "seen_in").join(following, ["host", "seen_in"])
    before = before.select(*KEYS, F.col("_next").alias(session), "seen_in")
    current = keys.join(sessions.where("_wanted"), ["host", session], "left_semi").select(*place, F.lit(True).alias("_current"))
    status = F.when(F.col("_current").isNull(), "old").when(F.col("seen_in").isNull(), "new").otherwise("existing")
    seen_in = F.when(F.col("_current").isNull(), F.col("seen_in"))
    # a key is there once on either side, so no key can own many rows
    return current.join(before, place, "full").select(*place, status.alias("url_status"), seen_in.alias("seen_in"))


def diff_counts(diff: DataFrame) -> DataFrame:
    """new / old / existing per host, and in total where ``host`` is null."""
    return diff.rollup("host").agg(
        F.count_if(F.col("url_status") == "new").alias("n_new"),
        F.count_if(F.col("url_status") == "old").alias("n_old"),
        F.count_if(F.col("url_status") == "existing").alias("n_existing"),
        F.lit(0).cast("long").alias("n_changed"),
    )


def diff_counts_by_session(probes: DataFrame, session: str = "scan_session_id") -> DataFrame:
    """new / old / existing of every session against each host's session before, in one job.

    The window runs over one row per host and session, not over probe rows.
    """
    keyed = probes.select("host", F.col(session).alias("_s"), "url_key")
    rows = keyed.groupBy("host", "_s", "url_key").agg(F.count("*").alias("n"))
    following = keyed.select("host", "_s").distinct().withColumn(
        "_next", F.lead("_s").over(Window.partitionBy("host").orderBy("_s"))
    )
    before = (
        rows.select("host", "_s", "url_key")
        .join(following.where(F.col("_next").isNotNull()), ["host", "_s"])
        .select("host", F.col("_next").alias("_s"), "url_key", F.lit(1).alias("_before"))
    )
    both = rows.join(before, ["host", "_s", "url_key"], "full")
    n, known = F.coalesce("n", F.lit(0)), F.col("_before").isNotNull()
    return both.groupBy(F.col("_s").alias(session)).agg(
        F.sum(F.when(~known, n).otherwise(0)).alias("n_new"),
        F.count_if(F.col("n").isNull()).alias("n_old"),
        F.sum(F.when(known, n).otherwise(0)).alias("n_existing"),
    )


def apply_status(probes: DataFrame, diff: DataFrame) -> DataFrame:
    """The status of ``diff`` on each probe row, by host and key."""
    status = diff.where("url_status <> 'old'").groupBy(*KEYS).agg(F.min("url_status").alias("url_status"))
    return probes.drop("url_status").join(status, KEYS, "left")


def report_rows(diff: DataFrame) -> DataFrame:
    """What a report shows: current rows and the vanished ones."""
    return diff.where(F.col("url_status").isin("new", "existing", "old"))


def session_inventory(
    probes: DataFrame, ts: str = "scan_ts", session: str = "scan_session_id", tie: str = "probe_id"
) -> DataFrame:
    """First and last sight of each URL within each session, as partial rows of an inventory."""
    at = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"))
    return probes.groupBy(*KEYS, F.col(session).alias("session")).agg(
        F.min(ts).alias("first_seen"),
        F.max(at).alias("last_at"),
        F.max_by("status_code", at).alias("last_status"),
    )


def fold_sessions(partial: DataFrame) -> DataFrame:
    """Partial rows of one session that came in several batches as one row."""
    return partial.groupBy(*KEYS, "session").agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_at").alias("last_at"),
        F.max_by("last_status", "last_at").alias("last_status"),
    )


def fold_inventory(partial: DataFrame) -> DataFrame:
    """One row per URL from one row per URL and session."""
    return partial.groupBy(*KEYS).agg(
        F.min("first_seen").alias("first_seen"),
        F.max("last_at")["ts"].alias("last_seen"),
        F.max_by("last_status", "last_at").alias("last_status"),
        F.count("*").alias("n_sessions"),
    )


def url_inventory(
    probes: DataFrame, ts: str = "scan_ts", session: str = "scan_session_id", tie: str = "probe_id"
) -> DataFrame:
    """First and last time each URL was seen, its last status, and in how many sessions.

    Rows are combined per session first, so a URL probed over and over is one row per task and
    session before the shuffle.
    """
    return fold_inventory(session_inventory(probes, ts, session, tie))
