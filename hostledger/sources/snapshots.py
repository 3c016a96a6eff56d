"""Probe snapshots as a partitioned Parquet table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..operators.numbering import running_total
from ..operators.probes import STORAGE_SCHEMA
from ..session import cut_lineage

CODECS = ("gzip", "snappy", "zstd")

TABLE_SCHEMA = T.StructType(
    [f for f in STORAGE_SCHEMA if f.name != "scan_session_id"]
    + [
        T.StructField("host", T.StringType()),
        T.StructField("scan_session_id", T.StringType()),
        T.StructField("host_bucket", T.IntegerType()),
    ]
)
HOST_BUCKETS = 16  # folders of a session; part of the layout of a table


def codec_or_default(codec: str | None) -> str:
    return codec if codec in CODECS else "zstd"


def bucket_of(host: str, buckets: int = HOST_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(buckets)).cast("int")


INDEX_SCHEMA = "host string, host_bucket int, n_rows bigint, scan_session_id string"


def in_folders(folders: list[tuple[str, int]]) -> Column:
    """A partition filter for (session, host bucket) pairs: one set of values, however many there are."""
    return F.concat_ws("/", F.col("scan_session_id"), F.col("host_bucket").cast("string")).isin([f"{s}/{b}" for s, b in folders])


def host_sessions(spark: SparkSession, base: str) -> DataFrame:
    """The index of the table at ``base``: host, scan_session_id, host_bucket and n_rows, a row per host and session.

    ``write_snapshot`` keeps it beside the rows, in a folder that readers of the table do not see. A
    table without one is indexed from its rows.
    """
    try:
        return spark.read.schema(INDEX_SCHEMA).parquet(f"{base}/_hosts")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    table = _stored(spark, base)
    if table is None:
        return spark.createDataFrame([], INDEX_SCHEMA)
    return table.groupBy("scan_session_id", "host_bucket", "host").agg(F.count("*").alias("n_rows")).select("host", "host_bucket", "n_rows", "scan_session_id")


def _write_index(written: DataFrame, base: str) -> None:
    """Put what ``written`` holds in place of what the index has of its folders; a file per session."""
    spark = written.sparkSession
    columns = ["host", "host_bucket", "n_rows", "scan_session_id"]
    counted = cut_lineage(written.groupBy("scan_session_id", "host_bucket", "host").agg(F.count("*").alias("n_rows")).select(*columns))
    try:
        known = spark.read.schema(INDEX_SCHEMA).parquet(f"{base}/_hosts").select(*columns)
        touched = counted.select("scan_session_id", "host_bucket").distinct()
        known = known.join(touched.select("scan_session_id").distinct(), "scan_session_id", "left_semi")
        counted = counted.unionByName(cut_lineage(known.join(touched, ["scan_session_id", "host_bucket"], "left_anti")))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    (
        counted.hint("rebalance", "scan_session_id").sortWithinPartitions("scan_session_id", "host")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_session_id").parquet(f"{base}/_hosts")
    )


def sessions_before(index: DataFrame, current_session: str, include_vanished_hosts: bool = False) -> DataFrame:
    """host, scan_session_id and host_bucket of every host's latest session before ``current_session``."""
    before = index.where(F.col("scan_session_id") < current_session)
    latest = before.groupBy("host", "host_bucket").agg(F.max("scan_session_id").alias("scan_session_id"))
    if include_vanished_hosts:
        return latest
    present = index.where(F.col("scan_session_id") == current_session).select("host").distinct()
    return latest.join(present, "host", "left_semi")


def rows_of(spark: SparkSession, base: str, wanted: DataFrame) -> DataFrame:
    """The stored rows of the ``wanted`` (host, scan_session_id, host_bucket), reading their folders alone.

    The list of folders goes through the driver, which lists the folders of a table anyway.
    """
    wanted = cut_lineage(wanted.select("host", "scan_session_id", "host_bucket").distinct())
    folders = [tuple(r) for r in wanted.select("scan_session_id", "host_bucket").distinct().collect()]
    table = _stored(spark, base)
    if table is None:
        table = spark.createDataFrame([], TABLE_SCHEMA)
    return table.where(in_folders(folders)).join(wanted.drop("host_bucket"), ["host", "scan_session_id"], "left_semi").drop("host_bucket")


def read_previous_snapshot(
    spark: SparkSession, base: str, current_session: str, include_vanished_hosts: bool = False
) -> DataFrame:
    """The stored rows of each host's latest session before ``current_session``, looked up in the index.

    Hosts without a row in the current session are left out unless asked for. Only folders that hold
    a row of the answer's hosts and sessions are read, however long the history is.
    """
    index = host_sessions(spark, base)
    return rows_of(spark, base, sessions_before(index, current_session, include_vanished_hosts))


def _stored(spark: SparkSession, base: str, skip_broken: bool = False) -> DataFrame | None:
    """The table at ``base``; None if there is none yet."""
    reader = spark.read.schema(TABLE_SCHEMA)
    if skip_broken:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    try:
        return reader.parquet(base)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_snapshot(rows: DataFrame, base: str, codec: str = "zstd") -> None:
    """Write stored rows with their ``host``; what the table holds of the same session and host is replaced.

    There is a folder per session and bucket of hosts. A write reads back the buckets it touches, in
    the sessions it touches, keeps the rows of other hosts and rewrites those folders; other hosts can
    be written one after the other. Files are cut by size, a huge host into several, and sorted, so a
    reader skips other hosts by statistics. A row without a host or session is an error. One writer
    at a time.
    """
    if not base:
        raise ValueError("the base path of the snapshots is empty")
    for name in ("host", "scan_session_id"):
        missing = F.coalesce(F.col(name), F.lit("")) == ""
        rows = rows.withColumn(name, F.when(missing, F.raise_error(F.lit(f"a snapshot row has no {name}"))).otherwise(F.col(name)))
    # computed once: the rows to keep are read from the folders that are then rewritten
    fresh = cut_lineage(rows.select(*[f.name for f in TABLE_SCHEMA if f.name != "host_bucket"]).withColumn("host_bucket", bucket_of("host")))
    written = fresh
    stored = _stored(rows.sparkSession, base)
    if stored is not None:
        folders = fresh.select("scan_session_id", "host_bucket").distinct()
        replaced = fresh.select("scan_session_id", "host").distinct()
        others = stored.join(folders, ["scan_session_id", "host_bucket"], "left_semi")
        kept = cut_lineage(others.join(replaced, ["scan_session_id", "host"], "left_anti"))
        written = fresh.unionByName(kept)
    (
        written.hint("rebalance", "scan_session_id", "host_bucket")
        .sortWithinPartitions("scan_session_id", "host_bucket", "host", "original_url")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", codec_or_default(codec))
        .partitionBy("scan_session_id", "host_bucket")
        .parquet(base)
    )
    # last, so that a write that broke off is repaired by running it again
    _write_index(written, base)


def read_snapshot(
    spark: SparkSession,
    base: str,
    host: str | None = None,
    session: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    skip_broken: bool = False,
    total: str | None = None,
) -> DataFrame:
    """Stored rows, of one host or session if given. No table gives no rows.

    Session and bucket of the host are partition filters, the host is a pushed-down filter. A missing
    root target is filled with the host. Paging orders by session, time, URLs and a hash of the rest,
    so rows that tie are equal. ``total`` names a column for the number of rows before paging.
    Unreadable files are an error unless ``skip_broken`` is set, which leaves their rows out.
    """
    if not base:
        raise ValueError("the base path of the snapshots is empty")
    table = _stored(spark, base, skip_broken)
    if table is None:
        table = spark.createDataFrame([], TABLE_SCHEMA)
    if host is not None:
        bucket = F.pmod(F.xxhash64(F.lit(host)), F.lit(HOST_BUCKETS)).cast("int")
        table = table.where((F.col("host_bucket") == bucket) & (F.col("host") == host))
    if session is not None:
        table = table.where(F.col("scan_session_id") == session)
    table = table.drop("host_bucket").withColumn("root_target_url", F.coalesce("root_target_url", "host"))
    if total:
        table = table.join(F.broadcast(table.agg(F.count("*").alias(total))))  # one row
    if limit is not None or offset:
        plain = [f.name for f in table.schema.fields if not isinstance(f.dataType, T.MapType)]
        table = table.orderBy("scan_session_id", "scan_timestamp", "original_url", "final_url", F.xxhash64(*plain))
        table = table.offset(offset) if offset else table
        table = table.limit(limit) if limit is not None else table
    return table


PAGE_KEY = ["scan_session_id", "host", "original_url", "scan_timestamp", "final_url", "row_hash"]


def _page_of(spark: SparkSession, base: str, groups: list, skip: int, n: int, after: dict | None = None) -> DataFrame:
    """``n`` rows of the hosts in ``groups`` (session, bucket, host), in the order of ``PAGE_KEY``, from ``skip`` or ``after`` on."""
    table = _stored(spark, base)
    if table is None:
        table = spark.createDataFrame([], TABLE_SCHEMA)
    sessions: dict[str, set] = {}
    for session, _, host in groups:
        sessions.setdefault(session, set()).add(host)
    table = table.where(in_folders(sorted({(s, b) for s, b, _ in groups})) & F.col("host").isin(sorted({h for _, _, h in groups})))
    # a host of one session may be in the folders of another one
    wanted = [F.struct(F.lit(s), F.lit(h)) for s, hosts in sessions.items() for h in sorted(hosts)]
    table = table.where(F.struct("scan_session_id", "host").isin(wanted) if wanted else F.lit(False)).drop("host_bucket")
    plain = [f.name for f in table.schema.fields if not isinstance(f.dataType, T.MapType)]
    rows = table.withColumn("row_hash", F.xxhash64(*plain))
    if after is not None:
        there = (F.col("scan_session_id") == after["scan_session_id"]) & (F.col("host") == after["host"])
        url = F.col("original_url")
        rows = rows.where(~there | (url >= after["original_url"]))  # reaches the scan
        rest = [("scan_timestamp", after["scan_timestamp"]), ("final_url", after["final_url"] or ""), ("row_hash", after["row_hash"])]
        later, equal = url > after["original_url"], url == after["original_url"]
        for name, value in rest:
            at = F.coalesce(F.col(name), F.lit("")) if name == "final_url" else F.coalesce(F.col(name), F.lit(-(1 << 63)))
            value = -(1 << 63) if value is None else value
            later, equal = later | (equal & (at > value)), equal & (at == value)
        rows = rows.where(~there | later)
    order = ["scan_session_id", "host", "original_url", F.coalesce("scan_timestamp", F.lit(-(1 << 63))), F.coalesce("final_url", F.lit("")), "row_hash"]
    rows = rows.orderBy(*order)
    return (rows.offset(skip) if skip else rows).limit(n)


def snapshot_page(spark: SparkSession, base: str, n: int, offset: int = 0) -> DataFrame:
    """``n`` rows from position ``offset`` on, in the order of ``PAGE_KEY``, with ``row_hash``.

    The index tells which hosts of which session the page shows; only their folders are read, and of
    these only row groups that can hold such a host. So a page deep in the table costs what the
    first one does, but for a host larger than a page, which is read as a whole: go on from row to row with ``snapshot_page_after``.
    """
    index = host_sessions(spark, base)
    sums = sorted((r["scan_session_id"], r["n"]) for r in index.groupBy("scan_session_id").agg(F.sum("n_rows").alias("n")).collect())  # a row per session
    before, sessions, first = 0, [], None
    for session, rows in sums:
        if before < offset + n and before + rows > offset:
            first = before if first is None else first
            sessions.append(session)
        before += rows
    if not sessions:
        return _page_of(spark, base, [], 0, n)
    placed = running_total(index.where(F.col("scan_session_id").isin(sessions)), ["scan_session_id", "host"], "n_rows", "rows_before")
    start = offset - first
    groups = placed.where((F.col("rows_before") < start + n) & (F.col("rows_before") + F.col("n_rows") > start)).collect()  # n hosts at most
    skip = start - min(g["rows_before"] for g in groups)
    return _page_of(spark, base, [(g["scan_session_id"], g["host_bucket"], g["host"]) for g in groups], skip, n)


def snapshot_page_after(spark: SparkSession, base: str, n: int, after: dict) -> DataFrame:
    """The ``n`` rows that follow ``after``, a row of a page: the values of ``PAGE_KEY``.

    Reads the rest of that row's host, from its URL on, and of the next hosts as many as fill the page.
    Rows that are equal in every column follow each other as one: none of them comes after another.
    """
    index = host_sessions(spark, base)
    at = (F.col("scan_session_id") > after["scan_session_id"]) | ((F.col("scan_session_id") == after["scan_session_id"]) & (F.col("host") >= after["host"]))
    groups, filled = [], 0
    for g in index.where(at).orderBy("scan_session_id", "host").limit(n + 1).collect():  # every host has a row
        groups.append((g["scan_session_id"], g["host_bucket"], g["host"]))
        filled += g["n_rows"] if (g["scan_session_id"], g["host"]) != (after["scan_session_id"], after["host"]) else 0
        if filled >= n:
            break
    return _page_of(spark, base, groups, 0, n, after)


def snapshot_total(spark: SparkSession, base: str) -> int:
    """How many rows the table has, from its index."""
    return host_sessions(spark, base).agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
