"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators.diff import KEYS, diff_keys, fold_inventory, fold_sessions, session_inventory
from ..operators.preprocess import with_normalized
from ..operators.probes import latest_per_key, with_diff_keys
from ..session import SETTINGS, cut_lineage
from ..sources.snapshots import bucket_of, in_folders

PATTERN_AGE_MS = 30 * 24 * 3600 * 1000  # a pattern is forgotten after thirty days without a new URL


def stream_dedupe_urls(urls: DataFrame, ts: str, delay: str = "1 hour", url: str = "url") -> DataFrame:
    """The first sight of each normalised URL; state is dropped once the watermark has passed it."""
    rows = with_normalized(urls, url).where(F.col("norm").isNotNull())
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["norm"])


def _pattern_cap(max_similar: int, ttl_ms: int | None):
    """Lets the first ``max_similar`` URLs of a pattern pass.

    A value holds how many have passed, a map which ones. The value expires ``ttl_ms`` after the last
    one that passed, and a timer then clears the map. The class is local, so that workers get it by value.
    """

    class PatternCap(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.passed = handle.getValueState("passed", "n int", ttl_ms)
            self.seen = handle.getMapState("seen", "norm string", "pos bigint")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            n = self.passed.get()[0] if self.passed.exists() else 0
            if not n and self.seen.exists():  # expired, and the timer is still to come
                self.seen.clear()
            if n >= max_similar:
                return
            known = [norm for (norm,) in self.seen.keys()] if n else []
            best = None
            for pdf in rows:
                fresh = pdf[~pdf["norm"].isin(known)]
                both = fresh if best is None else pd.concat([best, fresh])
                best = both.sort_values("pos").drop_duplicates("norm").head(max_similar - n)
            if best is None or not len(best):
                return
            for norm, pos in zip(best["norm"], best["pos"], strict=True):
                self.seen.updateValue((norm,), (int(pos),))
            self.passed.update((n + len(best),))
            if ttl_ms:
                for (at,) in [(t,) if isinstance(t, int) else t for t in self.handle.listTimers()]:
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + ttl_ms)
            yield best[["pattern", "norm", "pos"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.passed.clear()
            self.seen.clear()
            yield pd.DataFrame()

        def close(self) -> None:
            pass

    return PatternCap()


def _thin_out(max_similar: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            once = pdf.sort_values("pos").drop_duplicates("norm")
            yield once.groupby("pattern", sort=False).head(max_similar)

    return run


def stream_cap_per_pattern(
    urls: DataFrame, max_similar: int = 1, url: str = "url", pos: str = "pos", mode: str = "preprocess",
    ttl_ms: int | None = PATTERN_AGE_MS,
) -> DataFrame:
    """The URLs of a stream, look-alikes capped, in order of micro-batch and then ``pos``.

    Each Arrow batch is thinned to ``max_similar`` URLs per pattern before the shuffle, so a pattern
    with most rows sends few of them to its task, which holds ``max_similar`` URLs at a time. A
    pattern is forgotten ``ttl_ms`` after its last URL that passed; with None it is kept forever. Needs
    the RocksDB state store. While there is a limit of age, Spark makes micro-batches without data to
    look after timers, without end under ``availableNow``; ``run_available`` turns them off.
    """
    rows = (
        with_normalized(urls, url, mode)
        .where(F.col("pattern").isNotNull())
        .select("pattern", "norm", F.col(pos).alias("pos"))
    )
    schema = "pattern string, norm string, pos bigint"
    return (
        rows.mapInPandas(_thin_out(max_similar), schema)
        .groupBy("pattern")
        .transformWithStateInPandas(
            _pattern_cap(max_similar, ttl_ms),
            outputStructType=schema,
            outputMode="Append",
            timeMode="ProcessingTime" if ttl_ms else "None",
        )
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what ``stream`` makes of the input there is to the Parquet table at ``path``, then stop.

    Micro-batches without data are off for this query, and the state store is RocksDB, as stateful processors need.
    """
    spark = stream.sparkSession
    wanted = {
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": SETTINGS["spark.sql.streaming.stateStore.providerClass"],
    }
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    query.awaitTermination()


GENERATION = 16  # micro-batches that are kept apart before they are folded into one
ORDER_KEY = "_order"  # what says which row of a key is the last, stored with the rows


def _write_part(df: DataFrame, base: str, generation: int, cycle: int) -> None:
    """Write what one micro-batch adds as its own folder; a repeated batch replaces it."""
    df.write.mode("overwrite").parquet(f"{base}/generation={generation}/cycle={cycle}")


def stream_url_inventory(probes: DataFrame, base: str, checkpoint: str):
    """Keep the inventory of a probe stream: each micro-batch adds partial rows per URL and session.

    Every ``GENERATION`` micro-batches what there is becomes one row per URL and session, the start of
    a new generation; readers look at the last generation alone. All of a generation is written before
    the first batch of the next is done, so a batch that runs again finds what it found before.
    """

    def merge(batch: DataFrame, cycle: int) -> None:
        generation = cycle // GENERATION
        if generation and cycle % GENERATION == 0:
            before = batch.sparkSession.read.parquet(f"{base}/generation={generation - 1}")
            _write_part(fold_sessions(before.drop("cycle")), base, generation, -1)
        _write_part(session_inventory(with_diff_keys(batch)), base, generation, cycle)

    return (
        probes.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_inventory(spark: SparkSession, base: str) -> DataFrame:
    parts = spark.read.parquet(base)
    # the folded rows are followed by the batch that folded them: a generation counts from that batch on
    last = parts.where("cycle >= 0").agg(F.max("generation")).first()[0]
    return fold_inventory(fold_sessions(parts.where(F.col("generation") == last).drop("generation", "cycle")))


def _with_text_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with its sessions as text, whatever they look like in folder names."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType() if f.name == "scan_session_id" else f.dataType) for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _versions(diff: DataFrame) -> DataFrame:
    """The last version of every folder of compared keys; only names of folders are looked at."""
    return diff.groupBy("scan_session_id", "host_bucket").agg(F.max("at").alias("at"))


def _version_filter(versions: list) -> Column:
    name = F.concat_ws("/", F.col("scan_session_id"), F.col("host_bucket").cast("string"), F.col("at").cast("string"))
    return name.isin([f"{s}/{b}/{at}" for s, b, at in versions])


def _session_index(spark: SparkSession, base: str, cycle: int) -> DataFrame:
    """host, host_bucket and scan_session_id of all micro-batches up to ``cycle``."""
    index = _with_text_sessions(spark, f"{base}/index")
    generation = cycle // GENERATION
    # a generation starts with what the one before it held
    return index.where((F.col("generation") == generation) & (F.col("cycle") <= cycle)).select("host", "host_bucket", "scan_session_id").distinct()


def _write_folders(df: DataFrame, path: str, *folders: str) -> None:
    """Replace the folders that ``df`` has rows of; its rows are gathered by folder, large ones in several files."""
    rebalanced = df.hint("rebalance", *folders)
    rebalanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def stream_snapshots(probes: DataFrame, base: str, checkpoint: str, order: list[str], buckets: int = 4):
    """Diff every session of a probe stream with each host's session before, whatever way its rows arrive.

    Rows lie under ``base``/rows, by session, bucket of hosts and micro-batch; ``base``/index knows which
    host has which sessions. A micro-batch compares the sessions of its hosts, and the sessions that
    follow them, with the ones before, and reads the keys in the folders of these alone. ``base``/diff takes the status of
    every key as a new version of every folder touched, with what the last version has of other hosts. A row is written
    once; ``read_snapshots`` puts the status to it. All steps give the same when a batch runs again.
    ``vacuum_snapshots`` deletes superseded versions.
    """

    def run_cycle(batch: DataFrame, cycle: int) -> None:
        spark = batch.sparkSession
        place = ["scan_session_id", "host_bucket"]
        keyed = with_diff_keys(batch).where(F.col("host").isNotNull() & F.col("scan_session_id").isNotNull()).withColumn("host_bucket", bucket_of("host", buckets))
        keyed = keyed.drop("cycle", "at").withColumn(ORDER_KEY, F.struct(*order)).withColumn("cycle", F.lit(cycle))
        _write_folders(keyed, f"{base}/rows", *place, "cycle")
        generation = cycle // GENERATION
        if generation and cycle % GENERATION == 0:
            _write_part(_session_index(spark, base, cycle - 1), f"{base}/index", generation, -1)
        schema = T.StructType([f for f in keyed.schema.fields if f.name not in (*place, "cycle")] + [keyed.schema[c] for c in (*place, "cycle")])
        stored = spark.read.schema(schema).parquet(f"{base}/rows")
        _write_part(stored.where(F.col("cycle") == cycle).select("host", *place).distinct(), f"{base}/index", generation, cycle)
        touched = _with_text_sessions(spark, f"{base}/index/generation={generation}/cycle={cycle}").select("host", "scan_session_id")
        sessions = _session_index(spark, base, cycle).join(touched.select("host").distinct(), "host", "left_semi")
        # a session that comes before a stored one changes what that one is compared with
        ahead = Window.partitionBy("host").orderBy("scan_session_id")
        marked = sessions.join(touched.withColumn("_touched", F.lit(True)), ["host", "scan_session_id"], "left")
        marked = marked.withColumn("_wanted", F.coalesce(F.col("_touched") | F.lag("_touched").over(ahead), F.lag("_touched").over(ahead), F.lit(False)))
        needed = marked.withColumn("_needed", F.col("_wanted") | F.coalesce(F.lead("_wanted").over(ahead), F.lit(False)))
        needed = cut_lineage(needed.where("_needed").select("host", *place, "_wanted"))
        folders = [tuple(r) for r in needed.select(*place).distinct().collect()]  # of the hosts in the batch
        if not folders:
            return
        keys = stored.where(in_folders(folders) & (F.col("cycle") <= cycle)).select(*KEYS, "scan_session_id")
        keys = keys.join(needed, ["host", "scan_session_id"], "left_semi").distinct()
        wanted = needed.where("_wanted").select("host", "scan_session_id")
        diff = diff_keys(keys, needed).withColumn("host_bucket", bucket_of("host", buckets))
        changed = [tuple(r) for r in needed.where("_wanted").select(*place).distinct().collect()]
        if cycle and _exists(spark, f"{base}/diff"):
            before = spark.read.schema(T.StructType([*diff.schema.fields, T.StructField("at", T.IntegerType())])).parquet(f"{base}/diff")
            before = before.where(in_folders(changed) & (F.col("at") < cycle))
            last = [tuple(r) for r in _versions(before).collect()]
            kept = before.where(_version_filter(last)).join(wanted, ["host", "scan_session_id"], "left_anti").drop("at")
            diff = diff.unionByName(kept)
        _write_folders(diff.withColumn("at", F.lit(cycle)), f"{base}/diff", *place, "at")

    return (
        probes.writeStream.foreachBatch(run_cycle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def read_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """The compared rows of every session, by the last version of each folder.

    Every row takes the status of its key; of a key that is gone, the last row of the session before is
    shown in the one it is missing from. Rows of a micro-batch that a version does not cover are left out.
    """
    diff = _with_text_sessions(spark, f"{base}/diff")
    diff = diff.join(_versions(diff), ["scan_session_id", "host_bucket", "at"], "left_semi")
    rows = _with_text_sessions(spark, f"{base}/rows").drop("host_bucket", "url_status")
    marks = diff.select(
        F.col("host").alias("_host"), F.col("url_key").alias("_key"), F.coalesce("seen_in", "scan_session_id").alias("_seen_in"),
        F.col("scan_session_id").alias("_session"), "url_status", "at",
    )
    same = (F.col("host") == F.col("_host")) & F.col("url_key").eqNullSafe(F.col("_key")) & (F.col("scan_session_id") == F.col("_seen_in"))
    marked = lambda some: rows.join(marks.where(some), same & (F.col("cycle") <= F.col("at")))
    fresh = marked(F.col("url_status") != "old")
    gone = latest_per_key(marked(F.col("url_status") == "old"), [*KEYS, "_session"], [ORDER_KEY])
    shown = [c for c in rows.columns if c not in ("scan_session_id", "cycle", ORDER_KEY)]
    return fresh.unionByName(gone).select(F.col("_session").alias("scan_session_id"), *shown, "url_status")


def vacuum_snapshots(spark: SparkSession, base: str) -> int:
    """Delete the versions of compared keys before the last two of every folder, and say how many.

    The one before the last stays, since a batch that runs again reads it. Not while the stream runs.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/diff")
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    versions: dict[str, list] = {}
    for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/diff/*/*/at=*")) or []:
        path = status.getPath()
        versions.setdefault(path.getParent().toString(), []).append((int(path.getName()[3:]), path))
    old = [path for found in versions.values() for _, path in sorted(found, key=lambda v: v[0])[:-2]]
    for path in old:
        system.delete(path, True)
    return len(old)


class ProgressCounters(StreamingQueryListener):
    """Adds up the counters that ``stream_progress`` puts on a stream."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.totals: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        for key, value in (row.asDict() if row else {}).items():
            self.totals[key] = self.totals.get(key, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_progress(probes: DataFrame, name: str = "progress") -> DataFrame:
    """Count rows and errors of each micro-batch while it runs."""
    return probes.observe(
        name,
        F.count("*").alias("n_processed"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("n_errors"),
    )


def wait_for_events(spark: SparkSession) -> None:
    """Wait until the listeners have seen what has happened so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
