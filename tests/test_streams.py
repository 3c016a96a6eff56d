import datetime as dt
import time

from pyspark.sql import functions as F

from hostledger.operators import diff as D
from hostledger.operators.preprocess import preprocess_urls
from hostledger.operators.probes import with_diff_keys
from hostledger.session import scratch_path
from hostledger.streaming import streams

URLS = "pos bigint, url string, seen_at timestamp"


def feed(spark, source, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).parquet(source)


def drain(stream, spark, out, state):
    streams.run_available(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out).collect()


def urls(first, n):
    at = dt.datetime(2024, 1, 1)
    return [(i, f"http://h/{'en' if i % 3 else 'about'}/{i % 4}#f{i}", at + dt.timedelta(seconds=i)) for i in range(first, first + n)]


def test_dedupe_over_batches(spark):
    source, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    for first in (0, 30):
        stream = feed(spark, source, urls(first, 30), URLS)
        rows = drain(streams.stream_dedupe_urls(stream, "seen_at").select("norm"), spark, out, state)
    assert sorted(r["norm"] for r in rows) == sorted({u.split("#")[0] for _, u, _ in urls(0, 60)})


def test_cap_equals_batch_cap(spark):
    source, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    for first in (0, 40):
        stream = feed(spark, source, urls(first, 40), URLS)
        rows = drain(streams.stream_cap_per_pattern(stream, max_similar=2), spark, out, state)
    batch = preprocess_urls(spark.createDataFrame(urls(0, 80), URLS), max_similar=2).collect()
    assert sorted((r["norm"], r["pos"]) for r in rows) == sorted((r["norm"], r["pos"]) for r in batch)


def stored_state(spark, state, variable):
    return spark.read.format("statestore").option("path", state).option("stateVarName", variable).load().collect()


def test_a_pattern_is_forgotten_after_its_age(spark):
    """Two patterns fill up; once their age has passed, the state is gone and their URLs pass again."""
    source, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    at = dt.datetime(2024, 1, 1)
    page = lambda i, p: (i, f"http://h/{p}/{i}", at)
    cap = lambda stream: streams.stream_cap_per_pattern(stream, max_similar=2, ttl_ms=6000)
    rows = drain(cap(feed(spark, source, [page(1, "a"), page(2, "a"), page(3, "a"), page(4, "b")], URLS)), spark, out, state)
    assert sorted(r["pos"] for r in rows) == [1, 2, 4]
    assert len(stored_state(spark, state, "passed")) == 2 and len(stored_state(spark, state, "seen")) == 3
    time.sleep(7)
    rows = drain(cap(feed(spark, source, [page(5, "a"), page(6, "c")], URLS)), spark, out, state)
    assert sorted(r["pos"] for r in rows) == [1, 2, 4, 5, 6]  # a starts anew
    time.sleep(7)
    drain(cap(feed(spark, source, [page(7, "d")], URLS)), spark, out, state)
    assert [r["key"]["pattern"] for r in stored_state(spark, state, "passed")] == [r["key"]["pattern"] for r in stored_state(spark, state, "seen")]
    assert len(stored_state(spark, state, "seen")) == 1


def test_a_pattern_is_kept_without_an_age(spark):
    source, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    for first in (0, 20, 40):
        stream = feed(spark, source, urls(first, 20), URLS)
        rows = drain(streams.stream_cap_per_pattern(stream, ttl_ms=None), spark, out, state)
    batch = preprocess_urls(spark.createDataFrame(urls(0, 60), URLS), max_similar=1).collect()
    assert sorted(r["norm"] for r in rows) == sorted(r["norm"] for r in batch)
    assert sum(r["value"]["n"] for r in stored_state(spark, state, "passed")) == len(rows)


PROBES = "probe_id bigint, input_url string, final_url string, status_code int, error string, scan_session_id string, scan_ts timestamp"


def probe(i, url, day):
    return (i, url, None, 200, "x" if i % 2 else None, f"2024-01-0{day}", dt.datetime(2024, 1, day, 0, 0, i))


ARRIVALS = [
    [probe(1, "http://a/1", 1), probe(2, "http://a/2", 1), probe(3, "http://b/1", 1)],
    [probe(4, "http://a/2", 2), probe(5, "http://a/3", 2)],
    [probe(6, "http://b/2", 3), probe(7, "http://a/3", 3), probe(8, "http://a/3", 3)],
]


def test_snapshots_and_inventory(spark):
    """Rows of a session in any order and any number of micro-batches, some twice, give what one batch gives."""
    everything = [r for rows in ARRIVALS for r in rows]
    order = ["scan_ts", "probe_id"]
    whole = with_diff_keys(spark.createDataFrame(everything, PROBES))
    columns = ["scan_session_id", "host", "url_key", "probe_id", "url_status"]
    wanted = D.diff_every_session(whole, order).select(*columns)
    for arrivals in (ARRIVALS, [everything[5:], everything[:2], everything[2:5]], [[r] for r in everything[::-1]]):
        source, cycles, s1, base, s2 = (scratch_path(spark, n) for n in ("src", "cycles", "s1", "inv", "s2"))
        for rows in arrivals:
            stream = feed(spark, source, rows, PROBES)
            streams.stream_snapshots(stream, cycles, s1, order).awaitTermination()
            streams.stream_url_inventory(stream, base, s2).awaitTermination()
        got = streams.read_snapshots(spark, cycles).select(*columns)
        assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
        assert D.url_inventory(whole).exceptAll(streams.read_inventory(spark, base)).isEmpty()


def test_a_batch_reads_the_folders_of_its_hosts(spark, tmp_path, monkeypatch):
    """Twenty batches, a session each; what a batch reads of rows and compared rows stays the same."""
    monkeypatch.setattr(streams, "GENERATION", 4)
    source, state = (str(tmp_path / n) for n in ("src", "state"))
    base = f"file:{tmp_path}/cycles"
    rows, opened = [], []
    real = streams.in_folders
    monkeypatch.setattr(streams, "in_folders", lambda folders: opened.append(set(folders)) or real(folders))
    for n in range(20):
        fresh = [(100 * n + i, f"http://h{i % 3}.test/{(i + n) % 5}", None, 200, None, f"2024-03-{n + 1:02d}", dt.datetime(2024, 3, 1 + n, 0, 0, i)) for i in range(9)]
        rows += fresh
        feed(spark, source, fresh, PROBES)
    stream = spark.readStream.schema(PROBES).option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_snapshots(stream, base, state, ["scan_ts", "probe_id"], buckets=16).awaitTermination()
    sizes = [len(x) for x in opened]
    # this session's and the last one's folders of three hosts for the rows, this session's for what was compared
    assert sizes == [3] + 19 * [6, 3]
    columns = ["scan_session_id", "host", "url_key", "probe_id", "url_status"]
    wanted = D.diff_every_session(with_diff_keys(spark.createDataFrame(rows, PROBES)), ["scan_ts", "probe_id"]).select(*columns)
    got = streams.read_snapshots(spark, base).select(*columns)
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
    index = spark.read.parquet(f"{base}/index")
    assert index.where("generation = 4 and cycle = -1").count() == 16 * 3 and index.agg({"generation": "max"}).first()[0] == 4


def test_superseded_versions_are_deleted(spark, tmp_path):
    source, state, base = str(tmp_path / "src"), str(tmp_path / "state"), f"file:{tmp_path}/cycles"
    for n in range(4):
        feed(spark, source, [probe(n, f"http://a/{n}", 1), probe(10 + n, f"http://b/{n}", 2)], PROBES)
    stream = spark.readStream.schema(PROBES).option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_snapshots(stream, base, state, ["scan_ts", "probe_id"]).awaitTermination()
    columns = ["scan_session_id", "host", "url_key", "probe_id", "url_status"]
    before = sorted(map(tuple, streams.read_snapshots(spark, base).select(*columns).collect()))
    assert len(before) == 8 and streams.vacuum_snapshots(spark, base) == 2 * 2 and streams.vacuum_snapshots(spark, base) == 0
    spark.catalog.refreshByPath(f"{base}/diff")
    assert sorted(map(tuple, streams.read_snapshots(spark, base).select(*columns).collect())) == before


def test_a_row_is_written_once(spark, tmp_path):
    """Compared keys lie apart from the rows, those without a URL too; rows of an unfinished batch are not shown."""
    source, state, base = str(tmp_path / "src"), str(tmp_path / "state"), f"file:{tmp_path}/cycles"
    order, columns = ["scan_ts", "probe_id"], ["scan_session_id", "host", "url_key", "probe_id", "url_status"]
    rows = [r for rows in ARRIVALS for r in rows] + [probe(9, None, 1), probe(10, None, 1), probe(11, None, 2), (12, "http://a/1", None, 200, None, None, None)]
    for part in (rows[11:], rows[:9:2], rows[1:9:2] + rows[9:]):
        streams.stream_snapshots(feed(spark, source, part, PROBES), base, state, order).awaitTermination()
    whole = with_diff_keys(spark.createDataFrame(rows[:11], PROBES))
    wanted = D.diff_every_session(whole, order)
    got = streams.read_snapshots(spark, base)
    assert set(got.columns) == set(wanted.columns)
    got, wanted = got.select(*columns), wanted.select(*columns)
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()
    stored = spark.read.parquet(f"{base}/diff")
    assert set(stored.columns) == {"host", "url_key", "url_status", "seen_in", "scan_session_id", "host_bucket", "at"}
    assert spark.read.parquet(f"{base}/rows").count() == 11
    unfinished = spark.read.parquet(f"{base}/rows").where("probe_id = 1").withColumn("probe_id", F.lit(99).cast("bigint")).withColumn("cycle", F.lit(7))
    unfinished.write.mode("append").partitionBy("scan_session_id", "host_bucket", "cycle").parquet(f"{base}/rows")
    spark.catalog.refreshByPath(f"{base}/rows")
    assert streams.read_snapshots(spark, base).where("probe_id = 99").isEmpty()


def test_inventory_is_folded(spark, monkeypatch):
    monkeypatch.setattr(streams, "GENERATION", 2)
    source, base, state = (scratch_path(spark, n) for n in ("src", "inv", "state"))
    rows = [r for rows in ARRIVALS for r in rows] * 2
    for one in rows[:7]:
        streams.stream_url_inventory(feed(spark, source, [one], PROBES), base, state).awaitTermination()
    parts = spark.read.parquet(base)
    assert parts.agg({"generation": "max"}).first()[0] == 3
    assert parts.where("generation = 3").count() <= 2 + len({(r[1], r[5]) for r in rows})
    whole = D.url_inventory(with_diff_keys(spark.createDataFrame(rows[:7], PROBES)))
    got = streams.read_inventory(spark, base)
    assert whole.exceptAll(got).isEmpty() and got.exceptAll(whole).isEmpty()


def test_progress(spark):
    source, out, state = (scratch_path(spark, n) for n in ("src", "out", "state"))
    counters = streams.ProgressCounters("progress")
    spark.streams.addListener(counters)
    drain(streams.stream_progress(feed(spark, source, ARRIVALS[0], PROBES)), spark, out, state)
    streams.wait_for_events(spark)
    spark.streams.removeListener(counters)
    assert counters.totals == {"n_processed": 3, "n_errors": 2}
