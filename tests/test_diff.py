import datetime as dt

import pytest
from pyspark.sql import functions as F

from hostledger.operators import diff as D
from hostledger.operators import probes as PR
from hostledger.plans import pipelines
from hostledger.session import scratch_path
from hostledger.sources import snapshots

COLUMNS = "probe_id bigint, input_url string, final_url string, status_code int, scan_session_id string, scan_ts timestamp"
ORDER = ["scan_ts", "probe_id"]


def rows(spark, *items):
    return spark.createDataFrame(
        [(i, u, f, s, d, dt.datetime(2024, 1, int(d[-2:]), 0, i % 60)) for i, u, f, s, d in items], COLUMNS
    )


@pytest.fixture(scope="module")
def probes(spark):
    return PR.with_diff_keys(
        rows(
            spark,
            (1, "http://a/1", None, 200, "2024-01-01"),
            (2, "http://a/2", "", 200, "2024-01-02"),
            (3, "http://a/gone", None, 404, "2024-01-02"),
            (4, "http://a/gone", None, 500, "2024-01-02"),
            (5, "http://b/old", None, 200, "2024-01-02"),
            (6, "http://a/2", None, 200, "2024-01-03"),
            (7, "http://a/2", None, 200, "2024-01-03"),
            (8, "http://a/x", "http://a/2", 200, "2024-01-03"),
            (9, "http://a/1", None, 200, "2024-01-03"),
            (10, "", None, 200, "2024-01-03"),
        )
    )


def statuses(diff):
    return sorted((r["probe_id"], r["url_status"]) for r in diff.collect())


def test_diff_against_the_hosts_last_session(probes):
    diff = D.diff_sessions(probes, "2024-01-03", ORDER)
    # session 2 of host a is its previous one: /1 counts as new, the last row of /gone is old
    assert statuses(diff) == [
        (4, "old"), (6, "existing"), (7, "existing"), (8, "existing"), (9, "new"), (10, "new"),
    ]
    gone = diff.where("url_status = 'old'").first()
    assert (gone["status_code"], gone["input_url"]) == (500, "http://a/gone")


def test_vanished_hosts_on_request(probes):
    diff = D.diff_sessions(probes, "2024-01-03", ORDER, include_vanished_hosts=True)
    assert (5, "old") in statuses(diff)


def test_empty_sides(probes):
    none = probes.limit(0)
    assert statuses(D.url_diff(none, none, ORDER)) == []
    assert {s for _, s in statuses(D.url_diff(probes, none, ORDER))} == {"new"}
    assert {s for _, s in statuses(D.url_diff(none, probes, ORDER))} == {"old"}


def test_counts(probes):
    counts = {r["host"]: tuple(r)[1:] for r in D.diff_counts(D.diff_sessions(probes, "2024-01-03", ORDER)).collect()}
    assert counts == {"a": (1, 1, 3, 0), "unknown": (1, 0, 0, 0), None: (2, 1, 3, 0)}
    by_session = {r[0]: tuple(r)[1:] for r in D.diff_counts_by_session(probes).collect()}
    assert by_session["2024-01-03"] == (2, 1, 3)
    assert by_session["2024-01-02"] == (4, 1, 0)


def test_inventory(probes):
    row = D.url_inventory(probes).where("url_key = 'http://a/1'").first()
    assert (row["first_seen"].day, row["last_seen"].day, row["n_sessions"], row["last_status"]) == (1, 3, 2, 200)
    whole = D.url_inventory(probes)
    parts = D.session_inventory(probes.where("probe_id < 7")).unionByName(D.session_inventory(probes.where("probe_id >= 7")))
    merged = D.fold_inventory(D.fold_sessions(parts))
    assert whole.exceptAll(merged).isEmpty() and merged.exceptAll(whole).isEmpty()


def test_hot_key_is_split(spark):
    """One URL owns most current rows: the join with the previous keys is split at run time."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        current = spark.range(0, 60000, 1, 8).select(
            F.lit("h").alias("host"),
            F.when(F.col("id") % 3 != 0, "hot").otherwise(F.col("id").cast("string")).alias("url_key"),
            F.col("id").alias("probe_id"), F.current_timestamp().alias("scan_ts"),
        )
        previous = current.where("probe_id < 30000")
        diff = D.url_diff(current, previous, ORDER)
        counted = diff.groupBy("url_status").agg(F.count("*").alias("n"))
        got = {r["url_status"]: r["n"] for r in counted.collect()}
        assert got == {"existing": 50000, "new": 10000}
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_storage_round_trip(spark):
    schema = (
        "input_url string, final_url string, method string, status_code int, content_length bigint, content_type string,"
        " title string, web_server string, technologies array<struct<name string, version string, category string>>,"
        " ips array<string>, headers map<string,string>, error string, root_target_url string, url_status string,"
        " oldest_scan_timestamp timestamp, scan_ts timestamp, scan_session_id string"
    )
    at, first = dt.datetime(2024, 1, 2, 3, 4, 5, 678000), dt.datetime(2023, 1, 1)
    full = ("http://a", "http://b", "GET", 200, 12, "text/html", "T", "nginx", [("react", "1", "js")], ["1.2.3.4"],
            {"B": "2", "A": "1"}, "", "root", "new", first, at, "s1")
    empty = ("http://e", "", "", 0, 0, "", "", "", None, None, {}, "boom", "", "", None, at, "s1")
    stored = PR.to_storage_row(spark.createDataFrame([full, empty], schema)).orderBy("original_url")
    a, e = stored.collect()
    assert a["headers_json"] == '{"A":"1","B":"2"}' and a["technologies"] == ["react"]
    assert (a["first_seen_timestamp"], a["scan_timestamp"]) == (1672531200000, 1704164645678)
    assert e["first_seen_timestamp"] == e["scan_timestamp"] and e["technologies"] == [] and e["ip_address"] == []
    for name in ("final_url", "status_code", "content_length", "title", "headers_json", "diff_status", "method"):
        assert e[name] is None
    back = {r["input_url"]: r for r in PR.from_storage_row(stored).collect()}
    assert back["http://a"]["headers"] == {"A": "1", "B": "2"} and back["http://a"]["technologies"][0]["name"] == "react"
    assert back["http://e"]["status_code"] == 0 and back["http://e"]["final_url"] == "" and back["http://e"]["headers"] is None
    broken = PR.from_storage_row(stored.withColumn("headers_json", F.lit("{broken"))).collect()
    assert len(broken) == 2 and broken[0]["headers"] is None and broken[0]["input_url"]


def test_snapshot_table(spark, probes):
    base = scratch_path(spark, "test-snapshots")
    assert snapshots.read_snapshot(spark, base, host="a").count() == 0
    stored = PR.to_storage_row(probes, keep=("host",))
    snapshots.write_snapshot(stored, base)
    snapshots.write_snapshot(stored.where("scan_session_id = '2024-01-01'"), base, codec="unheard-of")
    assert snapshots.read_snapshot(spark, base).count() == 10
    one = snapshots.read_snapshot(spark, base, host="b", session="2024-01-02")
    assert [r["root_target_url"] for r in one.collect()] == ["b"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "(scan_session_id" in plan.split("PartitionFilters: [")[1] and "host_bucket" in plan and "EqualTo(host,b)" in plan
    page = snapshots.read_snapshot(spark, base, limit=2, offset=1, total="n").collect()
    assert [(r["original_url"], r["n"]) for r in page] == [("http://a/2", 10), ("http://a/gone", 10)]
    broken = spark.createDataFrame([("no parquet at all",)], "v string")
    broken.coalesce(1).write.text(f"{base}/scan_session_id=2024-01-09/host_bucket=0")
    assert snapshots.read_snapshot(spark, base, skip_broken=True).count() == 10
    with pytest.raises(Exception, match="(?i)parquet"):
        snapshots.read_snapshot(spark, base).collect()
    with pytest.raises(ValueError):
        snapshots.write_snapshot(stored, "")
    assert snapshots.codec_or_default("lz99") == "zstd" and snapshots.codec_or_default("gzip") == "gzip"


def test_hosts_of_a_session_can_be_written_one_by_one(spark, probes):
    base = scratch_path(spark, "test-by-host")
    stored = PR.to_storage_row(probes, keep=("host",))
    hosts = [r[0] for r in stored.select("host").distinct().collect()]
    for host in [*hosts, hosts[0]]:
        snapshots.write_snapshot(stored.where(F.col("host") == host), base)
    columns = ["scan_session_id", "host", "original_url", "scan_timestamp"]
    got = snapshots.read_snapshot(spark, base).select(*columns)
    assert got.exceptAll(stored.select(*columns)).isEmpty() and got.count() == 10
    # what a host no longer has is gone, other hosts stay
    snapshots.write_snapshot(stored.where("host = 'a' and scan_session_id = '2024-01-03'").limit(1), base)
    left = snapshots.read_snapshot(spark, base, session="2024-01-03").groupBy("host").count().collect()
    assert {r["host"]: r["count"] for r in left} == {
        r["host"]: 1 if r["host"] == "a" else r["count"]
        for r in stored.where("scan_session_id = '2024-01-03'").groupBy("host").count().collect()
    }
    for name in ("host", "scan_session_id"):
        with pytest.raises(Exception, match=f"has no {name}"):
            snapshots.write_snapshot(stored.withColumn(name, F.lit("")), base)


def test_every_session_is_compared_with_the_one_before(probes):
    rows = D.diff_every_session(probes, ORDER).collect()
    for session in sorted({r["scan_session_id"] for r in rows}):
        own = sorted((r["probe_id"], r["url_status"]) for r in rows if r["scan_session_id"] == session)
        one = D.diff_sessions(probes, session, ORDER).collect()
        assert own == sorted((r["probe_id"], r["url_status"]) for r in one)


def test_diff_and_store(spark, probes):
    base = scratch_path(spark, "test-diffed")
    raw = probes.drop("host", "url_key")
    diff = pipelines.diff_and_store(
        raw.where("scan_session_id = '2024-01-03'"), raw.where("scan_session_id = '2024-01-02'"), base, ORDER
    )
    assert {s for _, s in statuses(diff)} == {"new", "existing", "old"}
    assert {r[0] for r in snapshots.read_snapshot(spark, base).select("diff_status").collect()} == {"new", "existing"}


def test_attach_probes(spark, probes):
    found = spark.createDataFrame([("http://a/2",), ("http://a/none",)], "url string")
    roots = spark.createDataFrame([("http://a/2", "R")], "url string, root_target string")
    out = {r["input_url"]: r for r in PR.attach_probes(found, probes, ORDER, roots).collect()}
    assert (out["http://a/2"]["probe_id"], out["http://a/2"]["root_target_url"], out["http://a/2"]["error"]) == (7, "R", None)
    assert out["http://a/none"]["error"] == PR.NO_RESPONSE
