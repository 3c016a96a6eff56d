"""The index of hosts and sessions beside a snapshot table: what it holds and what it saves reading."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hostledger.operators import diff as D
from hostledger.operators.probes import to_storage_row, with_diff_keys, with_host
from hostledger.session import scratch_path
from hostledger.sources import snapshots as S

PROBES = "probe_id bigint, input_url string, final_url string, status_code int, error string, scan_session_id string, scan_ts timestamp"


def probe(i, host, day):
    return (i, f"http://{host}.test/{i}", None, 200, None, f"2024-01-{day:02d} 10:00", dt.datetime(2024, 1, day, 0, 0, i % 60))


def stored(spark, rows):
    return to_storage_row(with_host(spark.createDataFrame(rows, PROBES)), keep=("host",))


@pytest.fixture(scope="module")
def history(spark):
    """Twelve days; host h0 is there every day, h1 on even days, h2 on the first day, h3 on the last one."""
    rows = []
    for day in range(1, 13):
        hosts = ["h0"] + ["h1"] * (day % 2 == 0) + ["h2"] * (day == 1) + ["h3"] * (day == 12)
        rows += [probe(100 * day + 10 * k + i, h, day) for k, h in enumerate(hosts) for i in range(3)]
    base = scratch_path(spark, "snapshots")
    S.write_snapshot(stored(spark, rows), base)
    return base, rows


def test_previous_rows_from_their_folders_alone(spark, history):
    base, rows = history
    got = S.read_previous_snapshot(spark, base, "2024-01-12 10:00")
    want = D.previous_snapshot(with_diff_keys(spark.createDataFrame(rows, PROBES)), "2024-01-12 10:00")
    key = lambda df, url: sorted((r[0], r[1]) for r in df.select(url, "scan_session_id").collect())
    assert key(got, "original_url") == key(want, "input_url")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [concat_ws(/" in plan
    folders = got._jdf.queryExecution().optimizedPlan().toString().split("concat_ws(/")[1].split(" IN (")[1].split(")")[0]
    wanted = S.sessions_before(S.host_sessions(spark, base), "2024-01-12 10:00").collect()
    assert set(folders.split(",")) == {f"{r.scan_session_id}/{r.host_bucket}" for r in wanted} and len(wanted) == 2  # of 20 folders
    read = S._stored(spark, base).where(S.in_folders([(r.scan_session_id, r.host_bucket) for r in wanted]))
    assert read.select(F.input_file_name()).distinct().count() == 2
    everything = S.read_previous_snapshot(spark, base, "2024-01-12 10:00", include_vanished_hosts=True)
    assert sorted({r.host for r in everything.select("host").collect()}) == ["h0.test", "h1.test", "h2.test"]


def test_index_follows_writes(spark):
    base = scratch_path(spark, "snapshots")
    index = lambda: sorted((r.host, r.scan_session_id[8:10], r.n_rows) for r in S.host_sessions(spark, base).collect())
    assert index() == []
    S.write_snapshot(stored(spark, [probe(1, "a", 1), probe(2, "a", 1), probe(3, "b", 1), probe(4, "a", 2)]), base)
    assert index() == [("a.test", "01", 2), ("a.test", "02", 1), ("b.test", "01", 1)]
    S.write_snapshot(stored(spark, [probe(5, "a", 1), probe(6, "c", 1)]), base)
    assert index() == [("a.test", "01", 1), ("a.test", "02", 1), ("b.test", "01", 1), ("c.test", "01", 1)]
    counted = S.read_snapshot(spark, base).groupBy("host", "scan_session_id").count()
    assert sorted((r["host"], r["scan_session_id"][8:10], r["count"]) for r in counted.collect()) == index()


def test_a_table_without_an_index_is_indexed_from_its_rows(spark):
    base, bare = (scratch_path(spark, n) for n in ("snapshots", "bare"))
    S.write_snapshot(stored(spark, [probe(1, "a", 1), probe(2, "a", 2), probe(3, "a", 2)]), base)
    spark.read.schema(S.TABLE_SCHEMA).parquet(base).write.partitionBy("scan_session_id", "host_bucket").parquet(bare)
    assert sorted((r.scan_session_id[8:10], r.n_rows) for r in S.host_sessions(spark, bare).collect()) == [("01", 1), ("02", 2)]
    assert S.read_previous_snapshot(spark, bare, "2024-01-02 10:00").count() == 1


def test_no_table_and_no_session_before(spark, history):
    assert S.read_previous_snapshot(spark, scratch_path(spark, "none"), "x").count() == 0
    assert S.read_previous_snapshot(spark, history[0], "2024-01-01 10:00").count() == 0


def keys(rows):
    return [(r.scan_session_id, r.host, r.original_url, r.scan_timestamp, r.row_hash) for r in rows]


def test_pages_laid_end_to_end_are_the_table(spark, history):
    base, rows = history
    total = S.snapshot_total(spark, base)
    assert total == len(rows) == 60
    by_place = [S.snapshot_page(spark, base, 17, at).collect() for at in range(0, total + 17, 17)]
    assert [len(p) for p in by_place] == [17, 17, 17, 9, 0]
    seen = keys([r for p in by_place for r in p])
    assert seen == sorted(seen) and len(set(seen)) == 60
    page, chained = by_place[0], list(by_place[0])
    while page:
        page = S.snapshot_page_after(spark, base, 17, page[-1].asDict()).collect()
        chained += page
    assert keys(chained) == seen


def test_a_page_reads_the_folders_of_its_hosts(spark, history):
    page = S.snapshot_page(spark, history[0], 4, 31)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    folders = plan.split("concat_ws(/")[1].split(" IN (")[1].split(")")[0] if " IN (" in plan.split("concat_ws(/")[1][:90] else plan.split("concat_ws(/")[1].split("= ")[1].split(")")[0]
    assert 1 <= len(folders.split(",")) <= 2 and len(page.collect()) == 4


def test_pages_of_ties_and_of_no_table(spark):
    base = scratch_path(spark, "snapshots")
    same = [probe(7, "a", 1)] * 5 + [probe(8, "a", 1)]
    S.write_snapshot(stored(spark, same), base)
    first = S.snapshot_page(spark, base, 4).collect()
    assert len(first) == 4 and [r.original_url for r in S.snapshot_page(spark, base, 9, 4).collect()] == ["http://a.test/7", "http://a.test/8"]
    assert S.snapshot_page(spark, scratch_path(spark, "none"), 5).count() == 0 and S.snapshot_total(spark, scratch_path(spark, "none")) == 0
