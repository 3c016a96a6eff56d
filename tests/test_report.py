import datetime as dt

import pytest
from pyspark.sql import functions as F

from hostledger.operators import content as C
from hostledger.operators import report as R
from hostledger.operators import summary as S
from hostledger.operators import targets as T
from hostledger.operators.numbering import number_rows
from hostledger.operators.probes import clean_probes
from hostledger.session import scratch_path
from hostledger.sources import exports

AT = dt.datetime(2024, 1, 1, 2, 3, 4)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            (1, "http://a/1", None, 200, None, "text/html", ["nginx", "nginx"], "T", 5, "new", AT),
            (2, "http://a/2", "http://b/2", 301, None, None, None, "", 3, "existing", AT),
            (3, "http://c/3", None, None, "boom", None, [], None, 9, "", AT),
            (4, "http://d/4", None, 500, "late", None, [], None, 1, None, AT),
            (5, "http://e/5", None, 504, None, None, [], None, 7, "old", AT),
        ],
        "id int, input_url string, final_url string, status_code int, error string, content_type string,"
        " technologies array<string>, title string, content_length bigint, url_status string, scan_ts timestamp",
    )


def test_facets(rows):
    got = {(r["facet"], r["value"]): r["n_rows"] for r in R.facets(rows).collect()}
    assert got == {
        ("host", "a"): 2, ("host", "d"): 1, ("status_code", "200"): 1, ("status_code", "301"): 1,
        ("status_code", "500"): 1, ("status_code", "504"): 1, ("content_type", "text/html"): 1, ("technology", "nginx"): 1,
        ("url_status", "new"): 1, ("url_status", "existing"): 1, ("url_status", "old"): 1,
    }


def test_dashboard(rows, spark):
    assert R.dashboard_stats(rows).first().asDict() == {
        "total": 5, "success_count": 2, "error_count": 3, "success_rate": 40, "error_rate": 60, "unique_hosts": 5,
        "unique_technologies": 1,
    }
    assert R.dashboard_stats(rows.limit(0)).first()["success_rate"] == 0
    half = rows.where("id in (1, 3)").union(rows.where("id in (1, 3)")).union(rows.where("id = 1")).union(
        rows.where("id in (3, 4, 5)")
    )
    assert R.dashboard_stats(half).first()["success_rate"] == 38  # 37.5


def test_views_and_distributions(rows):
    view = {r["input_url"]: r for r in R.to_report_view(rows).collect()}
    assert view["http://a/1"]["is_success"] and view["http://a/1"]["has_technologies"]
    assert not view["http://d/4"]["is_success"] and view["http://d/4"]["timestamp"] == "2024-01-01 02:03:04 UTC"
    assert {tuple(r) for r in R.diff_distribution(rows).collect()} == {("new", 1), ("existing", 1), ("old", 1), ("unknown", 2)}
    assert {tuple(r) for r in R.status_distribution(rows).collect()} == {
        ("2xx Success", 1), ("3xx Redirect", 1), ("5xx Server Error", 2), ("Other", 1)}


def test_search(rows):
    ids = lambda **k: [r["id"] for r in R.search_report(rows, sort=["id"], **k).collect()]
    assert ids(text="B/2") == [2]
    assert ids(one_of={"status_code": [200, 504]}) == [1, 5]
    assert ids(technologies=["nginx", "x"]) == [1]
    assert ids(contains={"input_url": "/3"}) == [3]
    assert ids(page=1, page_size=2) == [3, 4]
    with pytest.raises(ValueError):
        R.search_report(rows, page=0)


def test_parts_and_batches(spark):
    df = spark.range(0, 2500, 1, 5).withColumn("key", F.xxhash64("id"))
    order = [r["id"] for r in df.orderBy("key", "id").collect()]
    numbered = number_rows(df, ["key", "id"], total="n").orderBy("rn").collect()
    assert [r["id"] for r in numbered] == order and [r["rn"] for r in numbered] == list(range(1, 2501))
    assert numbered[0]["n"] == 2500
    parts = R.report_parts(df, ["key", "id"])
    assert {tuple(r) for r in parts.select("part", "n_parts", "part_info", "part_name").distinct().collect()} == {
        (i, 3, f"Part {i} of 3", f"report-part{i}") for i in (1, 2, 3)}
    assert {r["count"] for r in parts.groupBy("part").count().collect()} == {1000, 500}
    assert R.report_parts(df, ["id"], max_rows=0).select("part", "part_info").distinct().collect() == [(1, "")]
    assert R.report_parts(df, ["id"], max_rows=-5).agg(F.max("part")).first()[0] == 3
    for n, b, batches in ((3, 5, 1), (5, 2, 3), (6, 3, 2)):
        got = S.assign_batches(spark.range(n), ["id"], size=b, threshold=0)
        assert got.agg(F.countDistinct("batch")).first()[0] == batches
        assert [r["batch"] for r in got.orderBy("id").collect()] == [i // b for i in range(n)]
    assert S.assign_batches(spark.range(0), ["id"], size=3, threshold=0).count() == 0
    assert S.assign_batches(spark.range(10), ["id"], size=3).agg(F.max("batch")).first()[0] == 0
    assert tuple(S.batching_stats(spark.range(1001)).first()) == (1001, 6, 1)
    assert tuple(S.batching_stats(spark.range(999)).first()) == (999, 1, 999)


def test_summaries(spark):
    bad = spark.createDataFrame(
        [("s", "f", "m", "OK", 1, 1, 0, 0.0), ("", None, "m", "", -1, 1, -2, -1.0)],
        "scan_session_id string, target_source string, scan_mode string, status string, total_targets int,"
        " successful_probes int, failed_probes int, duration_s double",
    )
    good, broken = [r["violations"] for r in S.validate_summary(bad).orderBy("total_targets", ascending=False).collect()]
    assert good == [] and len(broken) == 6
    status = lambda e, m: spark.range(1).select(
        S.run_status(F.lit(e).cast("string"), F.lit(m).cast("array<string>") if m is not None else F.lit(None).cast("array<string>"))
    ).first()[0]
    assert status(None, None) == "COMPLETED" and status(None, ["slow"]) == "PARTIAL_COMPLETE"
    assert status("x", ["slow"]) == "FAILED" and status("x", ["Operation Interrupted"]) == "INTERRUPTED"
    batches = spark.createDataFrame(
        [("p", 0, 5, True, False, None, ["a", "b"]), ("p", 1, 7, False, True, None, None), ("q", 0, 1, False, True, None, []),
         ("r", 0, 1, True, False, "e", [])],
        "parent_session string, batch int, total_probed int, processed boolean, interrupted boolean, error string,"
        " error_messages array<string>",
    )
    merged = {r["parent_session"]: r for r in S.merge_summaries(batches).collect()}
    assert (merged["p"]["total_probed"], merged["p"]["n_errors"], merged["p"]["status"]) == (12, 2, "PARTIAL_COMPLETE")
    assert merged["q"]["status"] == "FAILED" and merged["r"]["status"] == "FAILED"
    assert [tuple(r) for r in S.merged_errors(batches).collect()] == [("p", 0, 0, "a"), ("p", 0, 1, "b")]


def test_top_errors(spark):
    text = lambda rows, **k: [r["line"] for r in S.top_errors(
        spark.createDataFrame([(r,) for r in rows], "error string"), **k).orderBy("rank").collect()]
    assert text(["one"]) == ["one"]
    assert text(["b", "a", "b", ""]) == ["1. b", "2. a"]
    many = [f"{i:02d}" + "z" * 50 for i in range(20)]
    lines = text(many, max_length=200)
    assert lines[:3] == [f"{i + 1}. {many[i]}" for i in range(3)] and lines[3:] == ["... and 17 more errors"]
    first = text(["w" * 140, "v"], max_length=100)
    assert first[0] == ("1. v") and first[1] == "... and 1 more errors"
    assert text(["w" * 140], max_length=100) == ["w" * 47 + "..."]


def test_top_errors_reads_its_rows_once(spark):
    errors = spark.range(3000).select(F.concat(F.lit("error "), (F.col("id") % 900).cast("string")).alias("error"))
    top = S.top_errors(errors)
    lines = [r["line"] for r in sorted(top.collect(), key=lambda r: r["rank"])]
    assert lines[:3] == ["1. error 0", "2. error 1", "3. error 10"]
    ran = top._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("Range (") == 1


def test_history(spark):
    log = spark.createDataFrame(
        [("s1", "STARTED", AT, None), ("s1", "COMPLETED", AT, "r.html"), ("s2", "STARTED", AT.replace(day=2), None)],
        "scan_session_id string, status string, event_ts timestamp, report_path string",
    )
    history = {r["scan_session_id"]: r for r in S.scan_history(log).collect()}
    assert history["s1"]["status"] == "COMPLETED" and history["s1"]["report_path"] == "r.html"
    assert history["s2"]["status"] == "STARTED" and history["s2"]["end_ts"] is None
    assert S.last_completed_scan(S.scan_history(log)).first()[0] == AT
    assert S.last_completed_scan(S.scan_history(log).limit(0)).first()[0] is None


def test_targets_file(spark):
    path = scratch_path(spark, "test-targets")
    spark.createDataFrame([("b.com",), ("",), (" http://A.com ",), ("b.com",)], "v string").coalesce(1).write.text(path)
    got = T.read_targets(spark, path).orderBy("pos").collect()
    assert [r["url"] for r in got] == ["https://b.com", "http://a.com", "https://b.com"]
    assert tuple(T.target_report(T.read_target_lines(spark, path)).first()) == (4, 3, 1)


def test_exports(spark, rows):
    path = scratch_path(spark, "test-export")
    exports.export_rows(rows, path, "json", max_rows_per_file=2)
    assert spark.read.json(path).count() == 5
    with pytest.raises(ValueError):
        exports.export_rows(rows, path, "xml")
    exports.write_parts(R.report_parts(rows.select("id"), ["id"], max_rows=2), path + "-parts")
    assert sorted(r["count"] for r in spark.read.json(path + "-parts").groupBy("part").count().collect()) == [1, 2, 2]


def test_clean_probes_keeps_broken_rows(spark):
    raw = spark.createDataFrame([(1, "??", {"A": ["x", "y"]}, ["t"], "ASx")],
                                "id int, response_time string, response_headers map<string,array<string>>, tech array<string>, asn string")
    row = clean_probes(raw).first()
    assert (row["duration_s"], row["headers"], row["asn"], row["technologies"][0]["name"]) == (None, {"A": "x, y"}, None, "t")


def test_content(spark):
    old, new = "a\n  b\nb\n<!-- x -->\nc", "a\nb\nd // why\nd\nc  "
    fetches = spark.createDataFrame(
        [("u", 1, old), ("u", 2, new), ("same", 1, "k"), ("same", 2, "k"), ("gone", 1, "g"), ("fresh", 2, "f")],
        "url string, ts int, content string",
    )
    history = C.content_history(fetches)
    assert {r["url"]: r["change"] for r in C.content_changes(history, 1, 2).collect()} == {
        "u": "changed", "same": "identical", "gone": "deleted", "fresh": "new"}
    assert {r["url"]: tuple(r)[1:] for r in C.line_diff_counts(history, 1, 2).collect()} == {
        "u": (2, 1, False), "same": (0, 0, True)}
    assert C.last_known_record(history).where("url = 'u'").first()["ts"] == 2
    assert C.records_for_url(history, limit=1).count() == 4
    assert C.records_for_url(history, limit=9, url="u").count() == 2
    assert {(r["url"], r["ts"]): r["change"] for r in C.version_changes(history).collect()}[("u", 2)] == "changed"


def test_versions_across_buckets(spark):
    hashes = ["x", "x", "y", "y", "x"]
    fetches = spark.createDataFrame([("u", i, h) for i, h in enumerate(hashes)], "url string, ts int, content string")
    expected = ["new", "identical", "changed", "identical", "changed"]
    for width in (1, 2, 3, 1000):
        rows = C.version_changes(C.content_history(fetches), F.floor(F.col("ts") / width)).orderBy("ts").collect()
        assert [r["change"] for r in rows] == expected
    days = fetches.withColumn("ts", F.timestamp_seconds(F.col("ts") * 40000))
    rows = C.version_changes(C.content_history(days)).orderBy("ts").collect()
    assert [r["change"] for r in rows] == expected
