"""Stored sketches: how near they come, how they combine, and what is read and shuffled."""

import os
import random
from collections import Counter

from pyspark.sql import functions as F

from hostledger.operators import report as R
from hostledger.operators import sketches as K
from hostledger.session import scratch_path


def probes(spark, n=120_000):
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("http://h"), (i % 7001).cast("string"), F.lit(".test/p"), (i % 40_000).cast("string")).alias("input_url"),
        F.when(i % 50 == 0, F.lit("http://other.test/")).alias("final_url"),
        F.when(i % 9 == 0, None).when(i % 5 == 0, 404).otherwise(200).cast("int").alias("status_code"),
        F.when(i % 3 > 0, F.array(F.concat(F.lit("t"), (i % 300).cast("string")), F.lit("all"))).alias("technologies"),
        F.concat(F.lit("2024-02-0"), (1 + i % 6).cast("string")).alias("scan_session_id"),
    )


def near(a, b):
    return abs(a - b) <= 0.03 * b


def test_near_the_exact_counts_and_exact_where_stated(spark):
    df, base = probes(spark), scratch_path(spark, "sketches")
    K.write_sketches(df, base)
    got, exact = K.dashboard_sketch(K.stored(spark, base)).first(), R.dashboard_stats(df).first()
    assert (got.total, got.success_count, got.error_count) == (exact.total, exact.success_count, exact.error_count)
    assert near(got.unique_hosts, exact.unique_hosts) and near(got.unique_technologies, exact.unique_technologies)
    urls = df.select(F.coalesce("final_url", "input_url")).distinct().count()
    assert near(got.unique_urls, urls) and urls > 30_000


def test_sessions_combine_to_the_sketch_of_all_rows(spark):
    df = probes(spark, 30_000)
    by_session = K.session_sketches(df).groupBy().agg(K.distinct_estimate("urls").alias("n")).first().n
    whole = df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.coalesce("final_url", "input_url"), F.lit(K.LG_K))).alias("n")).first().n
    assert near(by_session, whole)
    table = K.session_sketches(df)
    part = K.dashboard_sketch(K.within(table, "2024-02-02", "2024-02-04")).first()
    exact = R.dashboard_stats(df.where("scan_session_id between '2024-02-02' and '2024-02-04'")).first()
    assert part.total == exact.total and near(part.unique_hosts, exact.unique_hosts)


def files(base):
    base = base.removeprefix("file:")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_stored_sessions_are_kept_or_replaced(spark):
    df, base = probes(spark, 3000), scratch_path(spark, "sketches")
    K.write_sketches(df.where("scan_session_id < '2024-02-04'"), base)
    before = files(base)
    K.write_sketches(df, base)
    after = files(base)
    assert before.items() <= after.items() and len({os.path.dirname(f) for f in after}) == 6
    assert K.dashboard_sketch(K.stored(spark, base)).first().total == 3000
    K.write_sketches(df.where("scan_session_id = '2024-02-01'").limit(10), base, only_new=False)
    assert K.dashboard_sketch(K.stored(spark, base)).first().total == 2510


def test_other_folders_are_not_read(spark):
    base = scratch_path(spark, "sketches")
    K.write_sketches(probes(spark, 600), base)
    plan = K.within(K.stored(spark, base), "2024-02-02", "2024-02-02")
    assert len(plan.inputFiles()) == 6 and "PartitionFilters: [isnotnull(session" in plan._jdf.queryExecution().executedPlan().toString()


def test_no_rows(spark):
    empty = probes(spark, 10).limit(0)
    row = K.dashboard_sketch(K.session_sketches(empty)).first()
    assert tuple(row) == (0, 0, 0, 0, 0, 0) and K.stored(spark, scratch_path(spark, "nothing")) is None
    errors = spark.createDataFrame([], "s string, error string")
    assert K.top_errors_between(K.error_sketches(errors, "s")).count() == 0


def errors_of(spark, counts):
    rows = [(f"d{i % 3}", f"error {x}") for x, n in counts.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows + [("d1", None), ("d1", "")], "s string, error string").repartition(4)


def test_frequent_errors_are_exact_while_they_fit(spark):
    counts = {x: 1 + x * 7 % 31 for x in range(200)}
    base = scratch_path(spark, "errors")
    K.write_error_sketches(errors_of(spark, counts), base, "s")
    got = [(r["rank"], r.digest, r.n_errors) for r in K.top_errors_between(K.stored(spark, base), 30).collect()]
    best = sorted(counts.items(), key=lambda c: (-c[1], f"error {c[0]}"))[:30]
    assert got == [(k + 1, f"error {x}", n) for k, (x, n) in enumerate(best)]


def test_frequent_errors_are_within_the_bound_beyond(spark):
    draw = random.Random(3)
    counts = Counter(int(draw.paretovariate(0.8)) for _ in range(20_000))
    table = K.error_sketches(errors_of(spark, counts), "s", tracked=100)
    got = K.top_errors_between(table, 5, tracked=100).collect()
    assert len(counts) > 300
    for r in got:
        assert abs(r.n_errors - counts[int(r.digest.split()[1])]) <= r.bound
    assert {r.digest for r in got} <= {f"error {x}" for x, n in counts.items() if n + 2 * got[0].bound >= sorted(counts.values())[-5]}


def test_digests_are_folded_before_the_shuffle(spark):
    plan = K.error_sketches(errors_of(spark, {1: 2, 2: 3}), "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_approx_top_k_accumulate") + plan.count("partial_approxtopkaccumulate") == 1
    assert plan.count("Exchange hashpartitioning(session") == 1 and "hashpartitioning(digest" not in plan
