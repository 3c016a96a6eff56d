"""Host rules as a table against the keyword form, the longest rule, and the size of the plan."""

import random

import pytest
from pyspark.sql import functions as F

from hostledger.functions.urls import in_scope_host
from hostledger.operators.hostrules import judge_hosts, label_suffixes, with_host_verdict
from hostledger.operators.links import mark_scope

RULES = "kind string, value string"


def verdicts(spark, hosts, rules):
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    return {r.host: (r.rule, r.allowed) for r in judge_hosts(df, spark.createDataFrame(rules, RULES)).collect()}


def test_longest_rule_decides(spark):
    rules = [("block", "shop.test"), ("allow", "eu.shop.test"), ("block", "Old.EU.shop.test "), ("allow", "both.test"), ("block", "both.test"), ("", "x.test"), ("block", " ")]
    got = verdicts(spark, ["shop.test", "a.shop.test", "eu.shop.test", "x.eu.shop.test", "old.eu.shop.test", "b.OLD.eu.shop.test", "bigshop.test", "both.test", "x.test", ""], rules)
    assert got == {
        "shop.test": ("shop.test", False), "a.shop.test": ("shop.test", False), "eu.shop.test": ("eu.shop.test", True), "x.eu.shop.test": ("eu.shop.test", True),
        "old.eu.shop.test": ("old.eu.shop.test", False), "b.old.eu.shop.test": ("old.eu.shop.test", False), "bigshop.test": (None, True), "both.test": ("both.test", False), "x.test": (None, True),
    }


def test_seeds_and_subdomain_parts(spark):
    rules = [("seed", "Shop.test"), ("seed", "cdn.shop.test"), ("subdomain", "cdn"), ("subdomain", "a.b")]
    got = verdicts(spark, ["shop.test", "cdn.shop.test", "www.shop.test", "other.test", "a.b.shop.co.uk"], rules)
    assert {h: allowed for h, (_, allowed) in got.items()} == {
        "shop.test": True, "cdn.shop.test": False, "www.shop.test": False, "other.test": False, "a.b.shop.co.uk": False,
    }
    free = verdicts(spark, ["a.b.shop.co.uk", "b.shop.co.uk", "cdn.test", "x.cdn.test"], rules[2:])
    assert [free[h][1] for h in ("a.b.shop.co.uk", "b.shop.co.uk", "cdn.test", "x.cdn.test")] == [False, True, True, True]


def test_no_rules_no_hosts(spark):
    assert verdicts(spark, ["a.test", "b"], []) == {"a.test": (None, True), "b": (None, True)}
    assert judge_hosts(spark.createDataFrame([], "host string"), spark.createDataFrame([("block", "a")], RULES)).count() == 0


def random_hosts(n, seed):
    draw = random.Random(seed)
    return [".".join(draw.choice(["a", "b", "cc", "www", "x-y"]) for _ in range(draw.randint(1, 5))) + draw.choice([".com", ".test", ".co.uk", ""]) for _ in range(n)]


def test_same_as_the_keyword_form(spark):
    hosts, blocked, parts = random_hosts(800, 1), random_hosts(40, 2), ["a", "a.b", "www", "x-y.cc"]
    seeds = set(random_hosts(200, 1))
    rules = [("block", h) for h in blocked] + [("subdomain", p) for p in parts] + [("seed", h) for h in seeds]
    df = spark.createDataFrame([(h, h in seeds) for h in set(hosts)], "host string, is_seed boolean")
    by_keyword = {r.host: r.ok for r in df.select("host", in_scope_host("host", F.col("is_seed"), blocked, parts).alias("ok")).collect()}
    got = verdicts(spark, hosts, rules)
    assert {h: allowed for h, (_, allowed) in got.items()} == by_keyword and 0 < sum(by_keyword.values()) < len(by_keyword)


def plan_size(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_many_rules_and_the_same_plan(spark, tmp_path):
    def stored(n):
        path = str(tmp_path / str(n))
        spark.range(n).select(F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("kind"), F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".test")).alias("value")).write.parquet(path)
        return spark.read.parquet(path)

    hosts = spark.range(5000).select(F.concat(F.lit("www.h"), (F.col("id") * 40).cast("string"), F.lit(".test")).alias("host"))
    few, many = judge_hosts(hosts, stored(10)), judge_hosts(hosts, stored(100_000))
    assert plan_size(few) == plan_size(many)
    got = {r.host: r.allowed for r in many.collect()}
    assert len(got) == 5000 and all(ok == (not (40 * i < 100_000 and 40 * i % 3)) for i in range(5000) for ok in [got[f"www.h{40 * i}.test"]])


@pytest.mark.parametrize("most, want", [(1, ["c"]), (2, ["b.c", "c"]), (9, ["a.b.c", "b.c", "c"])])
def test_suffixes(apply, most, want):
    assert apply(lambda h: label_suffixes(h, F.lit(most)), ["a.b.c"]) == [want]


def test_rows_keep_their_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "A.test"), (2, "a.test"), (3, None), (4, "b.test"), (5, "")], "id int, h string")
    got = with_host_verdict(df, spark.createDataFrame([("block", "a.test")], RULES), "h", "ok").collect()
    assert sorted((r.id, r.ok) for r in got if r.ok is not None) == [(1, False), (2, False), (4, True)] and len(got) == 5


def test_links_are_marked(spark):
    links = spark.createDataFrame([("http://a.test/x",), ("http://b.a.test/",), ("http://c.test/y.pdf",), ("http://c.test/y",), ("nohost",)], "link string")
    rules = spark.createDataFrame([("block", "a.test"), ("allow", "b.a.test")], RULES)
    got = {r.link: r.in_scope for r in mark_scope(links, rules=rules, disallowed_extensions=(".pdf",)).collect()}
    assert got == {"http://a.test/x": False, "http://b.a.test/": True, "http://c.test/y.pdf": False, "http://c.test/y": True, "nohost": False}
