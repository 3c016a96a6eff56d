"""Input frames the registered queries derive from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostledger.sources.tables import read_table

ORDER = ["scan_ts", "probe_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw target list (pos, raw_url): all page URLs, then untidy repeats, then broken lines."""
    p = pages(spark, sf_dir).select(F.col("page_id").alias("pos"), F.col("url").alias("raw_url"))
    bare = p.where("pos % 5 = 0").select(F.col("pos") + 1000000, F.regexp_replace("raw_url", "^https?://", ""))
    shouted = p.where("pos % 7 = 0").select(
        F.col("pos") + 2000000, F.expr("concat(' ', upper(substr(raw_url, 1, 4)), substr(raw_url, 5), ' ')")
    )
    broken = spark.createDataFrame([(3000000, ""), (3000001, "://invalid-url")], "pos bigint, raw_url string")
    return p.union(bare).union(shouted).union(broken)


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe rows of one session per day, made from all events and all pages."""
    p = pages(spark, sf_dir).select(F.col("page_id").alias("_page"), F.col("url").alias("input_url"))
    e = table(spark, sf_dir, "events").withColumn("_page", F.col("event_id") % F.lit(p.count()))
    i = F.col("event_id")
    return e.join(p, "_page").select(
        i.alias("probe_id"),
        "input_url",
        F.when(i % 7 == 0, F.regexp_replace("input_url", "^http://", "https://")).alias("final_url"),
        F.when(i % 11 == 0, F.lit(None))
        .when(F.col("event_type") == "error", F.when(i % 2 == 0, 500).otherwise(404))
        .when(F.col("event_type") == "signup", 301)
        .otherwise(200)
        .cast("int")
        .alias("status_code"),
        F.when(i % 11 == 0, "No response from probe").alias("error"),
        F.floor(F.abs("value") * 100).cast("bigint").alias("content_length"),
        F.when(i % 3 == 0, "text/html; charset=utf-8").when(i % 3 == 1, "application/json").alias("content_type"),
        F.split(F.when(i % 4 == 0, "nginx,react").when(i % 4 == 1, "apache"), ",").alias("technologies"),
        F.concat(F.lit('{"Server":"s'), (i % 3).cast("string"), F.lit('"}')).alias("headers_json"),
        F.date_format("ts", "yyyy-MM-dd").alias("scan_session_id"),
        F.col("ts").alias("scan_ts"),
    )


def current_session(spark: SparkSession, sf_dir: str) -> str | None:
    """The last session of ``probes``."""
    return table(spark, sf_dir, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd")).first()[0]


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with links in other tags, quotes and spellings in place of their own, as (page_id, url, html)."""
    n = F.col("page_id").cast("string")
    parts = [
        F.lit("<A data-x='href=\"/no\"' HREF = '/p"), n, F.lit("?a=1&#00000038;b=&eacute;'>x</A><!-- <a href=/no> -->"),
        F.lit("<link rel=x href=/&#x0000026;a><img src=\"/caf&eacute;\" srcset='/s"), n, F.lit(".png 1x, /t.png 2x'>"),
        F.lit("<form action='/do?x=1&ampy=2'></form><script>var a='<a href=\"/no\">';</script>"),
        F.regexp_replace("html", "href=", "title="),
    ]
    return pages(spark, sf_dir).select("page_id", "url", F.concat(*parts).alias("html"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree of page URLs below pages 4 to 7 and their parents, as (child, parent)."""
    p = pages(spark, sf_dir)
    up = p.select(F.col("page_id").alias("_up"), F.col("url").alias("parent"))
    down = p.where("page_id >= 8").select(
        F.floor((F.col("page_id") - 1) / 2).cast("bigint").alias("_up"), F.col("url").alias("child")
    )
    return down.join(up, "_up").select("child", "parent")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).where("page_id < 4").select(F.col("page_id").alias("pos"), "url")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every document, as (url, ts, content)."""
    d = table(spark, sf_dir, "documents")
    first = d.where("doc_id % 10 <> 9").select("doc_id", F.lit(1).alias("ts"), F.col("text").alias("content"))
    second = d.where("doc_id % 10 <> 8").select(
        "doc_id",
        F.lit(2).alias("ts"),
        F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\nchanged line"))).otherwise(F.col("text")).alias(
            "content"
        ),
    )
    return first.union(second).withColumn("url", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start and an end event per session; days ending in 0 or 5 failed."""
    spans = probes(spark, sf_dir).groupBy("scan_session_id").agg(
        F.min("scan_ts").alias("first"), F.max("scan_ts").alias("last")
    )
    failed = F.substr("scan_session_id", F.lit(10), F.lit(1)).isin("5", "0")
    return spans.select(
        "scan_session_id",
        F.inline(
            F.array(
                F.struct(F.lit("STARTED").alias("status"), F.col("first").alias("event_ts")),
                F.struct(
                    F.when(failed, F.lit("FAILED")).otherwise(F.lit("COMPLETED")).alias("status"),
                    F.col("last").alias("event_ts"),
                ),
            )
        ),
    )


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten spellings per page URL, good and bad, as (page_id, variant, url)."""
    p = pages(spark, sf_dir).select(
        "page_id",
        "url",
        F.split_part("url", F.lit("#"), F.lit(1)).alias("base"),
        F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root"),
        F.col("page_id").cast("string").alias("id"),
    )
    joint = F.when(F.contains("base", F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    forms = [
        F.col("url"),
        F.concat("base", joint, F.lit("Q=x y&tid="), "id", F.lit("&UTM_Medium=a&b=%C3%A9*")),
        F.concat("base", F.lit("#sec-"), "id"),
        F.concat("root", F.lit(":8080/p"), "id", F.lit("/")),
        F.concat("root", F.lit("/js/js/x"), "id"),
        F.concat("root", F.lit("/ä b/"), "id", F.lit(".css")),
        F.concat("root", F.lit("/%zz/"), "id"),
        F.concat(F.lit("://bad"), "id"),
        F.concat(F.lit("/api/en-GB/deadbeef"), "id", F.lit("/session"), "id", F.lit("?ref=1")),
        F.concat(F.lit("  "), F.upper("root"), F.lit("/A/b/A/b/c"), "id", F.lit("/A ")),
    ]
    return p.select(
        "page_id", F.posexplode(F.array(*forms)).alias("variant", "url")
    )


def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path segments and fragments of all URL variants, as (page_id, variant, item, segment)."""
    v = url_variants(spark, sf_dir)
    return v.select(
        "page_id", "variant", F.posexplode(F.split("url", "[/?#&=]", -1)).alias("item", "segment")
    ).where("segment <> ''")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error messages made from every event and a document text each, as (event_id, message)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    e = table(spark, sf_dir, "events").withColumn("doc_id", F.col("event_id") % F.lit(d.count()))
    long_url = F.concat(F.lit("https://host.example.com/a/"), F.repeat(F.lit("x"), 50), F.lit("/y"))
    return e.join(d, "doc_id").select(
        "event_id",
        F.concat(
            F.col("event_type"),
            F.lit(" in src/app/main.go \n\n at "),
            long_url,
            F.when(F.col("event_id") % 9 == 0, F.lit(" Context Canceled\n")).otherwise(F.lit("\n")),
            F.col("text"),
        ).alias("message"),
    )


def raw_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prober rows in text form, one per event."""
    i = F.col("event_id")
    n = i.cast("string")
    return table(spark, sf_dir, "events").select(
        i.alias("probe_id"),
        F.when(i % 5 == 0, F.concat((i % 90).cast("string"), F.lit("m30s")))
        .when(i % 5 == 1, F.concat(n, F.lit("ms")))
        .when(i % 5 == 2, F.concat(n, F.lit(".5")))
        .when(i % 5 == 3, F.lit("1h2m"))
        .otherwise(F.lit("soon"))
        .alias("response_time"),
        F.create_map(F.lit("Via"), F.array(F.lit("a"), n)).alias("response_headers"),
        F.array(F.lit("nginx"), F.col("event_type")).alias("tech"),
        F.when(i % 3 == 0, F.concat(F.lit("AS"), n)).when(i % 3 == 1, F.lit("ASx")).alias("asn"),
        F.array(F.concat(F.lit("10.0.0."), (i % 255).cast("string"))).alias("a"),
    )
