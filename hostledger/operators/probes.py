"""Probe rows: cleaning, storage form and attachment to discovered URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.probes import flatten_headers, parse_asn, parse_duration_s
from ..functions.urls import effective_url, extract_host, url_key

STORAGE_SCHEMA = T.StructType(
    [
        T.StructField("original_url", T.StringType(), False),
        T.StructField("final_url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("web_server", T.StringType()),
        T.StructField("technologies", T.ArrayType(T.StringType())),
        T.StructField("ip_address", T.ArrayType(T.StringType())),
        T.StructField("root_target_url", T.StringType()),
        T.StructField("probe_error", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("headers_json", T.StringType()),
        T.StructField("diff_status", T.StringType()),
        T.StructField("scan_session_id", T.StringType()),
        T.StructField("scan_timestamp", T.LongType(), False),
        T.StructField("first_seen_timestamp", T.LongType()),
        T.StructField("last_seen_timestamp", T.LongType()),
    ]
)

TECHNOLOGY = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("version", T.StringType()),
     T.StructField("category", T.StringType())]
)

PROBE_SCHEMA = T.StructType(
    [
        T.StructField("input_url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("web_server", T.StringType()),
        T.StructField("technologies", T.ArrayType(TECHNOLOGY)),
        T.StructField("ips", T.ArrayType(T.StringType())),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
        T.StructField("root_target_url", T.StringType()),
        T.StructField("url_status", T.StringType()),
        T.StructField("oldest_scan_timestamp", T.TimestampType()),
    ]
)

NO_RESPONSE = "No response from probe"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that are missing, as nulls."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def _blank_to_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _zero_to_null(name: str, kind: str) -> Column:
    return F.nullif(F.col(name).cast(kind), F.lit(0).cast(kind))


def to_storage_row(
    probes: DataFrame, scan_ts: str = "scan_ts", session: str = "scan_session_id", keep: tuple = ()
) -> DataFrame:
    """Probe rows in the stored form, and the columns ``keep`` as they are."""
    df = conform(probes, PROBE_SCHEMA)
    scanned = F.unix_millis(F.col(scan_ts).cast("timestamp"))
    first_seen = F.coalesce(F.unix_millis(F.col("oldest_scan_timestamp").cast("timestamp")), scanned)
    no_names = F.array().cast("array<string>")
    return df.select(
        F.col("input_url").alias("original_url"),
        _blank_to_null("final_url").alias("final_url"),
        _zero_to_null("status_code", "int").alias("status_code"),
        _zero_to_null("content_length", "bigint").alias("content_length"),
        _blank_to_null("content_type").alias("content_type"),
        _blank_to_null("title").alias("title"),
        _blank_to_null("web_server").alias("web_server"),
        F.coalesce(F.transform("technologies", lambda t: t["name"]), no_names).alias("technologies"),
        F.coalesce("ips", no_names).alias("ip_address"),
        _blank_to_null("root_target_url").alias("root_target_url"),
        _blank_to_null("error").alias("probe_error"),
        _blank_to_null("method").alias("method"),
        # keys sorted, so that equal headers give equal text
        F.when(
            F.size("headers") > 0,
            F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers")))),
        ).alias("headers_json"),
        _blank_to_null("url_status").alias("diff_status"),
        _blank_to_null(session).alias("scan_session_id"),
        scanned.alias("scan_timestamp"),
        first_seen.alias("first_seen_timestamp"),
        scanned.alias("last_seen_timestamp"),
        *keep,
    )


def from_storage_row(stored: DataFrame) -> DataFrame:
    """Probe rows from the stored form. Broken header text gives null headers; the row stays."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return stored.select(
        F.col("original_url").alias("input_url"),
        text("final_url"),
        text("method"),
        F.timestamp_millis("last_seen_timestamp").alias("timestamp"),
        F.coalesce("probe_error", F.lit("")).alias("error"),
        text("root_target_url"),
        F.coalesce("status_code", F.lit(0)).alias("status_code"),
        F.coalesce("content_length", F.lit(0).cast("bigint")).alias("content_length"),
        text("content_type"),
        F.from_json("headers_json", T.MapType(T.StringType(), T.StringType())).alias("headers"),
        text("title"),
        text("web_server"),
        F.col("ip_address").alias("ips"),
        F.transform(
            "technologies",
            lambda n: F.struct(
                n.alias("name"), F.lit(None).cast("string").alias("version"),
                F.lit(None).cast("string").alias("category"),
            ),
        ).alias("technologies"),
        F.coalesce("diff_status", F.lit("")).alias("url_status"),
        F.timestamp_millis("first_seen_timestamp").alias("oldest_scan_timestamp"),
        "scan_session_id",
    )


def clean_probes(
    raw: DataFrame,
    response_time: str = "response_time",
    response_headers: str = "response_headers",
    tech: str = "tech",
    asn: str = "asn",
    addresses: str = "a",
) -> DataFrame:
    """Typed probe rows from a prober's raw rows; what cannot be read becomes null, no row is lost."""
    given = set(raw.columns)
    used = {response_time, response_headers, tech, asn, addresses}
    out = [F.col(c) for c in raw.columns if c not in used]
    if response_time in given:
        out.append(parse_duration_s(response_time).alias("duration_s"))
    if response_headers in given:
        out.append(flatten_headers(response_headers).alias("headers"))
    if tech in given:
        blank = F.lit(None).cast("string")
        out.append(
            F.transform(
                tech, lambda n: F.struct(n.alias("name"), blank.alias("version"), blank.alias("category"))
            ).alias("technologies")
        )
    if asn in given:
        out.append(parse_asn(asn).alias("asn"))
    if addresses in given:
        out.append(F.col(addresses).alias("ips"))
    return raw.select(*out)


def with_host(probes: DataFrame, url: str = "input_url") -> DataFrame:
    """Add ``host``, the key rows are grouped by; ``unknown`` where the URL has none."""
    return probes.withColumn("host", F.coalesce(extract_host(url), F.lit("unknown")))


def with_diff_keys(
    probes: DataFrame, normalize: bool = False, case_sensitive: bool = True
) -> DataFrame:
    """Add ``host`` and ``url_key``, which two snapshots are compared by."""
    key = url_key(effective_url("final_url", "input_url"), normalize, case_sensitive)
    return with_host(probes).withColumn("url_key", key)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. All but one row per key and task is dropped before the shuffle."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")


def attach_probes(
    discovered: DataFrame,
    probes: DataFrame,
    order: list[str],
    root_targets: DataFrame | None = None,
    url: str = "url",
) -> DataFrame:
    """Each discovered URL with its last probe row, or with an error where it has none.

    ``root_targets`` (url, root_target) sets ``root_target_url``.
    """
    last = latest_per_key(probes, ["input_url"], order)
    carried = [c for c in last.columns if c not in ("input_url", "error", "root_target_url")]
    wanted = discovered.select(F.col(url).alias("input_url"))
    joined = wanted.join(last.withColumn("_probed", F.lit(True)), "input_url", "left")
    error = F.when(F.col("_probed").isNull(), F.lit(NO_RESPONSE)).otherwise(
        F.col("error") if "error" in last.columns else F.lit(None).cast("string")
    )
    out = joined.select("input_url", *carried, error.alias("error"))
    if root_targets is None:
        return out
    roots = root_targets.select(F.col("url").alias("input_url"), F.col("root_target").alias("root_target_url"))
    return out.join(roots, "input_url", "left")
