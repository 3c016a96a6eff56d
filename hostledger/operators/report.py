"""Report projection, facets, counters and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.probes import has_facet_host, is_success, status_class
from ..functions.urls import effective_url, extract_host
from .numbering import number_rows

DEFAULT_PART_ROWS = 1000
PAGE_SIZE = 25


def _filled(array: str) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) > 0


def to_report_view(rows: DataFrame, ts: str = "scan_ts") -> DataFrame:
    """The columns a report shows; ``technologies``, ``ips`` and ``cnames`` are arrays of names.

    Columns that ``rows`` does not have are null, their flags false.
    """
    kinds = {
        "title": "string", "web_server": "string", "method": "string", "root_target_url": "string", "url_status": "string",
        "ips": "array<string>", "cnames": "array<string>", "asn": "bigint", "asn_org": "string", "duration_s": "double",
        "headers": "map<string,string>",
    }
    for name, kind in kinds.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select(
        "input_url",
        "final_url",
        "status_code",
        "content_length",
        "content_type",
        "technologies",
        "error",
        *kinds,
        F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM-dd HH:mm:ss 'UTC'").alias("timestamp"),
        is_success("error", "status_code").alias("is_success"),
        _filled("technologies").alias("has_technologies"),
        _filled("ips").alias("has_ips"),
        _filled("cnames").alias("has_cnames"),
        (F.coalesce("asn", F.lit(0)) > 0).alias("has_asn"),
    )


def _column(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def facets(rows: DataFrame) -> DataFrame:
    """Rows per value of each facet, as (facet, value, n_rows), in one pass over the rows."""
    shown = has_facet_host(
        "error", "status_code", _column(rows, "title"), "technologies", "content_type"
    )
    item = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    one = F.array(
        item("host", F.when(shown, extract_host("input_url"))),
        item("status_code", F.when(F.col("status_code") > 0, F.col("status_code").cast("string"))),
        item("content_type", F.col("content_type")),
        item("url_status", _column(rows, "url_status")),
    )
    many = F.transform(
        F.array_distinct(F.coalesce("technologies", F.array().cast("array<string>"))),
        lambda t: item("technology", t),
    )
    return (
        rows.select(F.inline(F.concat(one, many)))
        .where("value <> ''")
        .groupBy("facet", "value")
        .agg(F.count("*").alias("n_rows"))
    )


def dashboard_stats(rows: DataFrame) -> DataFrame:
    """One row of counters. Success looks at the status alone.

    Distinct hosts and technologies are counted exactly: rows, hosts and technologies become items of
    one long table that is combined before its shuffle.
    """
    good = F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    host = extract_host(effective_url("final_url", "input_url"))
    item = lambda kind, value, ok: F.struct(
        F.lit(kind).alias("kind"), value.alias("value"), ok.cast("long").alias("ok")
    )
    items = F.concat(
        F.array(item("row", F.lit(""), good), item("host", host, F.lit(0))),
        F.transform(
            F.coalesce("technologies", F.array().cast("array<string>")), lambda t: item("technology", t, F.lit(0))
        ),
    )
    distinct = (
        rows.select(F.inline(items))
        .where(F.col("value").isNotNull())
        .groupBy("kind", "value")
        .agg(F.count("*").alias("n"), F.sum("ok").alias("ok"))
    )
    zero = F.lit(0).cast("long")
    is_row = F.col("kind") == "row"
    counted = distinct.agg(
        F.coalesce(F.sum(F.when(is_row, F.col("n"))), zero).alias("total"),
        F.coalesce(F.sum(F.when(is_row, F.col("ok"))), zero).alias("success_count"),
        F.count_if(F.col("kind") == "host").alias("unique_hosts"),
        F.count_if(F.col("kind") == "technology").alias("unique_technologies"),
    )
    rate = lambda n: F.when(
        F.col("total") > 0, F.floor(100 * n / F.col("total") + 0.5)
    ).otherwise(0).cast("long")
    errors = F.col("total") - F.col("success_count")
    return counted.select(
        "total",
        "success_count",
        errors.alias("error_count"),
        rate(F.col("success_count")).alias("success_rate"),
        rate(errors).alias("error_rate"),
        "unique_hosts",
        "unique_technologies",
    )


def status_distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy(status_class("status_code").alias("status_class")).agg(F.count("*").alias("n_rows"))


def diff_distribution(rows: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif(F.col("url_status"), F.lit("")), F.lit("unknown"))
    return rows.groupBy(status.alias("url_status")).agg(F.count("*").alias("n_rows"))


def search_report(
    rows: DataFrame,
    text: str | None = None,
    text_columns: Sequence[str] = ("input_url", "final_url", "title", "content_type"),
    contains: dict[str, str] | None = None,
    one_of: dict[str, Sequence] | None = None,
    technologies: Sequence[str] | None = None,
    sort: Sequence[Column | str] | None = None,
    page: int | None = None,
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Rows that pass all filters; with ``page`` (from 0) one page of them in ``sort`` order.

    ``sort`` must be total for stable pages. A page is a top-n, not a sort of everything.
    """
    out = rows
    like = lambda c, piece: F.contains(F.lower(F.col(c).cast("string")), F.lit(piece.lower()))
    if text:
        hit = F.lit(False)
        for c in [c for c in text_columns if c in rows.columns]:
            hit = hit | F.coalesce(like(c, text), F.lit(False))
        out = out.where(hit)
    for name, piece in (contains or {}).items():
        out = out.where(like(name, piece))
    for name, values in (one_of or {}).items():
        out = out.where(F.col(name).isin(list(values)))
    if technologies:
        out = out.where(F.arrays_overlap("technologies", F.array(*[F.lit(t) for t in technologies])))
    if sort:
        out = out.orderBy(*sort)
    if page is not None:
        if not sort:
            raise ValueError("paging needs a sort order")
        out = out.offset(page * page_size).limit(page_size)
    return out


def report_parts(
    rows: DataFrame, order: Sequence[Column | str], max_rows: int = DEFAULT_PART_ROWS, base_name: str = "report"
) -> DataFrame:
    """Add the part each row belongs to. 0 rows per part means one part, less than 0 the default."""
    size = DEFAULT_PART_ROWS if max_rows < 0 else max_rows
    numbered = number_rows(rows, order, "rn", total="_n")
    if size == 0:
        part, parts = F.lit(1).cast("long"), F.lit(1).cast("long")
    else:
        part, parts = F.ceil(F.col("rn") / size), F.ceil(F.col("_n") / size)
    single = parts == 1
    return numbered.select(
        "*",
        part.alias("part"),
        parts.alias("n_parts"),
        F.when(single, F.lit("")).otherwise(F.format_string("Part %d of %d", part, parts)).alias("part_info"),
        F.when(single, F.lit(base_name))
        .otherwise(F.concat(F.lit(f"{base_name}-part"), part.cast("string")))
        .alias("part_name"),
    ).drop("_n")
