"""The three jobs end to end; tables that several steps start from are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.diff import report_rows, url_diff
from ..operators.graph import root_target
from ..operators.links import discovered_urls, extract_links, link_edges, mark_scope
from ..operators.preprocess import preprocess_urls
from ..operators.probes import attach_probes, to_storage_row, with_diff_keys
from ..operators.report import (
    DEFAULT_PART_ROWS,
    dashboard_stats,
    diff_distribution,
    facets,
    report_parts,
    status_distribution,
    to_report_view,
)
from ..operators.targets import parse_targets, seed_hosts
from ..session import cut_lineage
from ..sources.snapshots import write_snapshot


def inventory_scan(
    lines: DataFrame, pages: DataFrame, probes: DataFrame, order: list[str], max_similar: int = 1
) -> DataFrame:
    """Seeds → preprocessed seeds → URLs found on stored pages → their probe rows and root targets."""
    targets = preprocess_urls(parse_targets(lines), max_similar=max_similar)
    seeds = cut_lineage(targets.select("pos", F.col("norm").alias("url")))
    hosts = seed_hosts(seeds)
    # the pages are read once; three steps below start from the written links
    links = cut_lineage(extract_links(pages))
    found = cut_lineage(discovered_urls(links, seeds, max_similar=max_similar, scope={"seed_hosts": hosts}))
    inside = mark_scope(links, "link", seed_hosts=hosts).where("in_scope")
    roots = root_target(found, link_edges(inside), seeds)
    return attach_probes(found, probes, order, roots)


def diff_and_store(
    current: DataFrame, previous: DataFrame, base: str, order: list[str], codec: str = "zstd",
    scan_ts: str = "scan_ts", session: str = "scan_session_id",
) -> DataFrame:
    """Compare, store the current rows with their status, and return current and vanished rows.

    All hosts go through one job.
    """
    # the previous snapshot is looked up once, then compared by key and read for its vanished rows
    previous = cut_lineage(with_diff_keys(previous))
    diff = cut_lineage(url_diff(with_diff_keys(current), previous, order))
    stored = to_storage_row(diff.where("url_status <> 'old'"), scan_ts, session, keep=("host",))
    write_snapshot(stored, base, codec)
    return diff


def report(
    diff: DataFrame, order: list[str], max_rows: int = DEFAULT_PART_ROWS, ts: str = "scan_ts"
) -> dict[str, DataFrame]:
    """The tables of a report. The compared rows are written once and read by each of them."""
    rows = cut_lineage(report_rows(diff))
    view = to_report_view(rows, ts)
    return {
        "parts": report_parts(view, order, max_rows),
        "facets": facets(rows),
        "stats": dashboard_stats(rows),
        "status": status_distribution(rows),
        "diff": diff_distribution(rows),
    }
