"""Queries of scripts, rule tables, sketches, indexes and paging; their SQL is in ``features_sql``."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from hostledger.functions import urls as U
from hostledger.operators import content as C
from hostledger.operators import editscript as E
from hostledger.operators import hostrules as H
from hostledger.operators import links as L
from hostledger.operators import sketches as K
from hostledger.session import scratch_path
from hostledger.sources import snapshots

from . import fixtures as fx


def edited_contents(spark, sf) -> DataFrame:
    """Two versions of every document with numbered lines, as (url, ts, content).

    In the second one, lines went, came or were edited at fixed places, and the first fifth of a document of ten lines or
    more moved to its end.
    """
    d = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), "doc_id",
        F.transform(F.split("text", "\n", -1), lambda x, k: F.concat(k.cast("string"), F.lit(": "), x)).alias("lines"),
    )

    def edited(line: Column, k: Column) -> Column:
        own = F.when(k % 7 == 3, F.array().cast("array<string>")).when(k % 11 == 5, F.array(F.concat(line, F.lit(" (edited)")))).otherwise(F.array(line))
        return F.struct(k.alias("k"), F.concat(own, F.when(k % 5 == 2, F.array(F.concat(F.lit("new "), k.cast("string")))).otherwise(F.array().cast("array<string>"))).alias("made"))

    n = F.size("lines")
    moved = F.when(n >= 10, F.floor(n / 5)).otherwise(0)
    pieces = d.select("url", "doc_id", "lines", F.transform("lines", edited).alias("pieces"), moved.alias("moved"))
    flat = lambda keep: F.flatten(F.transform(F.filter("pieces", keep), lambda p: p["made"]))
    later = F.concat(flat(lambda p: p["k"] >= F.col("moved")), flat(lambda p: p["k"] < F.col("moved")))
    first = pieces.where("doc_id % 10 <> 9").select("url", F.lit(1).alias("ts"), F.array_join("lines", "\n").alias("content"))
    second = pieces.where("doc_id % 10 <> 8").select("url", F.lit(2).alias("ts"), F.array_join(later, "\n").alias("content"))
    return first.union(second)


def line_edit_script(spark, sf):
    return E.line_edit_script(C.content_history(edited_contents(spark, sf)), 1, 2, E.plain_lines)


def edit_segments(spark, sf):
    return E.edit_segments(line_edit_script(spark, sf))


def edit_summary(spark, sf):
    """Over normal lines: blanks and comments do not count."""
    return E.edit_summary(E.line_edit_script(C.content_history(fx.contents(spark, sf)), 1, 2))


def edit_replay(spark, sf):
    """Both versions of every page that changed, rebuilt from its script."""
    script = E.line_edit_script(C.content_history(fx.contents(spark, sf)), 1, 2, E.plain_lines, one_sided=False)
    rebuilt = E.replayed(script)
    return rebuilt.select("url", F.sha2("old_text", 256).alias("old_hash"), F.sha2("new_text", 256).alias("new_hash"))


# ---- host rules --------------------------------------------------------------------------------


def host_rules(spark, sf) -> DataFrame:
    """Rules made from the hosts of all pages: a blocked domain, exceptions from it, blocked hosts and subdomain parts."""
    hosts = fx.pages(spark, sf).select("page_id", U.extract_host("url").alias("host"))
    one = hosts.select(
        F.when(F.col("page_id") % 4 == 1, "allow").when(F.col("page_id") % 4 == 2, "block").when(F.col("page_id") % 25 == 4, "subdomain").alias("kind"),
        F.when(F.col("page_id") % 4 != 0, F.upper("host")).otherwise(F.regexp_replace("host", r"\.example\.[a-z]+$", "")).alias("value"),
    )
    return one.where("kind is not null").union(hosts.select(F.lit("block"), F.lit("example.net")).limit(1)).union(
        hosts.where("page_id % 4 = 3").select(F.lit("block"), F.regexp_replace("host", "^.*(example)[.](org)$", "$2.$1"))
    )


def in_scope_host_rules(spark, sf):
    hosts = fx.url_variants(spark, sf).select(U.extract_host("url").alias("host"))
    return H.judge_hosts(hosts, host_rules(spark, sf))


def discovered_by_rules(spark, sf):
    links = L.extract_links(fx.pages(spark, sf))
    scope = {"disallowed_subdomains": ("spam-farm", "blog.ththan"), "rules": host_rules(spark, sf)}
    return L.discovered_urls(links, fx.seeds(spark, sf), scope=scope)


# ---- sketches ----------------------------------------------------------------------------------


def _days_before_last(spark, sf, days: int) -> str:
    return str(datetime.date.fromisoformat(fx.current_session(spark, sf)) - datetime.timedelta(days=days))


def _sketch_table(spark, sf) -> DataFrame:
    """Sketches of all sessions, stored in two runs; the second one reads the probes of new sessions alone."""
    base = scratch_path(spark, "sketches")
    probes = fx.probes(spark, sf)
    K.write_sketches(probes.where(F.col("scan_session_id") <= _days_before_last(spark, sf, 15)), base)
    K.write_sketches(probes, base)
    return K.stored(spark, base)


def dashboard_sketch(spark, sf):
    return K.dashboard_sketch(_sketch_table(spark, sf))


def dashboard_sketch_by_session(spark, sf):
    rows = K.dashboard_sketch(_sketch_table(spark, sf), "session")
    return rows.select(F.col("session").cast("string").alias("scan_session_id"), "total", "success_count", "unique_hosts", "unique_urls", "unique_technologies")


def probe_errors(spark, sf) -> DataFrame:
    """Error messages by session, made from the status of every probe row, as (scan_session_id, message)."""
    host = F.regexp_extract("input_url", "^https?://([^/?#:]+)", 1)
    status = F.coalesce(F.col("status_code").cast("string"), F.lit("no status"))
    return fx.probes(spark, sf).select("scan_session_id", F.concat(F.lit("probe of "), host, F.lit(" gave "), status, F.lit("\n at loop")).alias("message"))


def top_errors_between(spark, sf):
    """The most frequent errors of the twenty days that end five days before the last session, from stored sketches."""
    base = scratch_path(spark, "error-sketches")
    K.write_error_sketches(probe_errors(spark, sf), base, "scan_session_id", "message")
    table = K.within(K.stored(spark, base), _days_before_last(spark, sf, 24), _days_before_last(spark, sf, 5))
    return K.top_errors_between(table, k=20)


# ---- host and session index --------------------------------------------------------------------


def _snapshot_table(spark, sf) -> str:
    from .queries import stored_rows

    base = scratch_path(spark, "indexed")
    snapshots.write_snapshot(stored_rows(spark, sf), base)
    return base


def host_sessions(spark, sf):
    """The index after the last session was written once more."""
    base = _snapshot_table(spark, sf)
    snapshots.write_snapshot(snapshots.read_snapshot(spark, base, session=fx.current_session(spark, sf)), base)
    return snapshots.host_sessions(spark, base).select("host", "scan_session_id", "n_rows")


def previous_snapshot_stored(spark, sf):
    base = _snapshot_table(spark, sf)
    rows = snapshots.read_previous_snapshot(spark, base, fx.current_session(spark, sf))
    return rows.select("original_url", "host", "scan_session_id", "scan_timestamp")


def snapshot_page(spark, sf):
    """The third page by its position, and the one after its last row."""
    base = _snapshot_table(spark, sf)
    page = snapshots.snapshot_page(spark, base, 25, 50).orderBy(*snapshots.PAGE_KEY)
    last = page.collect()[-1].asDict()
    both = page.unionByName(snapshots.snapshot_page_after(spark, base, 25, last))
    return both.select("scan_session_id", "host", "original_url", "scan_timestamp", F.lit(snapshots.snapshot_total(spark, base)).cast("long").alias("n_total"))


def queries():
    return {
        run.__name__: run
        for run in (
            line_edit_script, edit_segments, edit_summary, edit_replay,
            in_scope_host_rules, discovered_by_rules,
            dashboard_sketch, dashboard_sketch_by_session, top_errors_between,
            host_sessions, previous_snapshot_stored, snapshot_page,
        )
    }
