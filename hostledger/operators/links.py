"""Links of stored pages, their scope, and the URLs they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import html as H
from ..functions.urlparts import WHITESPACE, UrlParts, drop_parts, each, keep, sql_text, stage, stage_parts
from ..functions.urls import (
    SRCSET_URL,
    can_resolve,
    has_path_trap,
    has_problem_pattern,
    in_scope_host,
    in_scope_path,
    is_invalid_url,
    is_skippable_href,
    normalize_url,
    resolve_parts,
)
from ..session import cut_lineage
from .hostrules import with_host_verdict
from .preprocess import cap_per_pattern, with_normalized

# The attribute that holds the link of each tag.
LINK_ATTRIBUTES = {
    "a": "href",
    "link": "href",
    "script": "src",
    "img": "src",
    "iframe": "src",
    "form": "action",
    "object": "data",
    "embed": "src",
}


def _raw_links(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """One row per link attribute: (keys…, tag_pos, tag, srcset, item, attr, href).

    ``srcset`` links of a page come after all others, hence the flag in the sort key.
    """
    names = "|".join(sorted(set(LINK_ATTRIBUTES) | {"source"}))
    wanted = keep(H.start_tags(html), f"t -> t RLIKE '(?i)^<({names})[\\\\s/]'")
    plain, attr = "", ""
    for name in dict.fromkeys(LINK_ATTRIBUTES.values()):
        owners = "|".join(t for t, a in LINK_ATTRIBUTES.items() if a == name)
        plain += f" WHEN t RLIKE '(?i)^<({owners})[\\\\s/]' THEN {H.attribute_sql('t', name)}"
        attr += f" WHEN tag RLIKE '^({owners})$' THEN '{name}'"
    found = each(
        wanted,
        f"(t, i) -> named_struct('tag_pos', i, 'tag', {H.tag_name_sql('t')}, '_plain', CASE{plain} ELSE '' END, "
        f"'_srcset', CASE WHEN t RLIKE '(?i)^<(img|source)[\\\\s/]' THEN {H.attribute_sql('t', 'srcset')} ELSE '' END)",
    )
    tags = pages.select(*keys, F.inline(found))
    space = sql_text(WHITESPACE)
    decoded = H.decode_references_sql("_plain")
    one = f"named_struct('srcset', 0, 'item', 0, 'attr', CASE{attr} END, 'href', btrim({decoded}, {space}))"
    several = (
        f"transform(split({H.decode_references_sql('_srcset')}, ',', -1), (u, i) -> named_struct('srcset', 1, 'item', i, "
        f"'attr', 'srcset', 'href', btrim(regexp_extract(u, {sql_text(SRCSET_URL)}, 1), {space})))"
    )
    items = F.expr(f"CASE WHEN _srcset = '' THEN array({one}) ELSE concat(array({one}), {several}) END")
    return tags.select(*keys, "tag_pos", "tag", F.inline(items)).where("href <> ''")


def extract_links(
    pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id", rejected: bool = False,
    limits: bool = True,
) -> DataFrame:
    """One row per followable link with its absolute URL; traps and unusable links are left out.

    ``rejected`` keeps those too and adds ``reject_reason``, null for a link to follow. Without
    ``limits`` no link is too long or too deep; rules on repeated parts stay. ``html`` is
    read once and never leaves the scan stage; there is no shuffle.
    """
    base = stage_parts(pages.select(page_id, url, html), url, "_b_")
    keys = [c for c in base.columns if c != html]
    raw = _raw_links(base, keys, html)
    off = {} if limits else {"max_bytes": None, "max_slashes": None}
    loose = {} if limits else {"max_segments": None, "max_segment_bytes": None}
    early = (
        F.when(is_skippable_href("href"), "skippable").when(has_problem_pattern("href", **off), "problem")
        .when(is_invalid_url("href", **off), "invalid").when(has_path_trap("href", **loose), "trap")
    )
    raw = stage(raw, {"_early": early}) if rejected else raw.where(early.isNull())
    link, page = UrlParts.staged("_h_"), UrlParts.staged("_b_")
    staged = stage_parts(raw, "href", "_h_")
    out = stage(staged, {"link": F.when(can_resolve(link, page), resolve_parts(link, page))})
    late = F.when(F.col("link").isNull(), "unresolved").when(is_invalid_url("link", **off), "invalid")
    if rejected:
        out = out.withColumn("reject_reason", F.coalesce("_early", late))
    else:
        out = out.where(late.isNull())
    return drop_parts(drop_parts(out, "_h_"), "_b_").select(
        page_id,
        F.col(url).alias("page_url"),
        "srcset",
        "tag_pos",
        "item",
        "tag",
        F.when(F.col("tag") == "source", F.lit("img")).otherwise(F.col("tag")).alias("asset_type"),
        "attr",
        "href",
        "link",
        *["reject_reason"] * rejected,
    )


def mark_scope(
    df: DataFrame,
    url: str = "link",
    seed_hosts: DataFrame | None = None,
    name: str = "in_scope",
    disallowed_hosts: tuple = (),
    disallowed_subdomains: tuple = (),
    rules: DataFrame | None = None,
    **path_rules,
) -> DataFrame:
    """Add whether ``url`` is in scope. ``seed_hosts`` is a frame of distinct ``host`` values.

    ``rules`` is a table of host rules, see ``judge_hosts``; ``df`` with its hosts is then written once, as it is
    read for the hosts and for the rows.

    The host table joins by equality: small ones are broadcast at run time, large ones shuffle and a
    host with very many links is split by the adaptive skew join.
    """
    staged = stage_parts(df, url, "_s_")
    parts = UrlParts.staged("_s_")
    staged = stage(staged, {"_host": parts.hostname})
    host = F.col("_host")
    is_seed = None
    if seed_hosts is not None:
        known = seed_hosts.select(F.lower("host").alias("_seed_host"), F.lit(True).alias("_is_seed")).distinct()
        staged = staged.join(known, F.lower("_host") == F.col("_seed_host"), "left")
        is_seed = F.coalesce(F.col("_is_seed"), F.lit(False))
    inside = in_scope_host(host, is_seed, disallowed_hosts, disallowed_subdomains)
    if rules is not None:
        staged = with_host_verdict(cut_lineage(staged), rules, "_host", "_by_rules")
        inside = inside & F.coalesce(F.col("_by_rules"), F.lit(False))
    inside = parts.valid & (host != "") & inside & in_scope_path(parts.plain_path, **path_rules)
    out = staged.withColumn(name, F.coalesce(inside, F.lit(False)))
    return drop_parts(out, "_s_").drop("_host", "_seed_host", "_is_seed", "_by_rules")


def asset_inventory(links: DataFrame, keys: tuple = ("page_id",)) -> DataFrame:
    """Links per page, type and scope flag."""
    return links.groupBy(*keys, "asset_type", "in_scope").agg(F.count("*").alias("n_links"))


def html_pages_only(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    return df.where(F.contains(F.lower(F.col(content_type)), F.lit("text/html")))


def discovered_urls(
    links: DataFrame,
    seeds: DataFrame | None = None,
    include_seeds: bool = True,
    max_similar: int = 1,
    enabled: bool = True,
    page_pos: str = "page_id",
    scope: dict | None = None,
    normalize: dict | None = None,
    pattern: dict | None = None,
) -> DataFrame:
    """The distinct in-scope URLs that the links of a page table lead to, look-alikes capped.

    Order of discovery is page, then place in the page. ``seeds`` (pos, url) come first where they
    are included. ``scope`` holds keywords of ``mark_scope``.
    """
    place = ["_source", "_page", "_srcset", "_tag_pos", "_item"]
    inside = mark_scope(links, "link", **(scope or {})).where("in_scope")
    found = inside.select(
        F.lit(1).alias("_source"),
        F.col(page_pos).cast("long").alias("_page"),
        F.col("srcset").alias("_srcset"),
        F.col("tag_pos").alias("_tag_pos"),
        F.col("item").alias("_item"),
        F.col("link").alias("url"),
    )
    if seeds is not None and include_seeds:
        zero = F.lit(0)
        found = found.unionByName(
            seeds.select(
                zero.alias("_source"), F.col("pos").cast("long").alias("_page"), zero.alias("_srcset"),
                zero.alias("_tag_pos"), zero.alias("_item"), "url",
            )
        )
    rows = with_normalized(found, "url", "crawl", normalize, pattern)
    rows = rows.withColumn("norm", F.coalesce("norm", "url")).drop("url")
    # normalising keeps host and path, so the scope found above still holds
    if not enabled:
        return rows.groupBy(F.col("norm").alias("url")).agg(F.first("pattern").alias("pattern"))
    if max_similar != 1:
        first = F.min(F.struct(*place)).alias("_at")
        rows = rows.groupBy("norm", "pattern").agg(first).select("norm", "pattern", "_at.*")
    kept = cap_per_pattern(rows, order=place, max_similar=max_similar)
    return kept.select(F.col("norm").alias("url"), "pattern")


def link_edges(links: DataFrame, page_pos: str = "page_id", normalize: dict | None = None) -> DataFrame:
    """child → parent by normalised URL; the last page that links a child wins."""
    order = F.struct(F.col(page_pos), "srcset", "tag_pos", "item")
    options = normalize or {}
    return (
        links.select(
            F.coalesce(normalize_url("link", **options), F.col("link")).alias("child"),
            F.coalesce(normalize_url("page_url", **options), F.col("page_url")).alias("parent"),
            order.alias("_at"),
        )
        .groupBy("child")
        .agg(F.max_by("parent", "_at").alias("parent"))
    )
