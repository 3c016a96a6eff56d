"""URL expressions: normalising, resolving, host rules, link traps and scope."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, functions as F

from . import tables
from .urlparts import (
    UrlParts,
    as_column,
    cut_after,
    cut_before,
    each,
    form_encode_sql,
    has,
    keep,
    let,
    sql_list,
    sql_text,
    swap,
    trim_space,
)


def normalize_target(url: Column | str) -> Column:
    """A seed line as a URL: trimmed, with a scheme, host in lower case; null where unusable."""
    trimmed = trim_space(as_column(url))
    full = F.when(trimmed.rlike("^https?://"), trimmed).otherwise(F.concat(F.lit("https://"), trimmed))

    def clean(text):
        parts = UrlParts.of(text)
        user = F.regexp_extract(parts.authority, "^(//.*@)", 1)
        lowered = F.when(user == "", F.lower(parts.authority)).otherwise(F.concat(user, F.lower(parts.host_port)))
        return F.when(parts.valid, parts.text(authority=lowered))

    return F.when(trimmed != "", let(full, clean))


def normalized_parts(
    parts: UrlParts,
    strip_fragments: bool = True,
    strip_tracking: bool = True,
    custom_params: Sequence[str] = tuple(tables.CUSTOM_STRIP_PARAMS),
) -> UrlParts:
    """The parts without fragment and tracking parameters; a changed query is sorted and re-encoded."""
    dropped = sorted(set(tables.TRACKING_PARAMS if strip_tracking else []) | set(custom_params))
    query = parts.query
    if dropped:
        noise = f"lower(p.k) IN {sql_list(dropped)}"
        encode = f"concat({form_encode_sql('p.k')}, '=', {form_encode_sql('p.v')})"
        stripped = (
            f"CASE WHEN exists(x, p -> {noise}) THEN array_join(transform(array_sort(filter(x, p -> NOT {noise})), "
            f"p -> {encode}), '&') END"
        )
        # null where nothing was dropped
        rest = let(parts.query_pairs(), stripped)
        query = F.when(
            F.length(parts.query) > 1,
            let(rest, "CASE WHEN x = '' THEN x ELSE concat('?', x) END"),
        )
        query = F.coalesce(query, parts.query)
    fragment = F.lit("") if strip_fragments else parts.fragment
    return replace(parts, query=query, fragment=fragment)


def normalize_url(url: Column | str, **options) -> Column:
    """Drop the fragment and tracking parameters; null for an unparseable URL."""
    parts = normalized_parts(UrlParts.of(url), **options)
    return F.when(parts.valid, parts.text())


# SQL over ``x``, an absolute path: resolve its dot segments.
REMOVE_DOTS = """CASE WHEN contains(x, '/.') THEN concat(array_join(aggregate(split(x, '/', -1), cast(array() AS array<string>),
    (done, s) -> CASE WHEN s = '.' OR (s = '..' AND size(done) <= 1) THEN done
      WHEN s = '..' THEN slice(done, 1, size(done) - 1) ELSE concat(done, array(s)) END), '/'),
    CASE WHEN x RLIKE '/[.][.]?$' THEN '/' ELSE '' END) ELSE x END"""


def resolve_parts(href: UrlParts, base: UrlParts) -> Column:
    """The reference ``href`` seen from ``base`` as text (RFC 3986 section 5.2)."""
    own_host, own_path = href.authority != "", href.path != ""
    same_page = ~own_host & ~own_path & (href.query == "")
    folder = F.concat(F.regexp_replace(base.escaped_path, r"[^/]*\z", ""), href.escaped_path)
    full_path = (
        F.when(own_host | F.startswith(href.path, F.lit("/")), href.escaped_path)
        .when(~own_path, base.escaped_path)
        .when(F.startswith(folder, F.lit("/")), folder)
        .otherwise(F.concat(F.lit("/"), folder))
    )
    merged = replace(
        href,
        scheme=base.scheme,
        authority=F.when(own_host, href.authority).otherwise(base.authority),
        query=F.when(same_page, base.query).otherwise(href.query),
        fragment=F.when(same_page & (F.length(href.fragment) <= 1), base.fragment).otherwise(href.fragment),
    )
    return F.when(href.scheme != "", href.text()).otherwise(merged.text(path=let(full_path, REMOVE_DOTS)))


def can_resolve(href: UrlParts, base: UrlParts) -> Column:
    return href.valid & ((href.scheme != "") | F.coalesce(base.valid, F.lit(False)))


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """An absolute URL for ``href`` found on page ``base``; null where there is none."""
    page = UrlParts.of(base)

    def resolved(text):
        link = UrlParts.of(text)
        return F.when((text != "") & can_resolve(link, page), resolve_parts(link, page))

    return let(trim_space(as_column(href)), resolved)


def extract_host(url: Column | str) -> Column:
    """Host name without port; null where the URL has none."""
    parts = UrlParts.of(url)
    return F.when(parts.valid, F.nullif(parts.hostname, F.lit("")))


def base_domain(host: Column | str) -> Column:
    """Registrable domain by the two-label suffix table."""
    text = F.lower(trim_space(as_column(host)))
    name = (
        F.when(text.rlike(r"^[^:\[\]]*:[^:\[\]]*\z"), cut_before(text, ":"))
        .when(text.rlike(r"^\[[^\]]*\]:[^:]*\z"), F.regexp_extract(text, r"^\[([^\]]*)\]", 1))
        .otherwise(text)
    )
    last_two = F.substring_index(name, ".", -2)
    return F.when(
        text != "",
        F.when((last_two != name) & last_two.isin(tables.TWO_PART_SUFFIXES), F.substring_index(name, ".", -3))
        .otherwise(last_two),
    )


def snapshot_key(text: Column | str) -> Column:
    """A name for a host or URL that is safe in paths."""
    text = as_column(text)
    name = F.coalesce(cut_after(text, "://"), text)
    name = F.regexp_replace(name, "[^a-zA-Z0-9_.-]+", "_")
    name = F.regexp_replace(name, "_+", "_")
    for old in ("..", "_.", "._"):
        name = swap(name, old, "_")
    name = F.btrim(name, F.lit("_."))
    return F.when(name == "", F.lit("sanitized_empty_input")).otherwise(name)


def is_valid_url(url: Column | str) -> Column:
    text = trim_space(as_column(url))
    return F.coalesce((text != "") & UrlParts.of(text).valid, F.lit(False))


def effective_url(final_url: Column | str, input_url: Column | str) -> Column:
    return F.coalesce(F.nullif(as_column(final_url), F.lit("")), as_column(input_url))


def url_key(url: Column | str, normalize: bool = False, case_sensitive: bool = True) -> Column:
    """The key two snapshots are compared by."""
    key = as_column(url)
    if normalize:
        key = F.coalesce(normalize_target(key), key)
    return key if case_sensitive else F.lower(key)


SRCSET_URL = r"^\s*(\S+)"


def parse_srcset(srcset: Column | str) -> Column:
    """The URLs of a ``srcset`` attribute."""
    firsts = each(F.split(as_column(srcset), ",", -1), f"p -> regexp_extract(p, {sql_text(SRCSET_URL)}, 1)")
    return keep(firsts, "u -> u <> ''")


def is_skippable_href(href: Column | str) -> Column:
    href = as_column(href)
    skip = href == ""
    for prefix in tables.SKIPPED_PREFIXES:
        skip = skip | F.startswith(href, F.lit(prefix))
    return skip


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(swap(text, char, ""))


def _contains_any(text: Column, pieces: Sequence[str]) -> Column:
    hit = F.lit(False)
    for piece in pieces:
        hit = hit | has(text, piece)
    return hit


# SQL over ``x``, an array of segments: some segment of two bytes or more occurs more than three times.
OFTEN = """size(x) > 3 AND size(x) - size(array_distinct(x)) >= 3 AND exists(array_distinct(x),
    s -> octet_length(s) >= 2 AND size(filter(x, t -> t = s)) > 3)"""

# SQL over ``x``, the segments of a path: the path looks like an endless loop.
LOOPS = f"""(size(x) > 3 AND x[0] = x[size(x) - 1] AND octet_length(x[0]) >= 2)
    OR ({OFTEN})
    OR exists(sequence(0, size(x) - 1), i -> octet_length(x[i]) >= 2 AND x[i] = get(x, i + 1))
    OR (size(x) >= 6 AND exists(sequence(0, size(x) - 6), i -> octet_length(x[i]) >= 2
      AND x[i] = x[i + 2] AND x[i] = x[i + 4] AND x[i + 1] = x[i + 3] AND x[i + 1] = x[i + 5]))"""


def _over(size: Column, most: int | None) -> Column:
    """More than ``most``; without a limit never."""
    return F.lit(False) if most is None else size > most


def has_path_trap(url: Column | str, max_segments: int | None = 15, max_segment_bytes: int | None = 200) -> Column:
    """The path looks like an endless link loop. A limit of None is off."""
    text = trim_space(as_column(url))
    full = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    usable = (text != "") & UrlParts.of(text).valid
    path = let(full, lambda t: F.when(UrlParts.of(t).valid, F.btrim(UrlParts.of(t).plain_path, F.lit("/"))))
    # two segments need two slashes, which may be escaped; most links end here
    suspect = (_count(text, "/") >= 2) | has(text, "%") | _over(F.octet_length(text), max_segment_bytes)
    rules = [LOOPS]
    if max_segments is not None:
        rules.append(f"size(x) > {max_segments}")
    if max_segment_bytes is not None:
        rules.append(f"exists(x, s -> octet_length(s) > {max_segment_bytes})")
    looped = let(F.split(path, "/", -1), " OR ".join(f"({r})" for r in rules))
    return F.coalesce(suspect & usable & (path != "") & looped, F.lit(False))


def has_problem_pattern(url: Column | str, max_bytes: int | None = 2000, max_slashes: int | None = 50) -> Column:
    """Too long, too deep, or with a repeated fragment. A limit of None is off."""
    text = as_column(url)
    return (
        _over(F.octet_length(text), max_bytes)
        | _over(_count(text, "/"), max_slashes)
        | _contains_any(text, tables.REPEATED_FRAGMENTS + tables.RECURSIVE_FRAGMENTS_STRICT)
    )


def has_repeated_segments(url: Column | str) -> Column:
    """More than five segments, one of them more than three times."""
    text = as_column(url)
    path = F.btrim(F.regexp_replace(text, "(?s)^.*?//[^/]*(?=/)", ""), F.lit("/"))
    return (_count(text, "/") > 4) & (_count(path, "/") > 4) & let(F.split(path, "/", -1), OFTEN)


def is_invalid_url(url: Column | str, max_bytes: int | None = 1000, max_slashes: int | None = 30) -> Column:
    """Empty, too long, too deep, or with repeated fragments or segments. A limit of None is off."""
    text = as_column(url)
    return (
        (text == "")
        | _over(F.octet_length(text), max_bytes)
        | _contains_any(text, tables.REPEATED_FRAGMENTS + tables.RECURSIVE_FRAGMENTS)
        | _over(_count(text, "/"), max_slashes)
        | has_repeated_segments(text)
    )


def in_scope_host(
    host: Column | str,
    is_seed: Column | None = None,
    disallowed_hosts: Sequence[str] = (),
    disallowed_subdomains: Sequence[str] = (),
) -> Column:
    """Host rules, in lower case. ``is_seed`` tells whether the host is a seed host; without it all hosts may pass."""
    host = as_column(host)
    name = F.lower(host)
    rules = [h.lower() for h in disallowed_hosts]
    blocked = name.isin(rules) if rules else F.lit(False)
    for other in rules:
        blocked = blocked | F.endswith(name, F.lit("." + other))
    if disallowed_subdomains:
        domain = base_domain(name)
        sub = F.substr(name, F.lit(1), F.length(name) - F.length(domain) - 1)
        blocked = blocked | ((name != domain) & sub.isin([d.lower() for d in disallowed_subdomains]))
    allowed = ~blocked
    return allowed if is_seed is None else allowed & is_seed


def in_scope_path(path: Column | str, disallowed_extensions: Sequence[str] = tuple(tables.DISALLOWED_EXTENSIONS)) -> Column:
    """The path ends in none of the extensions (exact case), query and fragment aside."""
    clean = cut_before(cut_before(as_column(path), "?"), "#")
    blocked = F.lit(False)
    for ext in disallowed_extensions:
        blocked = blocked | F.endswith(clean, F.lit(ext))
    return ~blocked


def is_blocked_file(path: Column | str, disallowed_extensions: Sequence[str] = tuple(tables.DISALLOWED_EXTENSIONS)) -> Column:
    """The text from the last dot on is one of the extensions."""
    clean = cut_before(cut_before(as_column(path), "?"), "#")
    return has(clean, ".") & F.concat(F.lit("."), F.substring_index(clean, ".", -1)).isin(list(disallowed_extensions))


def in_scope(
    url: Column | str,
    is_seed: Column | None = None,
    disallowed_hosts: Sequence[str] = (),
    disallowed_subdomains: Sequence[str] = (),
    disallowed_extensions: Sequence[str] = tuple(tables.DISALLOWED_EXTENSIONS),
) -> Column:
    """Host and path rules together; an unparseable or host-less URL is out of scope."""
    parts = UrlParts.of(url)
    inside = let(
        parts.hostname,
        lambda host: (host != "") & in_scope_host(host, is_seed, disallowed_hosts, disallowed_subdomains),
    )
    return F.coalesce(parts.valid & inside & in_scope_path(parts.plain_path, disallowed_extensions), F.lit(False))
