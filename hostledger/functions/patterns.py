"""URL patterns: look-alike URLs share one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import tables
from .urlparts import UrlParts, as_column, each, keep, let, sql_list

MODES = ("preprocess", "crawl")


def _check(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def _lowered(codes: Sequence[str]) -> list[str]:
    return [c.lower() for c in codes]


def locale_sql(
    segment: str, mode: str, custom_codes: Sequence[str] = (), countries: Sequence[str] | None = None
) -> str:
    """SQL: the path segment is a locale code."""
    custom = _lowered(custom_codes)
    if mode == "preprocess":
        languages = tables.LANGUAGES
        nations = list(countries) if countries is not None else tables.iso_countries()
        words = tables.COMMON_LOCALES + tables.LANGUAGES + nations + tables.SPECIAL_LOCALE_WORDS + custom
        is_pair = f"{segment} LIKE '%-%'"
    else:
        languages, nations = tables.CRAWL_LANGUAGES, tables.CRAWL_COUNTRIES
        words = languages + nations + tables.CRAWL_DASHED_LOCALES + tables.CRAWL_COMPOUND_LOCALES + custom
        is_pair = f"{segment} LIKE '__-__'"
    left, right = f"substring_index(lower({segment}), '-', 1)", f"substr(lower({segment}), instr({segment}, '-') + 1)"
    return (
        f"(lower({segment}) IN {sql_list(dict.fromkeys(words))} OR ({is_pair}"
        f" AND {left} IN {sql_list(languages)} AND {right} IN {sql_list(nations)}))"
    )


def is_locale(
    segment: Column | str,
    mode: str = "crawl",
    custom_codes: Sequence[str] = (),
    countries: Sequence[str] | None = None,
) -> Column:
    """The path segment is a locale code. ``countries`` replaces the ISO table in preprocess mode."""
    _check(mode)
    return let(as_column(segment), locale_sql("x", mode, custom_codes, countries))


def variable_sql(text: str, mode: str) -> str:
    """SQL: the segment, value or fragment looks like an id rather than a name. Lengths are in bytes."""
    size = f"octet_length({text})"
    if mode == "preprocess":
        session = " OR ".join(
            f"(lower({text}) LIKE '{p}%' AND {size} > {len(p) + 4})" for p in tables.SESSION_PREFIXES
        )
        return (
            f"({text} <> '' AND ("
            f"({text} RLIKE '^[+-]?[0-9]+$' AND try_cast({text} AS bigint) IS NOT NULL)"
            f" OR ({size} >= 8 AND {text} RLIKE '^([+-]?0*([1-7][0-9a-fA-F]{{15}}|[0-9a-fA-F]{{0,15}})|-0*8000000000000000)$')"
            f" OR ({size} = 36 AND length({text}) - length(replace({text}, '-', '')) = 4)"
            f" OR contains({text}, '%') OR ({size} > 16 AND {text} RLIKE '^[A-Za-z0-9]+$') OR {session}))"
        )
    value = f"substr({text}, instr({text}, '=') + 1)"
    return (
        f"({text} <> '' AND ({size} <= 2 OR startswith({text}, 'id=') OR {text} RLIKE '^([0-9]{{1,6}}|[0-9a-fA-F]{{1,8}})$'"
        f" OR (length({text}) - length(replace({text}, '=', '')) = 1 AND ({value} RLIKE '^[0-9]{{1,6}}$'"
        f" OR lower(substring_index({text}, '=', 1)) IN {sql_list(tables.VARIABLE_FRAGMENT_KEYS)}"
        f" OR octet_length({value}) <= 3))))"
    )


def is_variable(text: Column | str, mode: str = "crawl") -> Column:
    """The segment, value or fragment looks like an id rather than a name."""
    _check(mode)
    return let(as_column(text), variable_sql("x", mode))


def is_ignored_param(name: Column | str, ignored: Sequence[str] = tuple(tables.IGNORED_PARAMS)) -> Column:
    return F.lower(as_column(name)).isin(_lowered(ignored)) if ignored else F.lit(False)


def pattern_text(
    parts: UrlParts,
    mode: str = "crawl",
    ignored_params: Sequence[str] = tuple(tables.IGNORED_PARAMS),
    detect_locales: bool = True,
    custom_codes: Sequence[str] = (),
    countries: Sequence[str] | None = None,
) -> Column:
    """``url_pattern`` over parts that are split already."""
    _check(mode)
    locale = locale_sql("s", mode, custom_codes, countries) if detect_locales else "false"
    pairs = parts.query_pairs()
    if ignored_params:
        pairs = keep(pairs, f"p -> lower(p.k) NOT IN {sql_list(_lowered(ignored_params))}")
    varies = variable_sql("x", mode)
    if mode == "preprocess":
        shape = f"CASE WHEN {locale} THEN '<locale>' WHEN {variable_sql('s', mode)} THEN '<variable>' ELSE s END"
        body = (
            "CASE WHEN x = '' THEN '' ELSE concat('/', array_join("
            f"transform(filter(split(x, '/', -1), s -> s <> ''), s -> {shape}), '/')) END"
        )
        # pairs sort by name, then by their place in the query
        shown = f"concat(p.k, '=', CASE WHEN {variable_sql('p.v', mode)} THEN '<variable>' ELSE p.v END)"
        query = each(F.array_sort(pairs), f"p -> {shown}")
        tail = f"CASE WHEN x = '' THEN '' WHEN {varies} THEN '#<variable>' ELSE concat('#', x) END"
    else:
        starred = f"transform(split(trim(BOTH '/' FROM x), '/', -1), s -> CASE WHEN {locale} THEN '*' ELSE s END)"
        body = (
            "CASE WHEN trim(BOTH '/' FROM x) = '' THEN '/' ELSE "
            f"concat('/', array_join({starred}, '/'), CASE WHEN endswith(x, '/') THEN '/' ELSE '' END) END"
            if detect_locales
            else "x"
        )
        query = F.array_sort(each(pairs, "p -> concat(p.k, '=*')"))
        tail = f"CASE WHEN x = '' OR {varies} THEN '' ELSE concat('#', x) END"
    asked = let(F.array_join(query, "&"), "CASE WHEN x = '' THEN '' ELSE concat('?', x) END")
    return F.when(
        parts.valid,
        F.concat(
            F.when(parts.scheme == "", F.lit(":")).otherwise(parts.scheme),
            F.lit("//"),
            parts.host_port,
            let(parts.plain_path, body),
            F.when(parts.query != "", asked).otherwise(F.lit("")),
            F.when(parts.fragment != "", let(parts.plain_fragment, tail)).otherwise(F.lit("")),
        ),
    )


def url_pattern(url: Column | str, mode: str = "crawl", **options) -> Column:
    """The pattern a URL belongs to; null for an unparseable URL."""
    return pattern_text(UrlParts.of(url), mode, **options)
