"""Expressions over probe rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .urlparts import as_column, cut_before

# Duration units in nanoseconds.
UNIT_NANOS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
_DURATION_ITEM = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)"
_DURATION = rf"^[+-]?(?:{_DURATION_ITEM})+\z"


def parse_duration_s(text: Column | str) -> Column:
    """Seconds of a duration such as ``1h2m``, ``96.5ms`` or ``3``; null for anything else."""
    text = as_column(text)
    numbers = F.regexp_extract_all(text, F.lit(_DURATION_ITEM), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(_DURATION_ITEM), F.lit(2))
    scale = F.create_map(*[F.lit(x) for u, n in UNIT_NANOS.items() for x in (u, float(n))])
    nanos = F.aggregate(
        F.zip_with(numbers, units, lambda n, u: n.cast("double") * scale[u]),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    plain = F.regexp_replace(text, r"s\z", "")
    number = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), plain.try_cast("double"))
    return F.when(text.rlike(_DURATION), sign * F.round(nanos) / F.lit(1e9)).otherwise(number)


def parse_asn(text: Column | str) -> Column:
    """``AS123`` as 123; null where it is no number."""
    digits = F.replace(as_column(text), F.lit("AS"), F.lit(""))
    return F.when(digits.rlike(r"^[+-]?[0-9]+\z"), digits.try_cast("bigint"))


def flatten_headers(headers: Column | str, values: str = "array<string>") -> Column:
    """Header values as text, lists comma-separated. ``values`` is the type of the values, ``string`` or an array.

    JSON headers with both kinds can be read as ``map<string,string>``: a list then is its JSON text.
    """
    if values == "string":
        listed = lambda v: F.from_json(v, "array<string>")
        return F.transform_values(
            as_column(headers), lambda k, v: F.when(v.startswith("[") & listed(v).isNotNull(), F.array_join(listed(v), ", ")).otherwise(v)
        )
    return F.transform_values(as_column(headers), lambda k, v: F.array_join(v, ", "))


def is_success(error: Column | str, status: Column | str) -> Column:
    return (F.coalesce(as_column(error), F.lit("")) == "") & F.coalesce(
        as_column(status).between(200, 399), F.lit(False)
    )


def status_class(status: Column | str) -> Column:
    code = as_column(status)
    return (
        F.when(code.between(200, 299), "2xx Success")
        .when(code.between(300, 399), "3xx Redirect")
        .when(code.between(400, 499), "4xx Client Error")
        .when(code >= 500, "5xx Server Error")
        .otherwise("Other")
    )


def has_facet_host(
    error: Column | str, status: Column | str, title: Column | str, technologies: Column | str, content_type: Column | str
) -> Column:
    """The host of the row belongs in the host facet."""
    filled = lambda c: F.coalesce(as_column(c), F.lit("")) != ""
    code = F.coalesce(as_column(status), F.lit(0))
    return ~(filled(error) & (code == 0)) & (
        code.between(200, 499)
        | filled(title)
        | (F.coalesce(F.size(as_column(technologies)), F.lit(0)) > 0)
        | filled(content_type)
        | code.isin(500, 502, 503)
    )


def short_content_type(content_type: Column | str) -> Column:
    text = as_column(content_type)
    sub = F.get(F.split(cut_before(text, ";"), "/", -1), F.lit(1))
    return F.coalesce(F.nullif(sub, F.lit("")), text)
