"""Split a URL into its parts with built-in string functions, and put the parts together again.

The rules are those of a lenient RFC 3986 reader: control characters, a colon before the scheme, bad
percent escapes, odd host characters and non-numeric ports make a URL unparseable; everything else
is accepted, scheme or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

# Unicode white space.
WHITESPACE = (
    " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed pattern: scheme with its colon, authority with its slashes, path, query with its question
# mark, fragment with its hash. A missing part is empty, a present one starts with its mark.
PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?\z"

_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:"
_BAD_ESCAPE = r"%(?:[^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f]|[0-9A-Fa-f]?\z)"

# What makes a URL unparseable: control characters; a colon in the first segment that ends no
# scheme; odd characters or a port that is no number in the host; odd characters in the user part;
# a broken percent escape in path or fragment. Each alternative reads the URL once, however long it is.
UNPARSEABLE = (
    r"(?s)[\x00-\x1f\x7f]"
    rf"|^(?!{_SCHEME})[^/?#:]*:"
    rf"|^(?:{_SCHEME})?//(?:[^/?#]*@)?+[^/?#@]*(?:[ \\^`{{|}}%]|:[0-9]*[^0-9:\]/?#@][^:\]/?#]*(?:[/?#]|\z))"
    rf"|^(?:{_SCHEME})?//[A-Za-z0-9._:~!$&'()*+,;=%@-]*+[^/?#][^/?#@]*+@"
    rf"|^[^?#%]*+(?:%[0-9A-Fa-f]{{2}}[^?#%]*+)*+{_BAD_ESCAPE}"
    r"|^[^#]*+#(?:[^%]++|%[0-9A-Fa-f]{2})*+%"
)
# A short-cut most URLs take: plain host, no percent sign, no control character.
PLAINLY_PARSEABLE = r"^[A-Za-z][A-Za-z0-9+.-]*+://[A-Za-z0-9._-]++(?::[0-9]++)?+(?:[/?#][^\x00-\x1f\x7f%]*+)?+\z"
NEEDS_PATH_ESCAPE = r"[^A-Za-z0-9_.~!$&'()*+,;=:@%\[\]/-]"
NEEDS_FRAGMENT_ESCAPE = r"^#.*[^A-Za-z0-9_.~!$&'()*+,;=:@%\[\]/?-]"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_space(text: Column) -> Column:
    """Trim Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def has(text: Column, piece: str) -> Column:
    return F.contains(text, F.lit(piece))


def swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def cut_before(text: Column, mark: str) -> Column:
    """The text before the first ``mark``, or all of it."""
    return F.substring_index(text, mark, 1)


def cut_after(text: Column, mark: str) -> Column:
    """The text after the first ``mark``; null where there is none."""
    at = F.instr(text, F.lit(mark))
    return F.when(at > 0, F.substr(text, at + len(mark)))


def sql_text(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def each(array: Column, body: str) -> Column:
    """``transform`` with the lambda as SQL text, which the JVM parses at once."""
    return F.call_function("transform", array, F.expr(body))


def keep(array: Column, body: str) -> Column:
    return F.call_function("filter", array, F.expr(body))


def some(array: Column, body: str) -> Column:
    return F.call_function("exists", array, F.expr(body))


def let(value: Column, body: Callable[[Column], Column] | str) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it.

    A body in SQL text calls the value ``x``.
    """
    one = F.array(value)
    return F.get(each(one, f"x -> {body}") if isinstance(body, str) else F.transform(one, body), F.lit(0))


def percent_escape_sql(text: str, kept: str) -> str:
    """SQL that percent-encodes all but letters, digits, ``-_.~`` and the characters in ``kept``."""
    out = f"replace(replace(replace(url_encode({text}), '+', '%20'), '*', '%2A'), '%7E', '~')"
    for char in kept:
        out = f"replace({out}, '%{ord(char):02X}', {sql_text(char)})"
    return out


def percent_escape(text: Column, kept: str) -> Column:
    return let(text, percent_escape_sql("x", kept))


def percent_unescape(text: Column) -> Column:
    """Undo percent encoding; a plus sign stays a plus sign."""
    return F.when(has(text, "%"), F.try_url_decode(swap(text, "+", "%2B"))).otherwise(text)


def form_encode_sql(text: str) -> str:
    """SQL for query encoding: blanks become plus signs."""
    return f"replace(replace(url_encode({text}), '*', '%2A'), '%7E', '~')"


@dataclass(frozen=True)
class UrlParts:
    """Columns of one split URL. Each part but the path carries its mark and is empty where absent."""

    scheme: Column
    authority: Column
    path: Column
    query: Column
    fragment: Column
    valid: Column

    @classmethod
    def of(cls, url: Column | str) -> UrlParts:
        url = as_column(url)
        part = [F.regexp_extract(url, PARTS, i) for i in range(1, 6)]
        valid = url.rlike(PLAINLY_PARSEABLE) | ~url.rlike(UNPARSEABLE)
        return cls(F.lower(part[0]), *part[1:], valid=valid)

    @classmethod
    def staged(cls, prefix: str) -> UrlParts:
        """The parts that ``stage_parts`` put into the frame."""
        return cls(**{f.name: F.col(prefix + f.name) for f in fields(cls)})

    @property
    def host_port(self) -> Column:
        return F.regexp_replace(self.authority, r"^//(?:.*@)?", "")

    @property
    def hostname(self) -> Column:
        """Host without port and IPv6 brackets; empty where the URL has none."""
        return F.regexp_replace(self.authority, r"^//(?:.*@)?\[?|\]?(?::[0-9]*)?\z", "")

    @property
    def plain_path(self) -> Column:
        """The path without percent encoding; empty for URLs such as ``mailto:``."""
        opaque = (self.scheme != "") & (self.authority == "") & ~F.startswith(self.path, F.lit("/"))
        return F.when(opaque, F.lit("")).otherwise(percent_unescape(self.path))

    @property
    def escaped_path(self) -> Column:
        return F.when(
            self.path.rlike(NEEDS_PATH_ESCAPE), percent_escape(percent_unescape(self.path), "/$&+,:;=@")
        ).otherwise(self.path)

    @property
    def plain_fragment(self) -> Column:
        return percent_unescape(F.substr(self.fragment, F.lit(2)))

    def text(self, authority: Column | None = None, path: Column | None = None) -> Column:
        """The URL as text. A replaced path must be escaped already."""
        no_path = (self.path if path is None else path) == ""
        authority = self.authority if authority is None else authority
        path = self.escaped_path if path is None else path
        host = F.when(authority.rlike(r"[^\x00-\x7f]"), percent_escape(authority, "!$&'()*+,;=:[]<>\"@/")).otherwise(
            authority
        )
        fragment = F.when(
            self.fragment.rlike(NEEDS_FRAGMENT_ESCAPE),
            F.concat(F.lit("#"), percent_escape(self.plain_fragment, "/$&+,:;=@?!()*")),
        ).otherwise(self.fragment)
        return F.concat(
            self.scheme,
            F.when((authority == "//") & no_path, F.lit("")).otherwise(host),
            path,
            self.query,
            F.when(fragment == "#", F.lit("")).otherwise(fragment),
        )

    def query_pairs(self) -> Column:
        """The query as an array of decoded (k, i, v) structs; broken pairs are left out."""
        value = "CASE WHEN p LIKE '%=%' THEN substr(p, instr(p, '=') + 1) ELSE '' END"
        pairs = each(
            F.split(F.substr(self.query, F.lit(2)), "&", -1),
            "(p, i) -> named_struct('k', try_url_decode(substring_index(p, '=', 1)), 'i', i, "
            f"'v', try_url_decode({value}), 'ok', p <> '' AND NOT contains(p, ';'))",
        )
        return keep(pairs, "p -> p.ok AND p.k IS NOT NULL AND p.v IS NOT NULL")


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later steps read as they are.

    A plain projection would be copied into every filter and projection above it and computed there
    again; the one-row generator keeps it where it is, within the same code-generated stage.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def part_columns(url: Column | str, prefix: str) -> dict[str, Column]:
    parts = UrlParts.of(url)
    return {prefix + f.name: getattr(parts, f.name) for f in fields(UrlParts)}


def stage_parts(df: DataFrame, url: Column | str, prefix: str) -> DataFrame:
    """Add the parts of ``url``, so that later steps need not split it again."""
    return stage(df, part_columns(url, prefix))


def drop_parts(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[prefix + f.name for f in fields(UrlParts)])
