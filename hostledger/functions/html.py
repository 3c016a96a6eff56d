"""HTML start tags, attributes and character references with built-in expressions."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from .urlparts import as_column, sql_list, sql_text

# Elements whose content is text, not markup.
RAW_TEXT = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript"

# All repeats below are possessive, so the regex engine loops rather than recurses and a tag may be
# of any length.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'>])[^\s>]++)"""


def _attributes(but: str = "") -> str:
    """Any number of attributes, up to the one called ``but``."""
    stop = rf"(?!{but}[\s=/>])" if but else ""
    return rf"(?:[\s/]*+{stop}=?+[^\s/>=]++(?:\s*+=\s*+{_VALUE}?+)?+)*+"


# Comments, declarations and end tags are consumed without a group; group 1 is a start tag. Group 3
# is empty and set only for raw-text elements, whose content is consumed together with the tag.
START_TAGS = (
    r"(?is)(?=<)(?:<!--(?:-?>|(?:[^-]++|-(?!-!?>))*+(?:--!?>|\z))"
    r"|<[!?/][^>]*+(?:>|\z)"
    rf"|(<(?:({RAW_TEXT})(?=[\s/>])()|[a-z][^\s/>]*+){_attributes()}[\s/]*+>)"
    r"(?:\3(?:[^<]++|<(?!/\2[\s/>]))*+|(?!\3)))"
)

# What the numeric references 128 to 159 stand for (Windows-1252); undefined ones stay as they are.
C1 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
# The named references of the HTML standard, from Python's copy of its table, each as one text:
# those that end in a semicolon, and the old ones that may go without.
BEFORE, BETWEEN = "\ue000", "\ue001"
CLOSED, OPEN = (
    "".join(f"{BEFORE}{name}{BETWEEN}{text}" for name, text in html5.items() if name.endswith(";") == closed) + BEFORE
    for closed in (True, False)
)


def start_tags(html: Column | str) -> Column:
    """All start tags in document order, outside comments and raw text; other markup gives ''."""
    return F.regexp_extract_all(as_column(html), F.lit(START_TAGS), F.lit(1))


def tag_name_sql(tag: str) -> str:
    return f"lower(regexp_extract({tag}, {sql_text(r'^<([A-Za-z][^\s/>]*)')}, 1))"


def attribute_sql(tag: str, name: str) -> str:
    """SQL: the raw value of the first attribute called ``name``, unquoted; empty where there is none."""
    value = rf"(?is)^<[a-z][^\s/>]*+{_attributes(but=name)}[\s/]*+{name}\s*+=\s*+({_VALUE})"
    quotes = r"""(?s)^(["'])(.*)\1\z"""
    return f"regexp_replace(regexp_extract({tag}, {sql_text(value)}, 1), {sql_text(quotes)}, '$2')"


def _named_sql(name: str, table: str) -> str:
    """SQL: what the reference ``name`` stands for, null if the table has none."""
    place = f"instr({sql_text(table)}, concat('{BEFORE}', {name}, '{BETWEEN}'))"
    value = f"split_part(substr({sql_text(table)}, {place} + length({name}) + 2, 8), '{BEFORE}', 1)"
    return f"CASE WHEN {place} > 0 THEN {value} END"


def _decoded_piece() -> str:
    """SQL over ``p``, the text after an ampersand: the reference it starts with, decoded.

    A number may have any number of digits; one that is no character gives U+FFFD. In an attribute a
    name without semicolon counts only if no letter, digit or equals sign follows.
    """
    digits = "ltrim('0', regexp_extract(p, '^#([0-9]+)', 1))"
    hex_digits = "ltrim('0', regexp_extract(p, '^#[xX]([0-9a-fA-F]+)', 1))"
    is_hex = "p RLIKE '^#[xX][0-9a-fA-F]'"
    number = (
        f"CASE WHEN {is_hex} THEN CASE WHEN length({hex_digits}) BETWEEN 1 AND 6 THEN cast(conv({hex_digits}, 16, 10) AS int) END "
        f"ELSE CASE WHEN length({digits}) BETWEEN 1 AND 7 THEN cast({digits} AS int) END END"
    )
    # 1114111 is the last character, 55296 to 57343 are halves of pairs
    char = (
        f"transform(array({number}), n -> CASE WHEN n IS NULL OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN '\uFFFD' "
        f"WHEN n BETWEEN 128 AND 159 THEN element_at({sql_list(C1.values())}, n - 127) "
        "ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END)[0]"
    ).replace("element_at((", "element_at(array(")
    rest = "regexp_replace(p, '^#(?:[xX][0-9a-fA-F]+|[0-9]+);?', '')"
    closed = "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;', 0)"
    loose = "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*+(?![;=])', 0)"
    return (
        "CASE WHEN p RLIKE '^#([0-9]|[xX][0-9a-fA-F])' THEN concat(" + char + f", {rest}) "
        f"WHEN {closed} <> '' THEN coalesce(concat({_named_sql(closed, CLOSED)}, substr(p, length({closed}) + 1)), concat('&', p)) "
        f"WHEN {loose} <> '' THEN coalesce(concat({_named_sql(loose, OPEN)}, substr(p, length({loose}) + 1)), concat('&', p)) "
        "ELSE concat('&', p) END"
    )


def decode_references_sql(text: str) -> str:
    """SQL: decode the character references of an attribute value."""
    return (
        f"CASE WHEN contains({text}, '&') THEN array_join(transform(split({text}, '&', -1), "
        f"(p, i) -> CASE WHEN i = 0 THEN p ELSE {_decoded_piece()} END), '') ELSE {text} END"
    )
