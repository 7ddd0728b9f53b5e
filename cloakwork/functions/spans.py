"""Regular-expression search with offsets, as Catalyst expressions.

Spark finds matches but not where they are.  The gaps between matches come from split()
with the same pattern, and one pass over gaps and matches sums their lengths.  Offsets
are code points over the text, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: int, end: int, type: string, text: string, confidence: double, source: string>"
SPANS = f"array<{SPAN}>"

#: Types in registration order, which breaks ties between equal spans.
PII_TYPES = (
    "EMAIL", "PHONE", "IBAN", "CREDIT_CARD", "IP", "MAC", "NATIONAL_ID", "PASSPORT", "DATE_OF_BIRTH", "PERSON",
)

# Classes that Java and other dialects see differently, spelled out.
WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, gate: str | None = None) -> str:
    """SQL: array<struct<s, e, m>> of the matches of pattern in the column text.

    gate is a cheaper pattern without which there is no match.
    """
    q = quoted(pattern)
    empty = "cast(array() as array<struct<s: int, e: int, m: string>>)"
    return (
        f"if(coalesce({text} rlike {quoted(gate or pattern)}, false),"
        f" aggregate(zip_with(regexp_extract_all({text}, {q}, 0), split({text}, {q}, -1), (m, g) -> struct(m, length(g) as g)),"
        f" named_struct('at', 0, 'out', {empty}),"
        " (a, x) -> if(x.m is null, a, named_struct('at', a.at + x.g + length(x.m), 'out',"
        " array_append(a.out, named_struct('s', a.at + x.g, 'e', a.at + x.g + length(x.m), 'm', x.m)))), a -> a.out),"
        f" {empty})"
    )


def as_spans(found: str, kind: str, confidence: str, source: str) -> str:
    """SQL: matches as spans; confidence and source are SQL over the match x."""
    return (
        f"transform({found}, x -> named_struct('start', x.s, 'end', x.e, 'type', '{kind}', 'text', x.m,"
        f" 'confidence', {confidence}, 'source', {source}))"
    )


def suffix(found: str, pattern: str) -> str:
    """SQL: each match cut to its last part, which is group 1 of pattern."""
    g = f"regexp_extract(x.m, {quoted(pattern)}, 1)"
    return f"transform({found}, x -> named_struct('s', x.e - length({g}), 'e', x.e, 'm', {g}))"


def keep(found: str, condition: str) -> str:
    return f"filter({found}, x -> {condition})"


def before(text: str, n: int = 1) -> str:
    """SQL: the up to n characters before the match x."""
    return f"substring({text}, greatest(x.s - {n - 1}, 1), least(x.s, {n}))"


def after(text: str, n: int = 1) -> str:
    return f"substring({text}, x.e + 1, {n})"


def empty_spans() -> Column:
    return F.expr(f"cast(array() as {SPANS})")
