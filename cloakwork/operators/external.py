"""Spans from outside: hand-made entries and the findings of a language model."""

from __future__ import annotations

import json
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import PII_TYPES, SPANS
from .detect import SPAN_ARROW, add_columns, as_rows
from .names import Span


def manual_spans(text: str, entries: list[tuple[str, str]]) -> list[Span]:
    """(type, value): every whole-word occurrence, in any case."""
    out = []
    for kind, value in entries:
        value = value.strip()
        if value:
            found = regex.finditer(rf"(?i)(?<![\p{{L}}\p{{N}}]){regex.escape(value)}(?![\p{{L}}\p{{N}}])", text)
            out += [Span(m.start(), m.end(), kind, m[0], 1.0, "manual") for m in found]
    return out


def parse_findings(raw: object) -> list[tuple[str, str]]:
    """(type, text) from a model's answer: JSON, fenced JSON, or JSON within prose."""
    if not isinstance(raw, str):
        return []
    body = re.sub(r"\s*```$", "", re.sub(r"(?i)^```(?:json)?\s*", "", raw.strip()))
    for candidate in (body, body[body.find("{") : body.rfind("}") + 1]):
        try:
            got = json.loads(candidate)
        except ValueError:
            continue
        rows = got.get("findings") if isinstance(got, dict) else None
        rows = rows if isinstance(rows, list) else []
        rows = [(r.get("type"), r.get("text")) for r in rows if isinstance(r, dict)]
        return [(k.strip().upper(), t) for k, t in rows if isinstance(k, str) and isinstance(t, str)]
    return []


def findings_to_spans(text: str, findings: list[tuple[str, str]], confidence: float = 0.6) -> list[Span]:
    """Every occurrence of each finding; in any case if there is none as it stands."""
    out: dict[tuple[int, int, str], Span] = {}
    for kind, needle in findings:
        needle = needle.strip()
        if kind not in PII_TYPES or len(needle) < 2:
            continue
        exact = [m.start() for m in re.finditer(re.escape(needle), text)]
        for s in exact or [m.start() for m in re.finditer(re.escape(needle), text, re.I)]:
            e = s + len(needle)
            out.setdefault((s, e, kind), Span(s, e, kind, text[s:e], confidence, "llm"))
    return list(out.values())


def add_manual_spans(df: DataFrame, entries: list[tuple[str, str]] | str, text_col: str = "text", out_col: str = "manual") -> DataFrame:
    """df with out_col, the manual spans of its text.

    entries is one list of (type, value) for all rows, or the name of a column
    array<struct<type, value>>.  Pass out_col to detect() as extra_spans.
    """
    rows = isinstance(entries, str)

    def work(text, own=None):
        pairs = [(e["type"], e["value"]) for e in own or () if e["value"] is not None] if rows else entries
        return (as_rows(manual_spans(text, pairs)) if text is not None else [],)

    return add_columns(df, [text_col, *([entries] if rows else [])], {out_col: (SPANS, SPAN_ARROW)}, work)


def add_findings(df: DataFrame, answer_col: str, text_col: str = "text", confidence: float = 0.6, out_col: str = "findings") -> DataFrame:
    """df with out_col, the spans that a model's answer in answer_col names."""

    def work(text, answer):
        return (as_rows(findings_to_spans(text, parse_findings(answer), confidence)) if text is not None else [],)

    return add_columns(df, [text_col, answer_col], {out_col: (SPANS, SPAN_ARROW)}, work)


def is_loopback_url(url: str) -> bool:
    return re.match(r"(?i)https?://(?:[^/@]*@)?(?:localhost|127\.0\.0\.1|\[::1\])(?::\d+)?(?:[/?#]|$)", url) is not None
