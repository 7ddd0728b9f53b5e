"""What a user sees after overriding the result of a document: MappingView."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import IDENTITIES, IDENTITY_ARROW, MAPPING, MAPPING_ARROW, add_columns, resolve_spans, spans_of
from .external import manual_spans
from .identity import Identity, Mapping, link_name_parts, resolve_identities, sanitize_text
from .names import Span


def key_of(kind: str, text: str) -> str:
    return f"{kind}:{text.lower()}"


@dataclass
class MappingView:
    text: str
    rows: list[Mapping]
    identities: list[Identity]
    groups: list[tuple[int, str, list[Mapping]]]
    ungrouped: list[Mapping]
    assignable: list[tuple[int, str]]
    empty_custom: list[int]
    member_of: dict[str, int]
    removed: list[tuple[str, str, str]]
    active: list[Span]


def build_mapping_view(
    text: str,
    spans: list[Span],
    mode: str = "redact",
    disabled: frozenset[str] = frozenset(),
    assignments: dict[str, int | None] | None = None,
    manual: list[tuple[str, str]] = (),
    custom: list[tuple[int, str]] = (),
) -> MappingView:
    """Apply hand-made entries, disabled values and group assignments.

    disabled and assignments are keyed by key_of(); custom groups are (id, label) with
    negative ids.  Values of one type in one group share the placeholder of the first.
    """
    merged = resolve_spans([*spans, *manual_spans(text, list(manual))]) if manual else list(spans)
    active = [s for s in merged if key_of(s.type, s.text) not in disabled]
    pseudo = mode == "pseudonymize"
    out, rows = sanitize_text(text, active, mode, link_name_parts(active) if pseudo else {})
    found: list[Identity] = []
    if pseudo:
        rows, found = resolve_identities(active, rows, text)
    extra = list(custom) if pseudo else []
    offered = [(i.id, i.label) for i in found] + extra
    member = {p: i.id for i in found for p in i.placeholders}
    for m in rows:
        key = key_of(m.type, m.original)
        if key in (assignments or {}):
            to = assignments[key]
            if to is None:
                member.pop(m.placeholder, None)
            elif any(to == g for g, _ in offered):
                member[m.placeholder] = to
    head: dict[tuple[int, str], str] = {}
    renamed: dict[str, str] = {}
    for m in rows:
        if m.placeholder in member:
            first = head.setdefault((member[m.placeholder], m.type), m.placeholder)
            if first != m.placeholder:
                renamed[m.placeholder] = first
    for old, new in renamed.items():
        out = out.replace(old, new)
    new_name = lambda p: renamed.get(p, p)
    rows = [Mapping(new_name(m.placeholder), m.original, m.type, m.identity_id) for m in rows]
    found = [Identity(i.id, i.label, list(dict.fromkeys(map(new_name, i.placeholders)))) for i in found]
    member = {new_name(p): g for p, g in member.items()}
    inside = lambda g: [m for m in rows if member.get(m.placeholder) == g]
    groups = [(i.id, i.label, inside(i.id)) for i in found if inside(i.id)] + [(g, label, inside(g)) for g, label in extra]
    removed = {key_of(s.type, s.text): s for s in reversed(merged) if key_of(s.type, s.text) in disabled}
    return MappingView(
        text=out,
        rows=rows,
        identities=found,
        groups=groups,
        ungrouped=[m for m in rows if m.placeholder not in member],
        assignable=offered,
        empty_custom=[g for g, _ in extra if not inside(g)],
        member_of=member,
        removed=[(k, s.type, s.text) for k, s in sorted(removed.items(), key=lambda kv: kv[1].start)],
        active=active,
    )


#: What a user may override in a document; any part may be null.
OVERRIDES = (
    "struct<disabled: array<string>, assignments: map<string, int>, manual: array<struct<type: string, value: string>>,"
    " custom: array<struct<id: int, label: string>>>"
)
_REMOVED = "array<struct<key: string, type: string, text: string>>"
_REMOVED_ARROW = pa.list_(pa.struct([("key", pa.string()), ("type", pa.string()), ("text", pa.string())]))


def mapping_views(
    df: DataFrame, text_col: str = "text", spans_col: str = "spans", overrides_col: str | None = None, mode: str = "redact"
) -> DataFrame:
    """df with view_text, view_mapping, view_identities and view_removed; overrides_col is of type OVERRIDES."""
    asked = F.lit(None) if overrides_col is None else F.col(overrides_col)
    out = df.withColumn("_overrides", asked.cast(OVERRIDES))

    def work(text, spans, asked):
        if text is None:
            return None, [], [], []
        o = asked or {}
        view = build_mapping_view(
            text,
            spans_of(spans or []),
            mode,
            frozenset(o.get("disabled") or ()),
            dict(o.get("assignments") or ()),
            [(e["type"], e["value"]) for e in o.get("manual") or ()],
            [(e["id"], e["label"]) for e in o.get("custom") or ()],
        )
        removed = [dict(zip(("key", "type", "text"), r, strict=True)) for r in view.removed]
        return view.text, [m.__dict__ for m in view.rows], [i.__dict__ for i in view.identities], removed

    made = {
        "view_text": ("string", pa.string()),
        "view_mapping": (MAPPING, MAPPING_ARROW),
        "view_identities": (IDENTITIES, IDENTITY_ARROW),
        "view_removed": (_REMOVED, _REMOVED_ARROW),
    }
    return add_columns(out, [text_col, spans_col, "_overrides"], made, work).drop("_overrides")


__all__ = ["OVERRIDES", "MappingView", "build_mapping_view", "key_of", "mapping_views", "resolve_spans"]
