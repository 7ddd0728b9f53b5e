"""Coreference of name parts, placeholders, rewriting, and grouping into identities."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import regex

from ..functions.lexicons import DEFAULT, Lexicons
from ..functions.text import latin_fold, norm_name
from .names import Span

_PUNCT = regex.compile(r"[^\p{L}\p{N}-]")
_SEPARATORS = re.compile(r"[._-]+")
#: Types that join an identity by standing on one of its lines.
ATTACHED = ("PHONE", "IBAN", "IP", "CREDIT_CARD")


@dataclass
class Mapping:
    placeholder: str
    original: str
    type: str
    identity_id: int | None = None


@dataclass
class Identity:
    id: int
    label: str
    placeholders: list[str]


def _words(name: str) -> list[str]:
    return [w for w in (_PUNCT.sub("", x) for x in name.split()) if w]


def _glued(name: str, lex: Lexicons) -> set[str]:
    """Spellings of a full name in one word: johnsmith, smithjohn, jsmith, smithj."""
    out: set[str] = set()
    for norm in (norm_name, lambda w: latin_fold(w.lower())):
        parts = [p for p in (norm(w).replace("-", "") for w in _words(name)) if p]
        if len(parts) < 2 or len(parts[0]) < 2:
            continue
        given = parts[0]
        for family in {"".join(parts[1:]), "".join(p for p in parts[1:] if p not in lex.particles)}:
            if len(family) >= 2:
                out |= {given + family, family + given}
            if len(family) >= 4:
                out |= {given[0] + family, family + given[0]}
    return out


def link_name_parts(spans: list[Span], lex: Lexicons = DEFAULT) -> dict[str, tuple[str, str]]:
    """lower-cased partial name -> (lower-cased full name, its spelling), where only one fits."""
    first: dict[str, str] = {}
    for s in spans:
        if s.type == "PERSON":
            first.setdefault(s.text.lower(), s.text)
    tokens = {k: [norm_name(w) for w in _words(v)] for k, v in first.items()}

    def part_of(a: str, b: str) -> bool:
        x, y = tokens[a], tokens[b]
        return 0 < len(x) < len(y) and (y[: len(x)] == x or y[-len(x) :] == x)

    full = [k for k in first if len(tokens[k]) >= 2]
    whole = [k for k in full if not any(part_of(k, o) for o in full)]
    links = {}
    for k in first:
        hosts = [w for w in whole if part_of(k, w)]
        if not hosts and len(tokens[k]) == 1 and len(one := tokens[k][0].replace("-", "")) >= 5:
            hosts = [w for w in whole if w != k and one in _glued(first[w], lex)]
        if len(hosts) == 1:
            links[k] = (hosts[0], first[hosts[0]])
    return links


def sanitize_text(
    text: str, spans: list[Span], mode: str = "redact", links: dict[str, tuple[str, str]] | None = None
) -> tuple[str, list[Mapping]]:
    """The text with a placeholder for each span, and one mapping row for each distinct value."""
    if mode not in ("redact", "pseudonymize"):
        raise ValueError(f"unknown mode {mode}")
    links = links or {}
    numbers: dict[str, int] = {}
    rows: dict[tuple[str, str], Mapping] = {}
    out, at = [], 0
    for s in sorted(spans, key=lambda s: s.start):
        low = s.text.lower()
        key, original = links.get(low, (low, s.text)) if s.type == "PERSON" else (low, s.text)
        row = rows.get((s.type, key))
        if row is None:
            n = numbers[s.type] = numbers.get(s.type, 0) + 1
            row = Mapping(f"[{s.type}]" if mode == "redact" else f"[{s.type}_{n}]", original, s.type)
            rows[s.type, key] = row
        out += [text[at : s.start], row.placeholder]
        at = s.end
    return "".join([*out, text[at:]]), list(rows.values())


@dataclass
class _Draft:
    label: str
    placeholders: list[str]
    tokens: list[str] = field(default_factory=list)
    lines: set[int] = field(default_factory=set)


def _person_tokens(name: str, lex: Lexicons) -> list[str]:
    out = []
    for w in map(norm_name, _words(name)):
        out += [w, *w.split("-")] if "-" in w else [w]
    return [w for w in out if len(w) >= 3 and w not in lex.particles]


def resolve_identities(
    spans: list[Span], mapping: list[Mapping], text: str, lex: Lexicons = DEFAULT
) -> tuple[list[Mapping], list[Identity]]:
    """Group a person with the addresses and numbers that belong together; rows get an identity id."""
    # the lines of every value, from one pass over the text
    lines: dict[tuple[str, str], set[int]] = {}
    line, at = 0, 0
    for s in sorted(spans, key=lambda s: s.start):
        line += text.count("\n", at, s.start)
        at = s.start
        lines.setdefault((s.type, s.text.lower()), set()).add(line)
    of = lambda m: lines.get((m.type, m.original.lower()), set())

    drafts = [_Draft(m.original, [m.placeholder], _person_tokens(m.original, lex), set(of(m))) for m in mapping if m.type == "PERSON"]
    for m in (m for m in mapping if m.type == "EMAIL"):
        local = m.original.partition("@")[0]
        parts = [p for p in _SEPARATORS.split(norm_name(local)) if p]

        def fit(d: _Draft, parts=parts) -> int:
            return sum(any(p == t or p.endswith(t) and len(p) - len(t) <= 2 for p in parts) for t in d.tokens)

        best = max(drafts, key=fit, default=None)
        if best is not None and fit(best) > 0:
            best.placeholders.append(m.placeholder)
            best.lines |= of(m)
        else:
            drafts.append(_Draft(local, [m.placeholder], [], set(of(m))))
    for m in (m for m in mapping if m.type in ATTACHED):
        target = next((d for d in drafts if len(d.placeholders) >= 2 and d.lines & of(m)), None)
        if target is not None:
            target.placeholders.append(m.placeholder)
    groups = [d for d in drafts if len(d.placeholders) >= 2]
    found = [Identity(i, d.label, d.placeholders) for i, d in enumerate(groups, 1)]
    owner = {p: i.id for i in found for p in i.placeholders}
    return [Mapping(m.placeholder, m.original, m.type, owner.get(m.placeholder)) for m in mapping], found
