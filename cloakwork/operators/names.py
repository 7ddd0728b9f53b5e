"""Person names by dictionary, cue words and capitalisation.

A text is read once from left to right.  Facts about each token are worked out on
demand and kept: whether it is capitalised, what the dictionary knows of it, what gap
precedes it.  A chain of tokens starts where a cue or the dictionary allows it, grows
over name-like tokens and particles, is scored, and its tokens are used up whether or
not the score suffices.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import regex

from ..functions.lexicons import DEFAULT, Lexicons
from ..functions.text import BICAMERAL, CASELESS, Token, is_capitalized, latin_fold, norm_name, strip_digits, tokenize

CORE, EXT = 2, 1
_BLANK = r"[^\S\n\r]"
GAP = re.compile(rf"{_BLANK}+")
DOT_GAP = re.compile(rf"\.{_BLANK}+")
LOOSE_GAP = re.compile(rf"{_BLANK}*\.?{_BLANK}*")
LABEL_GAP = re.compile(rf"{_BLANK}*:{_BLANK}+")
OPEN_GAP = re.compile(rf"{_BLANK}*\({_BLANK}*")
CLOSE = re.compile(rf"{_BLANK}*\)")
IDENTIFIER = re.compile(rf"{_BLANK}*(?::{_BLANK}*)?(?=[A-Za-z-]*[0-9])[A-Za-z0-9-]+")
STARTERS = frozenset('.!?:;\n\r"“”(')
ACRONYM = re.compile(r"[A-Z]{2,4}")


class Dictionary:
    """Known names by script with their tier; core beats ext."""

    def __init__(self, rows: Iterable[tuple[str, str, str]] = ()):
        """rows: (script, tier, name)."""
        self.names: dict[str, dict[str, int]] = {}
        self._firsts: frozenset[str] | None = None
        for script, tier, name in rows:
            known = self.names.setdefault(script, {})
            name = name.lower()
            known[name] = max(known.get(name, 0), CORE if tier == "core" else EXT)

    def with_core(self, folded: Iterable[str]) -> Dictionary:
        """Also these Latin words, compared without diacritics, as core names."""
        out = Dictionary()
        out.names = dict(self.names)
        out.names["Latin"] = _Folded(self.names.get("Latin", {}), frozenset(folded))
        return out

    def exact(self, word: str, script: str) -> int:
        known = self.names.get(script)
        if not known:
            return 0
        t = known.get(word, 0)
        if t < CORE and script == "Latin" and not word.isascii():
            t = max(t, known.get(latin_fold(word), 0))
        return t

    def _compounds(self) -> frozenset[str]:
        """The first runs of letters of names that hold a hyphen or an apostrophe."""
        if self._firsts is None:
            whole = (n for known in self.names.values() if isinstance(known, dict) for n in known)
            self._firsts = frozenset(_LETTERS.match(n)[0] for n in whole if not n.isalpha() and _LETTERS.match(n))
        return self._firsts

    def may_hold(self, text: str, cues: frozenset[str]) -> bool:
        """False only if no word of text is in the dictionary, by any of its pieces, and none is a cue."""
        low = text.lower()
        if low.isascii():
            words = set(_ASCII_LETTERS.findall(low))
        else:
            words = set(_LETTERS.findall(low))
            words |= {latin_fold(w) for w in words if not w.isascii()}
        if "'" in low or "’" in low:
            words |= {a + b for a, b in _ROOTED.findall(low)}
        if not words.isdisjoint(cues) or not words.isdisjoint(self._compounds()):
            return True
        for known in self.names.values():
            if isinstance(known, dict):
                if not known.keys().isdisjoint(words):
                    return True
            elif any(known.get(w, 0) for w in words):
                return True
        return False

    def pieces(self, word: str) -> list[str]:
        """What stands for a word the dictionary does not hold: hyphen parts, else its apostrophe roots."""
        if "-" in word:
            return word.split("-")
        if len(word) > 2 and word[1] in "'’":
            return [word[2:], word[0] + word[2:]]
        return []

    def known(self, word: str, script: str = "Latin") -> bool:
        low = word.lower()
        return self.exact(low, script) > 0 or any(self.exact(p, script) for p in self.pieces(low))

    def tier(self, word: str, script: str = "Latin") -> int:
        low = word.lower()
        roots = [low[2:], low[0] + low[2:]] if len(low) > 2 and low[1] in "'’" else []
        parts = low.split("-") if "-" in low else []
        return max(self.exact(p, script) for p in (low, *parts, *roots))


_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_ASCII_LETTERS = re.compile("[a-z]+")
_ROOTED = regex.compile(r"([\p{L}\p{M}])['’]([\p{L}\p{M}]+)")


class _Folded:
    """Latin names plus a few words known by their folded form; the names are not copied."""

    def __init__(self, base: dict[str, int], words: frozenset[str]):
        self.base, self.words = base, words

    def __len__(self) -> int:
        return len(self.base) + len(self.words)

    def get(self, word, default=0):
        return CORE if latin_fold(word) in self.words else self.base.get(word, default)


@dataclass
class Span:
    start: int
    end: int
    type: str
    text: str
    confidence: float
    source: str


def score(parts: int, title: bool, role: bool, hits: int, core: bool, ambiguous: bool, at_start: bool) -> float:
    """Confidence of a chain; terms are added in this order, since scores are compared."""
    ext_only = hits > 0 and not core
    s = 0.3
    for on, weight in (
        (hits > 0, 0.3),
        (hits >= 2, 0.1),
        (parts >= 2, 0.25),
        (title, 0.35),
        (role and parts >= 2, 0.3),
        (core, 0.05),
        (ambiguous and not title, -0.35),
        (ambiguous and at_start and not title, -0.2),
        (ambiguous and ext_only and not title, -0.3),
        (parts == 1 and ext_only and not title, -0.2),
    ):
        if on:
            s += weight
    return max(0.0, min(1.0, s))


@dataclass
class Reader:
    """One text with its tokens and what is known of them."""

    text: str
    names: Dictionary
    lex: Lexicons = DEFAULT
    tokens: list[Token] = field(default_factory=list)

    def __post_init__(self):
        self.tokens = self.tokens or tokenize(self.text)

    # facts about one token

    def low(self, i: int) -> str:
        return self.tokens[i].text.lower()

    def hit(self, i: int) -> bool:
        return self.names.known(self.tokens[i].text, self.tokens[i].script)

    def tier(self, i: int) -> int:
        return self.names.tier(self.tokens[i].text, self.tokens[i].script)

    def particle(self, i: int) -> bool:
        return self.low(i).strip("'’-") in self.lex.particles

    def title(self, i: int) -> bool:
        return self.low(i) in self.lex.titles

    def role(self, i: int) -> bool:
        return self.low(i) in self.lex.roles or self.low(i) in self.lex.role_abbreviations

    def non_name(self, i: int) -> bool:
        return self.low(i) in self.lex.non_names

    def acronym(self, i: int) -> bool:
        return ACRONYM.fullmatch(self.tokens[i].text) is not None

    def glued(self, i: int) -> bool:
        """al-Rashid: a particle and a capitalised rest in one token."""
        t = self.tokens[i]
        head, sep, tail = t.text.partition("-")
        return t.script == "Latin" and bool(head) and bool(sep) and head.lower() in self.lex.particles and is_capitalized(tail)

    def cased(self, i: int) -> bool:
        """Looks like a name in a script with capitals: Anna, al-Rashid, d'Arcy."""
        t = self.tokens[i]
        if is_capitalized(t.text) or self.glued(i):
            return True
        return t.script == "Latin" and len(t.text) > 2 and t.text[1] in "'’" and is_capitalized(t.text[2:])

    def numbered(self, i: int) -> bool:
        """Runs into a digit, or is a label such as No. before a value."""
        t = self.tokens[i]
        nxt = self.text[t.end : t.end + 1]
        if nxt and nxt in "0123456789":
            return True
        if t.script != "Latin":
            return False
        low = t.text.lower()
        if low in ("nº", "n°"):
            return True
        return low in ("no", "nr") and (nxt == "." or IDENTIFIER.match(self.text, t.end) is not None)

    def gap(self, i: int, pattern: re.Pattern) -> bool:
        """Whether what stands between token i - 1 and i is such a gap."""
        return pattern.fullmatch(self.text, self.tokens[i - 1].end, self.tokens[i].start) is not None

    def at_start(self, pos: int) -> bool:
        left = self.text[:pos] if pos < 64 else self.text[pos - 64 : pos]
        rest = re.sub(rf"{_BLANK}+$", "", left)
        if not rest and pos > 64:
            rest = re.sub(rf"{_BLANK}+$", "", self.text[:pos])
        return not rest or rest[-1] in STARTERS

    # runs of tokens

    def past_particles(self, i: int) -> int:
        """The last of the particles that follow token i."""
        while i + 1 < len(self.tokens) and self.particle(i + 1) and self.gap(i + 1, GAP):
            i += 1
        return i

    def follower(self, i: int) -> int | None:
        """The capitalised, unlabelled, ordinary token that continues a name after i."""
        j = self.past_particles(i) + 1
        if j >= len(self.tokens) or not self.gap(j, GAP):
            return None
        if self.tokens[j].script not in BICAMERAL or not self.cased(j) or self.acronym(j) or self.numbered(j):
            return None
        return None if self.non_name(j) or self.role(j) or self.title(j) else j

    def grows(self, i: int, unknown: bool) -> bool:
        """Whether token i can be the next part of a name."""
        script = self.tokens[i].script
        if script in BICAMERAL:
            ok = self.cased(i) and not self.acronym(i) and (unknown or self.hit(i))
        else:
            ok = script in CASELESS and self.hit(i)
        return ok and not self.non_name(i) and not self.numbered(i)

    def cues(self, i: int, tail: int) -> tuple[bool, bool]:
        """(title, role) before token i, unless the token before ended a name."""
        if i == 0 or i - 1 == tail:
            return False, False
        title = self.title(i - 1) and self.gap(i, LOOSE_GAP)
        role = False
        if self.role(i - 1):
            loose = self.low(i - 1) in self.lex.role_abbreviations
            role = self.gap(i, LOOSE_GAP if loose else GAP) or self.gap(i, LABEL_GAP)
        if not role and i >= 2 and self.gap(i, GAP) and self.gap(i - 1, GAP):
            pair = self.low(i - 2), self.low(i - 1)
            role = any(pair[0] in words and pair[1] == link for words, link in self.lex.frames)
        return title, role

    def start(self, i: int, tail: int) -> tuple[bool, bool, bool] | None:
        """(title, role, hit) if a name can start at token i."""
        t = self.tokens[i]
        if t.script in ("Han", "Other") or self.numbered(i):
            return None
        title, role = self.cues(i, tail)
        hit = self.hit(i)
        if t.script not in BICAMERAL:
            return (title, role, hit) if hit or title or role else None
        capital = is_capitalized(t.text)
        if title or role:
            if not capital and self.particle(i) and self.follower(i) is not None:
                return title, role, False
            if self.glued(i) and self.follower(i) is not None:
                return title, role, hit
        if not capital or self.acronym(i):
            return None
        opener = self.low(i) in self.lex.openers
        if hit and not title and not role and self.tier(i) != CORE and self.at_start(t.start):
            if opener or self.non_name(i) or self.follower(i) is None:
                return None
        if title or hit or (role and not self.non_name(i)):
            return title, role, hit
        if opener or self.low(i) in self.lex.ambiguous or self.non_name(i) or self.role(i) or self.title(i):
            return None
        j = self.follower(i)
        if j is not None and self.hit(j) and self.tier(j) == EXT and self.low(j) not in self.lex.ambiguous:
            return False, False, False
        return None

    def alias(self, i: int) -> bool:
        """Whether token i is a bracketed other name of what stands before it."""
        if i >= len(self.tokens) or not self.gap(i, OPEN_GAP):
            return False
        t, low = self.tokens[i], self.low(i)
        if t.script != "Latin" or not is_capitalized(t.text) or not re.search("[a-z]", t.text):
            return False
        if self.text[t.end : t.end + 1].isdigit() or self.title(i) or self.role(i) or self.non_name(i):
            return False
        if low in self.lex.ambiguous or low in self.lex.countries or low in self.lex.cities:
            return False
        return CLOSE.match(self.text, t.end) is not None

    def find(self, least: float) -> list[Span]:
        out: list[Span] = []
        i, tail, n = 0, -1, len(self.tokens)
        while i < n:
            t = self.tokens[i]
            # without a capital, only caseless scripts and particles can start a name
            if t.script == "Latin" and t.text[0].islower():
                word = t.text.lower()
                if word not in self.lex.particles and ("-" not in word or not self.glued(i)):
                    i += 1
                    continue
            first = self.start(i, tail)
            if first is None:
                i += 1
                continue
            title, role, hit = first
            tiers = [self.tier(i)] if hit else []
            parts, j = 1, i
            while j + 1 < n:
                last = self.tokens[j].text
                initial = len(last) == 1 and is_capitalized(last) and self.gap(j + 1, DOT_GAP)
                if not initial and not self.gap(j + 1, GAP):
                    break
                if self.particle(j + 1):
                    k = self.past_particles(j + 1) + 1
                    if k >= n or not self.gap(k, GAP) or not self.grows(k, True):
                        break
                else:
                    k = j + 1
                    if not self.grows(k, title or role or hit or bool(tiers)):
                        break
                if self.hit(k):
                    tiers.append(self.tier(k))
                parts, j = parts + 1, k
            if parts == 1 and (self.title(i) or self.low(i) in self.lex.role_abbreviations):
                i = j + 1
                continue
            a, b = self.tokens[i].start, self.tokens[j].end
            conf = score(
                parts, title, role, len(tiers), CORE in tiers, parts == 1 and self.low(i) in self.lex.ambiguous, self.at_start(a)
            )
            i = j + 1
            if conf >= least:
                out.append(Span(a, b, "PERSON", self.text[a:b], conf, "names"))
                tail = j
                if self.alias(j + 1):
                    t = self.tokens[j + 1]
                    out.append(Span(t.start, t.end, "PERSON", t.text, 0.85, "names"))
                    tail, i = j + 1, j + 2
        return out


@functools.lru_cache(maxsize=8)
def cue_words(lex: Lexicons) -> frozenset[str]:
    """Words without which, and without the dictionary, no name starts."""
    before = frozenset().union(*(words for words, _ in lex.frames)) if lex.frames else frozenset()
    whole = lex.titles | lex.roles | lex.role_abbreviations | before
    return frozenset(m[0] for w in whole if (m := _LETTERS.match(w)))


def find_names(text: str, names: Dictionary, least: float = 0.5, lex: Lexicons = DEFAULT) -> list[Span]:
    if not names.may_hold(text, cue_words(lex)):
        return []
    return Reader(text, names, lex).find(least)


# Names that e-mail addresses give away ------------------------------------------------

_SEPARATORS = re.compile(r"[._-]+")
_UP, _LOW = "A-ZÀ-ÖØ-ÞĀ-ɏ", "a-zß-öø-ÿĀ-ɏ"
_TITLED = f"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)*"
_BEFORE = re.compile(rf"(?:^|[^{_UP}{_LOW}])({_TITLED}(?:\s+{_TITLED}){{1,2}})\s*$")
#: Characters before an address in which its owner's name is looked for.
NEAR_ADDRESS = 400


def _segments(local: str, lex: Lexicons) -> list[str]:
    """The parts of a mailbox name; none for mailboxes that belong to no person."""
    parts = [p for p in _SEPARATORS.split(local) if p]
    return [] if local in lex.mailboxes or any(p in lex.mailboxes for p in parts) else parts


def names_in_address(local: str, names: Dictionary, lex: Lexicons = DEFAULT) -> list[tuple[str, str]]:
    """(folded name, given or family) that the part before @ holds."""
    parts = _segments(local.lower(), lex)
    out: dict[str, str] = {}
    if len(parts) > 1:
        for k, p in enumerate(parts):
            p = strip_digits(p)
            if len(p) >= 2 and names.known(p):
                out.setdefault(latin_fold(p), "family" if k == len(parts) - 1 else "given")
    elif parts:
        p = strip_digits(parts[0])
        if len(p) >= 2 and names.known(p):
            out[latin_fold(p)] = "family"
        elif len(p) >= 4 and names.known(p[1:]):
            out[latin_fold(p[1:])] = "family"
    return [(n, k) for n, k in out.items() if len(n) >= 2]


def names_beside_address(text: str, start: int, address: str, lex: Lexicons = DEFAULT) -> list[str]:
    """Folded words of a name that stands right before a bracketed address and agrees with it."""
    head = text[max(0, start - NEAR_ADDRESS) : start].rstrip(" \t")
    if not head or head[-1] not in "(<[":
        return []
    m = _BEFORE.search(head[:-1])
    local, at, _ = address.partition("@")
    parts = _segments(local.lower(), lex)
    if not m or not at or not parts:
        return []
    words = m[1].split()
    folded = [latin_fold(w.lower()) for w in words]
    stop = (lex.titles, lex.roles, lex.role_abbreviations, lex.non_names, lex.ambiguous)
    if any(w.lower() in s for w in words for s in stop):
        return []
    long_, initials = [p for p in parts if len(p) >= 4], [p for p in parts if len(p) == 1]
    if len(parts) > 1:
        if len(long_) != 1 or not initials or len(initials) + 1 != len(parts) or latin_fold(long_[0]) not in folded:
            return []
        free = set(range(len(folded))) - {folded.index(latin_fold(long_[0]))}
        for c in initials:
            k = next((k for k in sorted(free) if folded[k][0] == latin_fold(c)), None)
            if k is None:
                return []
            free.remove(k)
    else:
        own = latin_fold(parts[0])
        if len(parts[0]) < 4 or folded.count(own) != 1 or all(latin_fold(w.lower()) == w.lower() for w in words):
            return []
        if sum(len(w) for w, f in zip(words, folded, strict=True) if f != own) < 6:
            return []
    return [f for f in folded if len(f) >= 2]


# Other spellings of names that were found ----------------------------------------------


def _spellings(given: str, family: str) -> set[str]:
    pairs = [(given, family), (family, given)]
    if len(family) >= 4:
        pairs += [(given[0], family), (family, given[0])]
    return {a + sep + b for a, b in pairs for sep in (".", "_", "-", "") if len(a + sep + b) >= 5}


def find_variants(text: str, people: list[Span], lex: Lexicons = DEFAULT) -> list[Span]:
    """Spellings such as j.smith or smithjohn of people found before, not before an @."""
    forms: set[str] = set()
    for name in {p.text.lower() for p in people if p.type == "PERSON"}:
        for norm in (norm_name, latin_fold):
            parts = [re.sub(r"[^a-z0-9]", "", norm(t.text.lower())) for t in tokenize(name)]
            parts = [p for p in parts if p]
            if len(parts) < 2 or not re.fullmatch(r"[a-z]{2,}", parts[0]):
                continue
            for rest in ("".join(parts[1:]), "".join(p for p in parts[1:] if p not in lex.particles)):
                if re.fullmatch(r"[a-z]{2,}", rest):
                    forms |= _spellings(parts[0], rest)
    if not forms:
        return []
    any_ = "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f)))
    found = regex.finditer(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{any_})(?![\p{{L}}\p{{N}}@])", text)
    return [Span(m.start(), m.end(), "PERSON", m[0], 0.9, "name-variant") for m in found]


_URL = re.compile(r"(?i)(?:https?://|www\.)[^\s<>\"'`)\]}]+")
_PART = regex.compile(r"[\p{L}\p{M}]+")


def find_url_names(text: str, names: Dictionary, lex: Lexicons = DEFAULT) -> list[Span]:
    """Names in the path or query of explicit addresses: john.smith, j-smith, jsmith."""

    def stop(w: str) -> bool:
        low = w.lower()
        return any(low in s for s in (lex.url_words, lex.top_domains, lex.mailboxes, lex.non_names, lex.particles))

    def pair(a: str, b: str) -> bool:
        short, long_ = sorted((a, b), key=len)
        if len(short) == 1:
            return len(long_) >= 4 and not stop(long_) and names.known(long_)
        return not stop(a) and not stop(b) and names.known(a) and names.known(b)

    def initial(w: str) -> bool:
        return len(w) >= 5 and not stop(w) and not names.known(w) and not stop(w[1:]) and names.known(w[1:])

    out = []
    for url in _URL.finditer(text):
        body = url[0]
        host = body.find("://") + 3 if "://" in body else 0
        path = re.compile("[/?#]").search(body, host)
        if path is None:
            continue
        parts = [m for m in _PART.finditer(body) if m.start() >= path.start()]
        k = 0
        while k < len(parts):
            a, b = parts[k], parts[k + 1] if k + 1 < len(parts) else None
            end = None
            if b is not None and body[a.end() : b.start()] in (".", "_", "-", "+") and pair(a[0], b[0]):
                end, k = b.end(), k + 1
            elif initial(a[0]):
                end = a.end()
            if end is not None:
                s, e = url.start() + a.start(), url.start() + end
                out.append(Span(s, e, "PERSON", text[s:e], 0.9, "url"))
            k += 1
    return out
