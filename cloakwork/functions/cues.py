"""Words that stand around personal data, and patterns put together from them.

The tables are fixed values: membership decides results.  In them `_` stands for any white
space, `.` for a full stop that may be missing and `?` for an ending letter that may be missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from .spans import B0, B1, WS

# Fixed values.
CARD_BRANDS = "card visa mastercard amex american+express discover maestro unionpay jcb diners"
CARD_LABELS = "card no. number #"
PASSPORTS = "passport reisepass passnummer"
PASSPORT_KINDS = "document doc. dokument dok. book booklet"
PASSPORT_LABELS = "number num. no. nr. reference ref. code id document"
BIRTH_CUES = "date_of_birth birth_date birthdate d.o.b. born_on born geburtsdatum geburtstag geboren_am geboren geb."
BIRTH_PAPERS = "birth_certificates birth_certificate birth_records birth_record birthcertificates birthcertificate birthrecords birthrecord geburtsurkunde geburtsregister geburtseintrag"
OF_WHOM = "of for von des der für"
MONTH_STEMS = "jan feb mar apr may jun jul aug sep sept oct nov dec"
MONTHS = "januar februar märz marz april mai juni juli august september oktober november dezember"
MAC_CUES = "mac bssid hwaddr ether"
IBAN_VERBS = "is was number no. reads"
ACCOUNTS = "account acct. a/c"
ACCOUNT_VERBS = "number no. is was reads"
DOUBTS = "fraudulent fraud fake decoy bogus spoofed phishing sample example dummy placeholder fictitious invalid specimen"


def one_of(table: str | Iterable[str], blank: str = WS, any_case: bool = False) -> str:
    """Alternatives for the words of a table; with any_case the first letter may be a capital."""
    out = []
    for w in table.split() if isinstance(table, str) else table:
        x = ""
        for i, c in enumerate(w):
            if c == "_":
                x += f"{blank}+"
            elif c == "+":
                x += " "
            elif c == ".":
                x += r"\.?"
            elif any_case and i == 0 and c.isalpha():
                x += f"[{c.upper()}{c}]"
            else:
                x += re.escape(c) if c in "/#" else c
        out.append(x)
    return "(?:" + "|".join(out) + ")"


def maybe(x: str) -> str:
    return f"(?:{x})?"


def word(x: str) -> str:
    """x, with nothing of a word right before or behind it."""
    return f"{B0}{x}{B1}"


def dates() -> str:
    """Numeric dates by template, and dates with the name of a month in front or behind the day."""
    day, month, year, full = "[0-9]{1,2}", f"(?:{one_of(MONTH_STEMS)}[a-z]*\\.?|{one_of(MONTHS)})", "[0-9]{2,4}", "[0-9]{4}"
    nth, gap = f"{day}{maybe(one_of('st nd rd th'))}", f"(?:{WS}|-)+"
    return "|".join(
        (
            f"{full}-{day}-{day}",
            f"{day}[-./]{day}[-./]{year}",
            f"{month}{gap}{nth},?{gap}{year}",
            f"{nth}\\.?{gap}{month},?{gap}{year}",
        )
    )


def mac_form(size: int, groups: int, marks: str, alone: str, ends: str) -> str:
    """Hex groups parted by one and the same of marks; alone may not stand before, ends not behind."""
    part = f"[0-9A-Fa-f]{{{size}}}"
    mark = f"([{marks}])" if len(marks) > 1 else re.escape(marks)
    again = r"\1" if len(marks) > 1 else re.escape(marks)
    return f"(?<![A-Za-z0-9_{alone}]){part}{mark}(?:{part}{again}){{{groups - 2}}}{part}{ends}"
