"""Checksums and structural rules as Catalyst expressions over string columns."""

from __future__ import annotations

# Registered IBAN lengths by country; fixed values.
IBAN_LENGTHS = dict(
    p.split(":")
    for p in (
        "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28"
        " EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26"
        " IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30"
        " NI:28 NL:18 NO:15 OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27"
        " SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30"
    ).split()
)
IBAN_LENGTHS = {k: int(v) for k, v in IBAN_LENGTHS.items()}


def luhn(digits: str) -> str:
    """13 to 19 digits with a valid check digit."""
    return f"({digits} rlike '^[0-9]{{13,19}}$' and luhn_check({digits}))"


def mod97(code: str) -> str:
    """The remainder of an IBAN whose first four characters go to the end."""
    turned = f"concat(substring({code}, 5), substring({code}, 1, 4))"
    return (
        f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (a, c) ->"
        " if(c between '0' and '9', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97))"
    )


def iban_length(country: str) -> str:
    """The registered length of a country, or null."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items())
    return f"map({pairs})[{country}]"


def iban(raw: str) -> str:
    """Shape, registered length if there is one, and checksum."""
    c = f"upper(regexp_replace({raw}, '\\\\s', ''))"
    shape = f"{c} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}$'"
    length = f"coalesce({iban_length(f'substring({c}, 1, 2)')} = length({c}), true)"
    return f"if({shape} and {length}, {mod97(c)} = 1, false)"


def ssn(value: str) -> str:
    """AAA-GG-SSSS that can have been assigned."""
    return f"({value} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$')"


def itin(value: str) -> str:
    g = f"int(substring({value}, 5, 2))"
    ranges = f"({g} between 50 and 65 or {g} between 70 and 88 or {g} between 90 and 92 or {g} between 94 and 99)"
    return f"if({value} rlike '^9[0-9]{{2}}-[0-9]{{2}}-(?!0000)[0-9]{{4}}$', {ranges}, false)"


def tax_id(digits: str) -> str:
    """German tax number: one digit two or three times in the first ten, ISO 7064 MOD 11,10."""
    first = f"filter(split(substring({digits}, 1, 10), ''), c -> c <> '')"
    counts = f"transform(array_distinct({first}), d -> size(filter({first}, c -> c = d)))"
    structure = f"size(filter({counts}, n -> n > 1)) = 1 and array_max({counts}) <= 3"
    step = "(a, c) -> if((int(c) + a) % 10 = 0, 20, (int(c) + a) % 10 * 2) % 11"
    check = f"(11 - aggregate({first}, 10, {step})) % 10 = int(substring({digits}, 11, 1))"
    return f"if({digits} rlike '^[1-9][0-9]{{10}}$', {structure} and {check}, false)"


def card_network(digits: str) -> str:
    """Whether number and length fit a card network: Amex, Visa, Mastercard, Discover, JCB, Diners."""
    d = digits
    p2, p3, p4 = (f"int(substring({d}, 1, {n}))" for n in (2, 3, 4))
    return (
        f"case length({d})"
        f" when 14 then {p3} between 300 and 305 or {p4} = 3095 or {p2} in (36, 38, 39)"
        f" when 15 then {p2} in (34, 37)"
        f" when 16 then {d} like '4%' or {p2} between 51 and 55 or {p4} between 2221 and 2720 or {p4} = 6011"
        f" or {p2} = 65 or {p3} between 644 and 649 or {p4} between 3528 and 3589"
        f" when 19 then {d} like '4%' else false end"
    )


def compact_date_ref(value: str) -> str:
    """YYYYMMDD, a separator and up to four digits, with a possible date."""
    n = lambda a, b: f"int(substring({value}, {a}, {b}))"
    return (
        f"if({value} rlike '^[0-9]{{8}}[./-][0-9]{{1,4}}$', {n(1, 4)} between 1900 and 2099"
        f" and {n(5, 2)} between 1 and 12 and {n(7, 2)} between 1 and 31, false)"
    )


def date_shaped(value: str) -> str:
    """A date with an optional counter and time: year first, or year last with a possible day and month."""
    tail = "(?:[./-][0-9]{1,4})?(?:[ T][0-9]{1,2}(?::[0-9]{2}){0,2})?$"
    a, b = f"int(split({value}, '[./-]')[0])", f"int(split({value}, '[./-]')[1])"
    return (
        f"case when {value} rlike '^[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}{tail}' then true"
        f" when {value} rlike '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}{tail}'"
        f" then least({a}, {b}) >= 1 and greatest({a}, {b}) <= 31 and least({a}, {b}) <= 12 else false end"
    )


def ipv6(value: str) -> str:
    """An IPv6 address with an optional zone and an embedded IPv4 tail."""
    octet = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2}|0[0-9]{2})"
    a = f"regexp_replace(regexp_replace({value}, '%.*$', ''), ':{octet}(?:\\\\.{octet}){{3}}$', ':0:0')"
    groups = f"filter(split({a}, ':', -1), g -> g <> '')"
    hexed = f"forall({groups}, g -> g rlike '^[0-9a-fA-F]{{1,4}}$')"
    short = f"size(split({a}, '::', -1)) = 2 and not {a} rlike ':::|^:[^:]|[^:]:$' and size({groups}) between 1 and 7 and {hexed}"
    whole = f"{a} rlike '^(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}$'"
    return f"(not {value} rlike '%$' and if({a} like '%::%', {short}, {whole}))"
