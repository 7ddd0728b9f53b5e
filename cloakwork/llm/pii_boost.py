"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators of high recall propose spans that may overlap.  Each candidate gets format
features (lengths, digit and letter counts, checksums) and context features (cue words
and characters around it).  Boosted trees, trained on made-up examples that carry
their labels by construction, give log odds; each kind has its own threshold, the
least at which held-out examples are chosen with the wanted precision.  The base spans
that a contract fixes are found first and always stay; chosen candidates that overlap a
base span or a better candidate are left out.

Offsets are code points, ends exclusive.  Defined cases: a null text is treated as
empty; without candidates the span list is empty; equal scores go to the longer, then
to the earlier span; repeated rows are each searched; an empty table gives an empty one; texts
of any length are searched whole; other columns pass unchanged, whatever their names, except
that find_spans() replaces columns named base and spans.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Boosted, calibrated_threshold

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "mac", "secret", "ssn")
BASE = KINDS[:4]

#: The base formats.  Each starts only where a run starts or the last match ended, which
#: gives the same matches as the plain pattern without trying every place in a run.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BASE_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}

#: kind, pattern of each generator.  Lengths are bounded only where the format itself is: a phone
#: number has at most 15 digits, an IBAN at most 34 characters.
GENERATORS = (
    (
        "email",
        r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:[\[({<] ?at ?[\])}>]|@) ?[a-z0-9-]++"
        r"(?: ?(?:[\[({<] ?dot ?[\])}>]|\.) ?[a-z0-9-]{2,}+)++",
    ),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._-]++ at [a-z0-9-]++(?: dot [a-z0-9-]{2,}+)++"),
    ("phone", r"(?<![0-9A-Za-z+./-])(?:00 ?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,8}\)?){1,7}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+./-])[0-9]{9,13}(?![0-9A-Za-z])"),
    ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ ./-]{0,2}[0-9]{4}){2}[ ./-]{0,2}[0-9]{1,7}(?![0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,15}(?![A-Za-z0-9])"),
    ("mac", r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)
CUES = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|courriel|correo|kontakt)\W{0,4}(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|téléphone|teléfono|handy|anruf)\w*\W{0,4}(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip(?:v6)?\b|addr|host|server)\w*\W{0,4}(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|master|amex|karte|carte|tarjeta|payment)\w*\W{0,4}(?:\w+\W+){0,2}$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta|bank)\w*\W{0,4}(?:\w+\W+){0,2}$",
    "mac": r"(?i)(?:\bmac\b|ether|hwaddr|device)\w*\W{0,4}(?:\w+\W+){0,2}$",
    "secret": r"(?i)(?:token|secret|passw|passwd|api.?key|\bkey\b|credential|auth|bearer)\w*\W{0,6}$",
    "ssn": r"(?i)(?:ssn|social|security)\w*\W{0,4}(?:\w+\W+){0,2}$",
}
#: What stands right before a value that is assigned to a name, or that is a reference.
ASSIGNED = r"""[=:] *["']?$"""
REFERENCE = r"(?i)(?:no|nr|n°|id|ref|order|invoice|isbn|version|v|page|#|case|sha|commit|rev|checksum|md5)[.:#]? ?$"
FEATURES = (
    "kind_no", "len", "digits", "letters", "uppers", "others", "distinct_chars", "luhn", "mod97", "cue", "assigned",
    "ref_before", "hex", "groups", "at_word", "zero_group", "brackets", "blanks", "double_colon",
)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, pattern: str, gate: str | None = None) -> Column:
    """array<struct<s, e, m>> of the matches of pattern in the column text, by offset."""
    q = _sql(pattern)
    step = (
        "aggregate(zip_with({m}, slice({g}, 1, size({m})), (m, g) -> struct(m as m, length(g) as g)),"
        " cast((0, array()) as struct<pos: int, out: array<struct<s: int, e: int, m: string>>>),"
        " (a, x) -> named_struct('pos', a.pos + x.g + length(x.m), 'out', array_append(a.out,"
        " named_struct('s', a.pos + x.g, 'e', a.pos + x.g + length(x.m), 'm', x.m))), a -> a.out)"
    ).format(m=f"regexp_extract_all({text}, {q}, 0)", g=f"split({text}, {q}, -1)")
    empty = "cast(array() as array<struct<s: int, e: int, m: string>>)"
    return F.expr(f"if({text} rlike {_sql(gate or pattern)}, {step}, {empty})")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4
        tail = lambda p: F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), -3, 3)
        return F.forall(F.split(m, r"\."), lambda p: part(p) & (tail(p) <= "255"))
    n = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(n).between(13, 19) & F.call_function("luhn_check", n)
    return F.length(n).between(9, 15)


def _only_valid(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["m"]))


def _named(spans: Column, kind: str, *more: str) -> Column:
    """Spans as structs of kind, s, e and the fields named in more."""
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), *[x[k].alias(k) for k in ("s", "e", *more)]))


def candidates(text: str) -> Column:
    """All proposals: array<struct<kind, s, e, m, before, after>>."""
    parts = []
    for kind, pattern in GENERATORS:
        parts.append(_named(spans_of(text, pattern), kind, "m"))
    return F.array_distinct(F.concat(*parts))


def with_features(c: str, text: str) -> str:
    """SQL: candidate c of the column text as a struct with FEATURES besides its span."""
    m, before = f"{c}.m", f"substring({text}, greatest({c}.s - 39, 1), least({c}.s, 40))"
    num = lambda pattern: f"cast(regexp_count({m}, {_sql(pattern)}) as double)"
    d = _digits(m)
    cue = "case " + " ".join(f"when {c}.kind = '{k}' then {before} rlike {_sql(p)}" for k, p in CUES.items()) + " end"
    # letters stand for two digits; the first four characters go to the end
    turned = f"regexp_replace({m}, ' ', '')"
    turned = f"concat(substring({turned}, 5), substring({turned}, 1, 4))"
    mod = (
        f"aggregate(split({turned}, ''), 0, (a, x) -> if(x = '', a, if(x between '0' and '9',"
        f" (a * 10 + int(x)) % 97, (a * 100 + ascii(x) - 55) % 97)))"
    )
    feats = {
        "kind_no": "cast(case " + " ".join(f"when {c}.kind = '{k}' then {i}" for i, k in enumerate(KINDS)) + " end as double)",
        "len": f"cast(length({m}) as double)",
        "digits": num("[0-9]"),
        "letters": num("[A-Za-z]"),
        "uppers": num("[A-Z]"),
        "others": num("[^A-Za-z0-9]"),
        "distinct_chars": f"cast(size(array_distinct(split(lower({m}), ''))) as double)",
        "luhn": f"if(length({d}) between 13 and 19 and luhn_check({d}), 1D, 0D)",
        "mod97": f"if({c}.kind = 'iban', if({mod} = 1, 1D, 0D), 0D)",
        "cue": f"if({cue}, 1D, 0D)",
        "assigned": f"if({before} rlike {_sql(ASSIGNED)}, 1D, 0D)",
        "ref_before": f"if({before} rlike {_sql(REFERENCE)}, 1D, 0D)",
        "hex": f"if({m} rlike '^[0-9a-fA-F]+$', 1D, 0D)",
        "groups": f"cast(size(split({m}, '[^A-Za-z0-9]+')) as double)",
        "at_word": f"if({m} rlike '(?i)\\\\bat\\\\b|@', 1D, 0D) + if({m} rlike '(?i)\\\\bdot\\\\b', 1D, 0D)",
        "brackets": num("[\\[\\](){}<>]"),
        "blanks": num(" "),
        "double_colon": num("::"),
        "zero_group": f"if({m} rlike '(?:^|[^0-9])0+(?:[^0-9]|$)', 1D, 0D)",
    }
    return f"named_struct('kind', {c}.kind, 's', {c}.s, 'e', {c}.e, " + ", ".join(
        f"'{k}', {feats[k]}" for k in FEATURES
    ) + ")"


def _examples(seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(text, kind, the candidate, label), made by rule."""
    r = random.Random(seed)
    dig = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "re", "ti", "la", "ou", "ie", "sch", "ció", "el")) for _ in range(r.randint(1, 4)))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))

    def luhn(n: int) -> str:
        body = [int(x) for x in r.choice("3456") + dig(n - 2)]
        s = sum(x if i % 2 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(reversed(body)))
        return "".join(map(str, body)) + str(-s % 10)

    def iban() -> str:
        cc, bban = r.choice(("DE", "FR", "ES", "GB")), dig(18)
        n = int(bban + str(ord(cc[0]) - 55) + str(ord(cc[1]) - 55) + "00") % 97
        return f"{cc}{98 - n:02d}{bban}"

    def not_luhn(n: int) -> str:
        body = luhn(n)
        return body[:-1] + str((int(body[-1]) + r.randint(1, 9)) % 10)

    def not_iban() -> str:
        good_one = iban()
        return good_one[:-1] + str((int(good_one[-1]) + r.randint(1, 9)) % 10)

    def four(s: str, sep: str) -> str:
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    mixed = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    rand = lambda n: "".join(r.choice(mixed) for _ in range(n))
    cue = {
        "email": ("mail: ", "contact ", "write to ", "e-mail "),
        "phone": ("phone: ", "call ", "tel. ", "fax ", "Telefon "),
        "ip": ("ip ", "host ", "server "),
        "card": ("card ", "visa ", "payment card: "),
        "iban": ("IBAN ", "account ", "Konto: "),
        "mac": ("mac ", "device "),
        "secret": ('token = "', 'api_key="', "password: ", "secret=", "API_KEY=", "Bearer "),
        "ssn": ("ssn ", "social security number "),
    }
    good = {
        "email": (lambda: f"{name()} (at) {name()} (dot) {r.choice(('com', 'org', 'net'))}", lambda: f"{name()}[at]{name()}.{r.choice(('com', 'de'))}", lambda: f"{name()} (at) {name()}.{r.choice(('com', 'net'))}", lambda: f"{name()} [at] {name()} [dot] org", lambda: f"{name()}(at){name()}(dot){r.choice(('com', 'net'))}", lambda: f"{name()}.{name()} {{at}} {name()} {{dot}} de"),
        "phone": (lambda: f"({dig(3)}) {dig(3)}-{dig(4)}", lambda: f"0{dig(2)} {dig(3)} {dig(4)}", lambda: f"0{dig(3)}/{dig(3)}-{dig(3)}", lambda: f"00 49 {dig(3)} {dig(4)} {dig(2)}", lambda: f"{dig(3)}-{dig(3)}-{dig(4)}", lambda: f"0{dig(r.randint(2, 4))} {dig(r.randint(6, 8))}", lambda: f"0{dig(3)}/{dig(7)}", lambda: f"00 {r.randint(20, 99)} {dig(3)} {dig(6)}", lambda: " ".join(["0" + dig(1), *(dig(2) for _ in range(4))])),
        "ip": (lambda: ":".join(hexa(4) for _ in range(8)), lambda: f"2001:db8::{hexa(4)}", lambda: f"fe80::{hexa(3)}:{hexa(4)}", lambda: f"{hexa(4)}::{hexa(r.randint(1, 4))}:{hexa(r.randint(1, 4))}"),
        "card": (lambda: four(luhn(16), "."), lambda: four(luhn(16), "  "), lambda: four(luhn(16), "/")),
        "iban": (iban, lambda: four(iban(), " ")),
        "mac": (lambda: ":".join(hexa(2) for _ in range(6)), lambda: "-".join(hexa(2).upper() for _ in range(6))),
        "secret": (lambda: hexa(40), lambda: hexa(32), lambda: rand(r.randint(24, 64)), lambda: "sk_live_" + rand(24), lambda: "AKIA" + rand(16).upper()),
        "ssn": (lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",),
    }
    bad = {
        "email": (lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} at {word()} dot {word()} dot {word()}"),
        "phone": (lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{dig(2)}.{dig(2)}.{r.randint(1900, 2030)}", lambda: f"{dig(3)} {dig(3)}", lambda: f"{dig(3)}.{dig(3)}.{dig(3)}", lambda: f"{dig(2)}-{dig(2)}", lambda: dig(r.randint(9, 13)), lambda: f"{dig(3)} {dig(3)} {dig(3)}", lambda: f"{dig(4)} {dig(4)} {dig(4)}", lambda: four(dig(r.randint(16, 20)), " "), lambda: four(not_luhn(16), "-"), lambda: f"{dig(2)} {dig(3)} {dig(3)}", lambda: f"{r.randint(1500, 1999)}-{r.randint(1500, 2030)}", lambda: " ".join(dig(2) for _ in range(8))),
        "ip": (lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: f"{dig(1)}:{dig(2)}:{dig(2)}", lambda: "::", lambda: "a::b"),
        "card": (lambda: four(not_luhn(16), "."), lambda: four(not_luhn(16), "  "), lambda: four(not_luhn(16), "/")),
        "iban": (not_iban, lambda: four(not_iban(), " "), lambda: r.choice(("AB", "XK", "MO")) + dig(2) + rand(r.randint(12, 20)).upper()),
        "mac": (lambda: "-".join(dig(2) for _ in range(6)),),
        "secret": (lambda: "".join(word() for _ in range(12)), lambda: "-".join(word() for _ in range(7)), lambda: "/".join(word() for _ in range(7)), lambda: "_" * r.randint(20, 60), lambda: "-" * r.randint(20, 60), lambda: "A" * 24, lambda: "".join(word() for _ in range(12)).upper(), lambda: dig(24), lambda: word() + "/" + word() + "-" + dig(4) + "/" + word() + "/" + word() + word()),
        "ssn": (lambda: f"000-{r.randint(10, 99)}-{r.randint(1000, 9999)}", lambda: f"{r.randint(100, 665)}-00-{r.randint(1000, 9999)}"),
    }
    out = []
    for kind in KINDS:
        for i in range(180):
            lead = " ".join(word() for _ in range(4)) + " "
            m = good[kind][i % len(good[kind])]()
            plain = kind in ("mac", "iban", "ssn", "ip", "secret", "email", "card") or m.startswith("(")
            with_cue = not plain or i % 3 > 0
            if kind == "secret" and not with_cue and i % 5 in (0, 1):
                with_cue = True
            out.append((lead + (r.choice(cue[kind]) if with_cue else "") + m + " " + word(), kind, m, 1))
        for i in range(240):
            lead = " ".join(word() for _ in range(4)) + " "
            m = bad[kind][i % len(bad[kind])]()
            ref = r.choice(("no. ", "ref ", "order ", "id ", "")) if i % 2 else ""
            out.append((lead + ref + m + " " + word(), kind, m, 0))
    # formats that are personal only where something says so
    for i in range(60):
        out.append((f"{word()} {word()} ref {dig(3)}-{dig(3)}-{dig(4)} {word()}", "phone", "", 0))
        out.append((f"{word()} commit {hexa(40)} {word()}", "secret", "", 0))
        out.append((f"{word()} sha {hexa(40)} {word()}", "secret", "", 0))
        out.append((f"{word()} {word()} call {dig(3)}-{dig(3)}-{dig(4)}", "phone", "", 1))
    return out


@functools.lru_cache(maxsize=1)
def _fitted(app: str) -> tuple[str, dict[str, float]]:
    """(SQL of the log odds, threshold of each kind)."""
    spark = SparkSession.getActiveSession()
    rows = [{"i": i, "text": t, "want": k, "label": y} for i, (t, k, _, y) in enumerate(_examples())]
    df = spark.sql(
        "select inline(from_json(" + _sql(json.dumps(rows)) + ", 'array<struct<i: int, text: string, want: string, label: int>>'))"
    )
    df = df.select("i", "want", "label", "text", candidates("text").alias("cs"))
    df = df.select("i", "want", "label", "text", F.explode("cs").alias("c")).where("c.kind = want")
    df = df.select("i", "label", F.expr(with_features("c", "text")).alias("f")).select("i", "label", "f.*")
    got = sorted(df.collect(), key=lambda r: (r["i"], r["s"], r["e"]))
    x = np.array([[r[k] for k in FEATURES] for r in got])
    y = np.array([r["label"] for r in got], float)
    i = np.array([r["i"] for r in got])
    fit = np.array([k * 2654435761 % 2**32 // 7919 % 3 != 0 for k in i.tolist()])
    model = Boosted(trees=60, depth=4, rate=0.3, least=3).fit(x[fit], y[fit])
    margin = model.margin(x[~fit])
    cut = {
        k: calibrated_threshold(margin[x[~fit][:, 0] == n], y[~fit][x[~fit][:, 0] == n], 0.99) for n, k in enumerate(KINDS)
    }
    return model.sql([f"c.{k}" for k in FEATURES]), cut


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base (the fixed formats) and spans (all), arrays of kind, s, e in order."""
    spark = docs.sparkSession
    score, cut = _fitted(spark.sparkContext.applicationId)
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    # the row is one struct, so that its columns may have any names
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("struct<none: int>")
    df = docs.select(row.alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    lists = {}
    for kind in BASE:
        lists[kind] = _named(_only_valid(spans_of("_text", BASE_PATTERNS[kind], BASE_GATES[kind]), kind), kind)
    df = df.select("_row", "_text", F.concat(*lists.values()).alias("base"), candidates("_text").alias("_cands"))
    df = df.withColumn("_cands", F.expr(f"transform(_cands, c -> {with_features('c', '_text')})"))
    bar = "case " + " ".join(f"when c.kind = '{k}' then {v!r}D" for k, v in cut.items() if np.isfinite(v)) + " else 1e9D end"
    scored = (
        f"filter(transform(_cands, c -> named_struct('kind', c.kind, 's', c.s, 'e', c.e, 'len', c.e - c.s,"
        f" 'over', ({score}) - ({bar}))), c -> c.over >= 0 and not exists(base, b -> b.s < c.e and c.s < b.e))"
    )
    df = df.withColumn("_cands", F.expr(scored))
    better = (
        "array_sort(_cands, (a, b) -> case when a.over > b.over then -1 when a.over < b.over then 1"
        " when a.len > b.len then -1 when a.len < b.len then 1 when a.s < b.s then -1 when a.s > b.s then 1 else 0 end)"
    )
    chosen = (
        f"aggregate({better}, cast(array() as array<struct<kind: string, s: int, e: int>>), (acc, c) ->"
        " if(exists(acc, b -> b.s < c.e and c.s < b.e), acc,"
        " array_append(acc, named_struct('kind', c.kind, 's', c.s, 'e', c.e))))"
    )
    place = "case " + " ".join("when {0}.kind = '" + k + f"' then {i}" for i, k in enumerate(KINDS)) + " end"
    order = (
        f"array_sort(concat(base, if(size(_cands) = 0, cast(array() as array<struct<kind: string, s: int, e: int>>), {chosen})),"
        f" (a, b) -> case when {place.format('a')} < {place.format('b')} then -1 when {place.format('a')} > {place.format('b')} then 1"
        " when a.s < b.s then -1 when a.s > b.s then 1 else 0 end)"
    )
    return df.select(*[F.col("_row").getField(c).alias(c) for c in keep], "base", F.expr(order).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten: every span, overlapping ones joined, becomes [KIND]."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = find_spans(docs.select(row.alias("_in"), F.col(text_col).cast("string").alias("_t")), "_t")
    by_start = "array_sort(spans, (a, b) -> case when a.s < b.s then -1 when a.s > b.s then 1 when a.e > b.e then -1 when a.e < b.e then 1 else 0 end)"
    body = (
        f"aggregate({by_start}, named_struct('pos', 0, 'out', ''), (a, x) -> if(x.s < a.pos,"
        " named_struct('pos', greatest(a.pos, x.e), 'out', a.out),"
        " named_struct('pos', x.e, 'out', concat(a.out, substring(_t, a.pos + 1, x.s - a.pos), '[', upper(x.kind), ']'))),"
        " a -> concat(a.out, substring(_t, a.pos + 1)))"
    )
    text = F.expr(f"if(size(spans) = 0, _t, {body})")
    return found.select(*[(text if c == text_col else F.col("_in").getField(c)).alias(c) for c in docs.columns])
