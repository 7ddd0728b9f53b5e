"""Queries over sentences whose spans are known, for what the driver tables do not hold.

Each query runs its operator over a small table of sentences; its SQL is the table of
the expected rows, stated by hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import PII_TYPES
from ..operators import detect as d

Case = tuple[str, list[tuple[str, str]]]

PHONE = [
    ("Ring +49 30 5550 1234 after six.", ["+49 30 5550 1234"]),
    ("Our desk has (020) 7946-0321 until noon.", ["(020) 7946-0321"]),
    ("The fax answers at 0044 161 496 0777 now.", ["0044 161 496 0777"]),
    ("Please dial (4155550132) for the front desk.", ["4155550132"]),
    ("Batch (4155550132) was scrapped.", []),
    ("Order 20231105-0042 left the depot.", []),
    ("Bay #5550123-7 is empty.", []),
    ("The survey closed on 17.05.2024 at last.", []),
    ("Part AB-5550-123456-X is out of stock.", []),
]
CARD = [
    ("Charge 5555 5555 5555 4444 tonight.", ["5555 5555 5555 4444"]),
    ("Old plastic 378282246310005 expired.", ["378282246310005"]),
    ("Try 4242-4242-4242-4242 instead.", ["4242-4242-4242-4242"]),
    ("Parcel 5555 5555 5555 4445 is late.", []),
    ("A mastercard ending in 9081 was blocked.", ["9081"]),
    ("That postcard ending 2211 got lost.", []),
    ("Zeros 0000 0000 0000 0000 fill the field.", []),
]
IP = [
    ("Gateway 172.16.254.3 dropped packets.", ["172.16.254.3"]),
    ("Route 10.1.2.3/24 was added.", ["10.1.2.3/24"]),
    ("Route 10.1.2.3/77 was refused.", ["10.1.2.3"]),
    ("Loop 127.0.0.9 stays local.", []),
    ("Peer 2001:db8:85a3::8a2e:370:7334 answered.", ["2001:db8:85a3::8a2e:370:7334"]),
    ("Mapped ::ffff:198.51.100.7 appeared.", ["::ffff:198.51.100.7"]),
    ("It was 12:30:45 by then.", []),
    ("Octets 300.1.1.1 cannot be.", []),
]
MAC = [
    ("Card 3c:22:fb:12:34:ab joined.", ["3c:22:fb:12:34:ab"]),
    ("Switch 0050.56af.10fe rebooted.", ["0050.56af.10fe"]),
    ("The label says MAC a1b2c3d4e5f6 in print.", ["a1b2c3d4e5f6"]),
    ("Build a1b2c3d4e5f6 passed.", []),
    ("Packets to ff-ff-ff-ff-ff-ff reach all.", []),
    ("Mixed 3c:22-fb:12:34:ab is no address.", []),
]
IBAN = [
    ("Please pay NL91 ABNA 0417 1643 00 soon.", ["NL91 ABNA 0417 1643 00"]),
    ("Ours is FR1420041010050500013M02606 since May.", ["FR1420041010050500013M02606"]),
    ("Their IBAN is NL91 ABNA 0417 1643 01 they say.", ["NL91 ABNA 0417 1643 01"]),
    ("Note NL91 ABNA 0417 1643 01 (IBAN) down.", ["NL91 ABNA 0417 1643 01"]),
    ("Send NL91 ABNA 0417 1643 01 back.", []),
    ("Account no. DE11 1111 1111 1111 1111 11 is open.", ["DE11 1111 1111 1111 1111 11"]),
    ("An example account DE11 1111 1111 1111 1111 11 only.", []),
]
NATIONAL_ID = [
    ("Her SSN 536-22-8473 is stored.", ["536-22-8473"]),
    ("The ITIN 912-71-3456 was sent.", ["912-71-3456"]),
    ("Row 666-22-8473 is invalid.", []),
    ("Ticket #536-22-8473 was closed.", []),
    ("Die Nummer 47036892816 gilt.", ["47036892816"]),
    ("Die Nummer 47036892817 gilt nicht.", []),
]
PASSPORT = [
    ("Passport number K7654321 was renewed.", ["K7654321"]),
    ("Reisepass Nr. C01X0006H lag bei.", ["C01X0006H"]),
    ("The passport booklet no: L898902C3 is blue.", ["L898902C3"]),
    ("A passport renewed in spring.", []),
    ("Passport ABCDEFGH has no digit.", []),
]
BIRTH = [
    ("She was born on 3 March 1979 in Leeds.", ["3 March 1979"]),
    ("DOB: 02/11/1984.", ["02/11/1984"]),
    ("Er wurde geboren am 7. Mai 1990 in Ulm.", ["7. Mai 1990"]),
    ("Date of birth of the youngest clerk: 1971-12-24.", ["1971-12-24"]),
    ("The invoice of 02/11/1984 was paid.", []),
]
EMAIL = [
    ("Write to ana.b+news@mail.example.org today.", ["ana.b+news@mail.example.org"]),
    ("Schreib an zoë.weiß@straße-post.de bitte.", ["zoë.weiß@straße-post.de"]),
    ("The handle someone@intranet is local.", []),
]
PEOPLE = [
    ("Yesterday John Anderson signed the lease.", ["John Anderson"]),
    ("Please greet Dr. Quorvex Blintz warmly.", ["Quorvex Blintz"]),
    ("The tenant Wibke Oltmanns moved out.", ["Wibke Oltmanns"]),
    ("The old bridge was closed again.", []),
    ("Photos at https://pics.example.net/u/john.smith are public.", ["john.smith"]),
]


def values(rows: Iterable[tuple], columns: str) -> str:
    """SQL of a table of literals."""

    def lit(x) -> str:
        if x is None:
            return "null"
        return str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"select * from (values {body}) as t({columns})"


def located(kind: str, cases: list[tuple[str, list[str]]]) -> str:
    """SQL of the expected spans of cases."""
    rows = [(i, t.index(v), t.index(v) + len(v), kind, v) for i, (t, vs) in enumerate(cases) for v in vs]
    return values(rows, 'doc_id, start, "end", type, value')


def table(spark: SparkSession, texts: Iterable[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def spans(df: DataFrame, **options) -> DataFrame:
    out = d.detect(df, **options).select("doc_id", F.explode("spans").alias("x"))
    return out.select(
        "doc_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), "x.type", F.col("x.text").alias("value")
    )


def by_type(kind: str, cases: list[tuple[str, list[str]]]) -> tuple[Callable, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spans(table(spark, (t for t, _ in cases)), types=[kind])

    return run, located(kind, cases)


#: Spans that overlap: (start, end, type, text, confidence), and those that stay.
RIVALS = [
    ([(0, 4, "EMAIL", "a", 0.9), (2, 9, "PHONE", "b", 0.8), (8, 12, "IP", "c", 0.7)], ["a", "c"]),
    ([(0, 4, "EMAIL", "short", 0.9), (0, 9, "PHONE", "long", 0.9)], ["long"]),
    ([(5, 9, "IP", "late", 0.5), (3, 7, "MAC", "early", 0.5)], ["early"]),
    ([(0, 3, "PERSON", "first", 0.6), (0, 3, "IBAN", "second", 0.6)], ["first"]),
    ([(0, 3, "PERSON", "x", 0.6), (3, 5, "IBAN", "y", 0.6)], ["x", "y"]),
    ([], []),
]


def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps go to the more confident, longer, earlier, first listed span."""
    rows = [(i, [(s, e, k, t, c, "x") for s, e, k, t, c in given]) for i, (given, _) in enumerate(RIVALS)]
    kind = "array<struct<start: int, end: int, type: string, text: string, confidence: double, source: string>>"
    df = spark.createDataFrame(rows, f"doc_id long, spans {kind}")
    kept = df.select("doc_id", d.resolve("spans").alias("kept"))
    return kept.select("doc_id", F.concat_ws(" ", F.transform("kept", lambda x: x["text"])).alias("kept"))


def _extra(df: DataFrame) -> DataFrame:
    found = "named_struct('start', 6, 'end', 14, 'type', 'PERSON', 'text', 'Old Mill', 'confidence', 0.6D, 'source', 'hand')"
    return df.withColumn("extra", F.expr(f"array({found})"))


NOTE = "Visit Old Mill or write to mill@example.org or ring +49 30 5550 1234."


def extra_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from elsewhere join those found."""
    return spans(_extra(table(spark, [NOTE])), extra_spans="extra")


def confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what is at least 0.7 sure."""
    return spans(_extra(table(spark, [NOTE])), extra_spans="extra", min_confidence=0.7)


def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only phones and people."""
    return spans(_extra(table(spark, [NOTE])), extra_spans="extra", types=["PHONE", "PERSON"])


LETTER = "John Anderson moved to Ulm. Anderson can be reached at janderson@example.org or +49 30 5550 1234."


def coref_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a name get the placeholder of the whole."""
    out = d.sanitize(table(spark, [LETTER, "John Anderson knows Michael Smith."]), mode="pseudonymize")
    return out.select("doc_id", "sanitized")


def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's name, address and phone are one identity."""
    out = d.sanitize(table(spark, [LETTER]), mode="pseudonymize").select("doc_id", F.explode("identities").alias("i"))
    return out.select("doc_id", "i.label", F.array_join("i.placeholders", " ").alias("placeholders"))


def mapping_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct value once, numbered by type in order of appearance."""
    text = "From b@example.org to a@example.org via 172.16.254.3; B@example.org replied."
    out = d.sanitize(table(spark, [text]), mode="pseudonymize").select("doc_id", F.posexplode("mapping").alias("n", "m"))
    return out.select("doc_id", F.col("n").cast("long").alias("n"), "m.placeholder", "m.original", "m.type")


def redact_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[TYPE] in place of every span, of every type."""
    return d.sanitize(table(spark, [NOTE, LETTER, ""]), mode="redact").select("doc_id", "sanitized")


def segment_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text cut at its spans."""
    df = d.segments(d.detect(table(spark, ["Mail a@example.org now", "nothing here"])))
    return df.select("doc_id", F.posexplode("segments").alias("n", "x")).select("doc_id", F.col("n").cast("long").alias("n"), "x.text", "x.type")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "email_forms": by_type("EMAIL", EMAIL),
    "phone_forms": by_type("PHONE", PHONE),
    "card_forms": by_type("CREDIT_CARD", CARD),
    "ip_forms": by_type("IP", IP),
    "mac_forms": by_type("MAC", MAC),
    "iban_paths": by_type("IBAN", IBAN),
    "national_id_forms": by_type("NATIONAL_ID", NATIONAL_ID),
    "passport_forms": by_type("PASSPORT", PASSPORT),
    "birth_cues": by_type("DATE_OF_BIRTH", BIRTH),
    "people_forms": by_type("PERSON", PEOPLE),
    "resolve_overlaps": (resolve_overlaps, values([(i, " ".join(k)) for i, (_, k) in enumerate(RIVALS)], "doc_id, kept")),
    "extra_spans": (
        extra_spans,
        values(
            [(0, 6, 14, "PERSON", "Old Mill"), (0, 27, 43, "EMAIL", "mill@example.org"), (0, 52, 68, "PHONE", "+49 30 5550 1234")],
            'doc_id, start, "end", type, value',
        ),
    ),
    "confidence_filter": (confidence_filter, values([(0, 27, 43, "EMAIL", "mill@example.org")], 'doc_id, start, "end", type, value')),
    "type_filter": (
        type_filter,
        values([(0, 6, 14, "PERSON", "Old Mill"), (0, 52, 68, "PHONE", "+49 30 5550 1234")], 'doc_id, start, "end", type, value'),
    ),
    "coref_links": (
        coref_links,
        values(
            [
                (0, "[PERSON_1] moved to Ulm. [PERSON_1] can be reached at [EMAIL_1] or [PHONE_1]."),
                (1, "[PERSON_1] knows [PERSON_2]."),
            ],
            "doc_id, sanitized",
        ),
    ),
    "identity_groups": (
        identity_groups,
        values([(0, "John Anderson", "[PERSON_1] [EMAIL_1] [PHONE_1]")], "doc_id, label, placeholders"),
    ),
    "mapping_order": (
        mapping_order,
        values(
            [
                (0, 0, "[EMAIL_1]", "b@example.org", "EMAIL"),
                (0, 1, "[EMAIL_2]", "a@example.org", "EMAIL"),
                (0, 2, "[IP_1]", "172.16.254.3", "IP"),
            ],
            "doc_id, n, placeholder, original, type",
        ),
    ),
    "redact_sentences": (
        redact_sentences,
        values(
            [
                (0, "Visit Old Mill or write to [EMAIL] or ring [PHONE]."),
                (1, "[PERSON] moved to Ulm. [PERSON] can be reached at [EMAIL] or [PHONE]."),
                (2, ""),
            ],
            "doc_id, sanitized",
        ),
    ),
    "segment_sentences": (
        segment_sentences,
        values(
            [(0, 0, "Mail ", None), (0, 1, "a@example.org", "EMAIL"), (0, 2, " now", None), (1, 0, "nothing here", None)],
            "doc_id, n, text, type",
        ),
    ),
}
