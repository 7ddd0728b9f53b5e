"""Structured detectors on sentences beyond those of plans/golden.py: every expected span, and none else of its type."""

import duckdb
from pyspark.sql import functions as F

from cloakwork.operators import detect as d
from cloakwork.plans import queries

CASES = [
    ("EMAIL", "x.y-z%1@a.b.c.example.com", ["x.y-z%1@a.b.c.example.com"]),
    ("EMAIL", "Two: a@b.org,c@d.net.", ["a@b.org", "c@d.net"]),
    ("EMAIL", "Bare @example.com and me@ are none", []),
    ("IBAN", "GB82WEST12345698765432 and NL91ABNA0417164300", ["GB82WEST12345698765432", "NL91ABNA0417164300"]),
    ("IBAN", "GB82 WEST 1234 5698 7654 32 EUR 90 left", ["GB82 WEST 1234 5698 7654 32"]),
    ("CREDIT_CARD", "6011 1111 1111 1117 and 3530111333300000", ["6011 1111 1111 1117", "3530111333300000"]),
    ("CREDIT_CARD", "ref FR76 5555 5555 5555 4444 is a bank line", []),
    ("CREDIT_CARD", "an amex no. ending with: 0005", ["0005"]),
    ("IP", "see 10.20.30.40.", ["10.20.30.40"]),
    ("IP", "release 1.2.3.4.5 came", []),
    ("IP", "any 0.0.0.0 and all 255.255.255.255", []),
    ("IP", "fe80::abcd%wlan0 is up", ["fe80::abcd%wlan0"]),
    ("MAC", "BSSID 11.22.33.44.55.66 seen", ["11.22.33.44.55.66"]),
    ("MAC", "list 11.22.33.44.55.66 seen", []),
    ("PHONE", "list 11.22.33.44.55.66 seen", ["11.22.33.44.55.66"]),
    ("PHONE", "Fax 0221-555-0199 or 0221/5550198", ["0221-555-0199", "0221/5550198"]),
    ("PHONE", "card 3056 930902 5904 was read", []),
    ("PHONE", "host 10.0.0.999 is a typo", []),
    ("NATIONAL_ID", "000-12-3456, 123-00-4567 and 123-45-0000", []),
    ("NATIONAL_ID", "IdNr 47 036 892 816 liegt vor", ["47 036 892 816"]),
    ("PASSPORT", "Passport ID: GB-99887766 ok", ["GB-99887766"]),
    ("PASSPORT", "Passport no. Z123456789012345 is too long", []),
    ("DATE_OF_BIRTH", "Birth certificate: 4/5/1966", ["4/5/1966"]),
    ("DATE_OF_BIRTH", "birthday is April 2nd, 2001", ["April 2nd, 2001"]),
    ("DATE_OF_BIRTH", "re-birth: 2011-01-01 was a show", []),
]


def test_goldens(spark):
    texts = sorted({t for _, t, _ in CASES})
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    kinds = sorted({k for k, _, _ in CASES})
    rows = d.detect(df, types=kinds).select("text", F.explode("spans").alias("x")).select("text", "x.*").collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        got.setdefault((r["type"], r[0]), []).append(r["value"] if "value" in r else r[4])
        assert r[0][r["start"] : r["end"]] == r[4]
    wrong = [(k, t, w, got.get((k, t), [])) for k, t, w in CASES if got.get((k, t), []) != w]
    assert not wrong


def test_mixed_types(spark):
    """Overlaps between types, and texts in which nothing is personal."""
    cases = [
        ("Pay with 4242 4242 4242 4242 please.", [("CREDIT_CARD", "4242 4242 4242 4242")]),
        ("Server 10.9.8.7 pinged 3c:22:fb:12:34:ab.", [("IP", "10.9.8.7"), ("MAC", "3c:22:fb:12:34:ab")]),
        ("The minutes by John Anderson are final.", [("PERSON", "John Anderson")]),
        ("May is a month, and a rose is a rose.", []),
        ("In Paris it rained all day.", []),
        (None, []),
        ("", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, text string")
    got = {r["i"]: [(s["type"], s["text"]) for s in r["spans"]] for r in d.detect(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}


def test_options(spark):
    df = spark.createDataFrame([("Tell Mill Works of it by m@w.org.",)], "text string")
    extra = F.expr("array(named_struct('start', 5, 'end', 15, 'type', 'PERSON', 'text', 'Mill Works', 'confidence', 0.6D, 'source', 'llm'))")
    df = df.withColumn("extra", extra)
    only = lambda **o: d.redact(d.detect(df, extra_spans="extra", **o)).first()["sanitized"]
    assert only() == "Tell [PERSON] of it by [EMAIL]."
    assert only(min_confidence=0.8) == "Tell Mill Works of it by [EMAIL]."
    assert only(types=["EMAIL"]) == "Tell Mill Works of it by [EMAIL]."


def test_long_inputs(spark):
    hostile = [" " * 100_000, "a." * 30_000 + "@b.c", "1 " * 30_000, ":a" * 30_000, "geb " * 20_000, "1.1." * 10_000]
    df = spark.createDataFrame([(t,) for t in hostile], "text string")
    assert d.detect(df).select(F.size("spans")).count() == len(hostile)
    d.detect(df).agg(F.sum(F.size("spans"))).collect()


def test_us_phones_beside_numbers(spark, tmp_path):
    """A whole US number is found whatever stands beside it, as the SQL of detect_us_phones has it."""
    us = "+1 (826) 555-4081"
    cases = [
        (f"Des {us} 190.137.223.204 du", [us, "190.137.223.204"]),
        (f"whor to {us} 4524132264652876 and", [us]),
        (f"{us} 12 left", [us]),
        (f"{us} 0221-555-0199 and {us}.{us}/{us}", [us, "0221-555-0199", us, us, us]),
        (f"{us}(212) 555-0199", [us, "(212) 555-0199"]),
        (f"12 345 678 {us}", ["12 345 678", us]),
        (f"# {us}, tel-{us} or {us}-home, {us}-1", [us, us, us, us]),
        (f"a{us}, _{us}, +{us}, 1{us}", ["(826) 555-4081"] * 4),
        (f"\U0001f4de é {us} 4524132264652876\n{us}", [us, us]),
        ("+1 (826) 555-40812 and +1 (826) 555-4081x", ["+1 (826) 555-40812"]),
        ("Bay #5550123-7 and AB-5550-123456-X", []),
        ("", []),
        (None, []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: [s["text"] for s in r["spans"]] for r in d.detect(df, types=["PHONE"]).collect()}
    assert got == {i: w for i, (_, w) in enumerate(cases)}
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["detect_us_phones"]).fetchall()
    rows = queries.detect_us_phones(spark, str(tmp_path)).select("doc_id", "start", "end", "value").collect()
    assert sorted(map(tuple, rows)) == sorted(want) and len(want) == 15


def test_us_phones_as_stored(spark, tmp_path):
    """Texts that are not in normal form C have the offsets that the SQL gives."""
    us = "+1 (826) 555-4081"
    texts = [f"e\u0301le\u0300ve {us} 12", f"A\u030a {us}, e\u0301 {us}", f"\u212a{us}", f"{us}e\u0301", f"e\u0301{us}", f"\u1100\u1161 {us}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.detect_us_phones(spark, str(tmp_path)).select("doc_id", "start", "end", "value").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["detect_us_phones"]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want) and len(want) == 6
    assert all(texts[i][s:e] == v for i, s, e, v in rows)
    # by default offsets stay those of the normal form
    first = d.detect(df, types=["PHONE"]).where("doc_id = 0").first()
    assert [(s["start"], s["text"]) for s in first["spans"]] == [(6, us)] and first["text"][6:23] == us
