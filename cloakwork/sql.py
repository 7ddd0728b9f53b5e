"""SQL functions: pii_detect(text), pii_redact(text) and the table function pii_spans(text).

They give what operators.detect gives with its defaults: every type, overlaps resolved.
Offsets are code points of the text in normal form C.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.spans import PII_TYPES, SPANS
from .operators.detect import as_rows, spans_of, find_people, redact_sql, resolve_sql
from .operators.iban import find_ibans
from .operators.namedb import to_lookup
from .operators.structured import DETECTORS, detector_sql


def register(spark: SparkSession, names: DataFrame | None = None, min_confidence: float = 0.5) -> None:
    """Register pii_nfc, pii_people, pii_detect, pii_redact and pii_spans."""
    lookup = spark.sparkContext.broadcast(to_lookup(names))

    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    @F.pandas_udf(SPANS)
    def people(texts: pd.Series, mails: pd.Series) -> pd.Series:
        def work(t, some):
            if t is None:
                return []
            return as_rows(find_ibans(t) + find_people(t, spans_of(some), lookup.value, min_confidence))

        return pd.Series([work(t, s) for t, s in zip(texts, mails, strict=True)])

    spark.udf.register("pii_nfc", nfc)
    spark.udf.register("pii_people", people)
    parts = []
    for kind in PII_TYPES:
        if kind in ("IBAN", "PERSON"):
            parts.append(f"filter(deep, x -> x.type = '{kind}')")
        parts += [detector_sql(n, "text") for n, (k, _) in DETECTORS.items() if k == kind]
    none = f"cast(array() as {SPANS})"
    found = f"filter(coalesce(concat({', '.join(parts)}), {none}), x -> x.confidence >= {min_confidence}D)"
    spark.sql(
        f"create or replace temporary function pii_found(text string, deep {SPANS}) returns {SPANS} return {resolve_sql(found)}"
    )
    mails = f"coalesce({detector_sql('EMAIL', 'text')}, {none})"
    spark.sql(f"create or replace temporary function pii_mails(text string) returns {SPANS} return {mails}")
    call = "pii_found(pii_nfc(text), pii_people(pii_nfc(text), pii_mails(pii_nfc(text))))"
    spark.sql(f"create or replace temporary function pii_detect(text string) returns {SPANS} return {call}")
    spark.sql(
        f"create or replace temporary function pii_rewritten(text string, spans {SPANS}) returns string"
        f" return {redact_sql('text', 'spans')}"
    )
    call = "pii_rewritten(pii_nfc(text), pii_detect(text))"
    spark.sql(f"create or replace temporary function pii_redact(text string) returns string return {call}")
    spark.sql(
        "create or replace temporary function pii_spans(text string) returns table (start int, end int, type string,"
        " value string, confidence double, source string) return select x.start, x.end, x.type, x.text, x.confidence, x.source"
        " from (select explode(found) as x from (select pii_detect(text) as found))"
    )
