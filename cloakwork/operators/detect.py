"""The public operators: detect() and sanitize() over a text column.

Structured detectors and the resolution of overlaps are Catalyst expressions.  IBANs and
names need loops over tokens, so they run in one Arrow UDF, which gets the text and the
e-mail spans that were found before it.  Nothing here shuffles: a document is a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import DEFAULT, Lexicons
from ..functions.spans import PII_TYPES, SPANS, empty_spans
from ..functions.text import normalize, script_of, tokenize, words
from .iban import find_ibans
from .identity import Mapping, link_name_parts, resolve_identities, sanitize_text
from .namedb import to_lookup
from .names import Dictionary, Span, find_names, find_url_names, find_variants, names_beside_address, names_in_address
from .structured import DETECTORS, detector_sql

MAPPING = "array<struct<placeholder: string, original: string, type: string, identity_id: int>>"
IDENTITIES = "array<struct<id: int, label: string, placeholders: array<string>>>"
#: Bytes of text that a worker holds as Python objects at a time.
SLICE_BYTES = 2_000_000
#: Without a match no IBAN can be there.
IBAN_GATE = r"[A-Z]{2} ?[0-9]{2}(?: ?[A-Z0-9]){10}"
#: Without a capital letter, or a letter of a caseless script, no name can start.
NAME_GATE = r"[\p{Lu}\p{Lt}\p{Lo}]|https?://|www\.|@"


def spread(df: DataFrame) -> DataFrame:
    """A scan of few partitions dealt out to twice as many as there are cores; a larger one as it is.

    Detection costs far more than moving a small table, and a file of one row group is one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def find_people(text: str, emails: list[Span], names: Dictionary, least: float, lex: Lexicons = DEFAULT) -> list[Span]:
    """All PERSON spans of a text: two passes over the tokens, variants, and addresses."""
    out = find_names(text, names, least, lex)
    derived = {n for e in emails for n, _ in names_in_address(e.text.partition("@")[0], names, lex)}
    derived |= {n for e in emails for n in names_beside_address(text, e.start, e.text, lex)}
    if derived:
        out += find_names(text, names.with_core(derived), least, lex)
    return out + find_variants(text, out, lex) + find_url_names(text, names, lex)


def as_rows(spans: Iterable[Span]) -> list[dict]:
    return [s.__dict__ for s in spans]


SPAN_ARROW = pa.list_(
    pa.struct(
        [("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("confidence", pa.float64()), ("source", pa.string())]
    )
)
MAPPING_ARROW = pa.list_(
    pa.struct([("placeholder", pa.string()), ("original", pa.string()), ("type", pa.string()), ("identity_id", pa.int32())])
)
IDENTITY_ARROW = pa.list_(pa.struct([("id", pa.int32()), ("label", pa.string()), ("placeholders", pa.list_(pa.string()))]))


def add_columns(df: DataFrame, inputs: list[str], made: dict[str, tuple[str, pa.DataType]], work) -> DataFrame:
    """df with the columns of made; work turns the values of inputs in a row into a tuple of them.

    Other columns pass through as Arrow data without becoming Python objects.
    """
    keep = df.columns
    at = [keep.index(c) for c in inputs]
    kinds = [k for _, k in made.values()]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {k}" for n, (k, _) in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _bounded(whole, at[0]):
                rows = [work(*vals) for vals in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
                extra = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*keep, *made])

    return df.mapInArrow(run, schema)


def _bounded(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of about SLICE_BYTES of its column text; a longer text is a slice of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def resolve_sql(spans: str) -> str:
    """SQL of the spans that overlap no better one, by start.

    Better is: more confident, longer, earlier, found earlier in the array.
    """
    ranked = (
        "array_sort(transform(v, (x, i) -> named_struct('x', x, 'i', i)), (a, b) -> case when a.x.confidence > b.x.confidence then -1"
        " when a.x.confidence < b.x.confidence then 1 when a.x.end - a.x.start > b.x.end - b.x.start then -1"
        " when a.x.end - a.x.start < b.x.end - b.x.start then 1 when a.x.start < b.x.start then -1"
        " when a.x.start > b.x.start then 1 else a.i - b.i end)"
    )
    kept = (
        f"aggregate({ranked}, cast(array() as {SPANS}), (a, y) -> if(exists(a, z -> z.start < y.x.end and y.x.start < z.end),"
        " a, array_append(a, y.x)))"
    )
    # the array is named once, so that what makes it is not run again
    return f"transform(array({spans}), v -> if(size(v) < 2, v, array_sort({kept}, (a, b) -> a.start - b.start)))[0]"


def resolve(spans: str) -> Column:
    """resolve_sql() of a column."""
    return F.expr(resolve_sql(spans))


def _wanted(types: Iterable[str] | None) -> frozenset[str]:
    want = frozenset(PII_TYPES if types is None else types)
    if bad := want - set(PII_TYPES):
        raise ValueError(f"unknown types {sorted(bad)}")
    return want


def _structured(
    df: DataFrame, text_col: str, want: frozenset[str], drop: Iterable[str] = (), as_is: bool = False
) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with its text in normal form, or as it is, and a column of spans for each detector; type -> columns."""
    keep = [c for c in df.columns if c not in drop]
    cols = [normalize(F.col(c)).alias(c) if c == text_col and not as_is else F.col(c) for c in keep]
    run = [n for n, (kind, _) in DETECTORS.items() if kind in want]
    built = {f"_{n.lower()}": F.expr(detector_sql(n, f"`{text_col}`")) for n in run}
    if "PERSON" in want:
        built["_seeds"] = built.get("_email", F.expr(detector_sql("EMAIL", f"`{text_col}`")))
    by_kind: dict[str, list[str]] = {}
    for n in run:
        by_kind.setdefault(DETECTORS[n][0], []).append(f"_{n.lower()}")
    out = df.select(*cols).select("*", *[F.coalesce(c, empty_spans()).alias(k) for k, c in built.items()])
    return out, by_kind


def _live(text_col: str, deep: frozenset[str]) -> Column:
    """The text if an IBAN or a name can be in it; rows without go to Python as nulls."""
    gates = ([IBAN_GATE] if "IBAN" in deep else []) + ([NAME_GATE] if "PERSON" in deep else [])
    return F.when(F.col(text_col).rlike("|".join(gates)), F.col(text_col)) if gates else F.lit(None).cast("string")


def _extra(column: str | None, want: frozenset[str]) -> Column:
    if column is None:
        return empty_spans()
    allowed = F.array(*[F.lit(t) for t in sorted(want)])
    return F.filter(F.coalesce(F.col(column).cast(SPANS), empty_spans()), lambda x: F.array_contains(allowed, x["type"]))


def detect(
    df: DataFrame,
    text_col: str = "text",
    types: Iterable[str] | None = None,
    min_confidence: float = 0.5,
    names: DataFrame | None = None,
    extra_spans: str | None = None,
    lexicons: Lexicons = DEFAULT,
    out_col: str = "spans",
    as_is: bool = False,
) -> DataFrame:
    """df with its text in normal form C and out_col, the spans found in it.

    types restricts what is looked for; detectors of other types do not run.  names is
    a dictionary (script, tier, name).  extra_spans names an array column of spans
    from elsewhere.  A null text has no spans.  as_is leaves the text as it stands, and
    offsets are those in it.
    """
    want = _wanted(types)
    deep = want & {"IBAN", "PERSON"}
    out, by_kind = _structured(df, text_col, want, [out_col], as_is)
    keep = [c for c in df.columns if c != out_col]
    if deep:
        lookup = df.sparkSession.sparkContext.broadcast(to_lookup(names) if "PERSON" in want else None)

        def work(text, seeds):
            if text is None:
                return ([],)
            found = find_ibans(text) if "IBAN" in deep else []
            found += find_people(text, spans_of(seeds), lookup.value, min_confidence, lexicons) if "PERSON" in deep else []
            return (as_rows(found),)

        out = out.withColumn("_live", _live(text_col, deep))
        out = out if "PERSON" in want else out.withColumn("_seeds", empty_spans())
        out = add_columns(out, ["_live", "_seeds"], {"_deep": (SPANS, SPAN_ARROW)}, work)
    order = []
    for kind in PII_TYPES:
        if kind == "IBAN" and kind in deep:
            order.append(F.filter("_deep", lambda x: x["type"] == "IBAN"))
        elif kind == "PERSON" and kind in deep:
            order.append(F.filter("_deep", lambda x: x["type"] == "PERSON"))
        order += [F.col(c) for c in by_kind.get(kind, [])]
    all_ = F.filter(F.concat(*order, _extra(extra_spans, want)), lambda x: x["confidence"] >= min_confidence)
    return out.select(*keep, all_.alias("_all")).select(*keep, resolve("_all").alias(out_col))


def resolve_spans(spans: list[Span]) -> list[Span]:
    """The same choice as resolve(), for one document in Python."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s.confidence, s.start - s.end, s.start)):
        if all(s.end <= k.start or k.end <= s.start for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def redact_sql(text: str, spans: str) -> str:
    """SQL of the text with [TYPE] in place of every span."""
    return (
        f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', x.end, 'out',"
        f" concat(a.out, substring({text}, a.at + 1, x.start - a.at), '[', x.type, ']')),"
        f" a -> concat(a.out, substring({text}, a.at + 1)))"
    )


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """df with sanitized: its text with [TYPE] in place of every span; JVM only."""
    t = f"`{text_col}`"
    return df.withColumn("sanitized", F.expr(f"if(size({spans_col}) = 0, {t}, {redact_sql(t, spans_col)})"))


def mapping_rows(df: DataFrame, id_col: str, spans_col: str = "spans") -> DataFrame:
    """(id, type, original, placeholder): distinct values in order of first appearance."""
    rows = df.select(id_col, F.explode(spans_col).alias("x")).select(
        id_col, "x.type", "x.text", "x.start", F.lower("x.text").alias("key")
    )
    first = rows.groupBy(id_col, "type", "key").agg(F.min(F.struct("start", "text")).alias("f"))
    n = F.expr(f"dense_rank() over (partition by `{id_col}`, type order by f.start)")
    return first.select(
        id_col, "type", F.col("f.text").alias("original"), F.concat(F.lit("["), "type", F.lit("_"), n, F.lit("]")).alias("placeholder")
    )


def _pseudonymize(text: str, spans: list[Span], lex: Lexicons) -> dict:
    out, rows = sanitize_text(text, spans, "pseudonymize", link_name_parts(spans, lex))
    rows, found = resolve_identities(spans, rows, text, lex)
    return {"sanitized": out, "mapping": [m.__dict__ for m in rows], "identities": [i.__dict__ for i in found]}


def spans_of(rows) -> list[Span]:
    return [Span(int(r["start"]), int(r["end"]), r["type"], r["text"], r["confidence"], r["source"]) for r in rows]


def sanitize(df: DataFrame, text_col: str = "text", mode: str = "redact", lexicons: Lexicons = DEFAULT, **options) -> DataFrame:
    """detect(), then sanitized, mapping and identities.

    Redaction puts [TYPE] for each span.  Pseudonyms number the values of a document by
    type, fold partial names onto full ones and group what belongs to one person.
    Redaction has no identities.
    """
    if mode not in ("redact", "pseudonymize"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "redact":
        out = detect(df, text_col, lexicons=lexicons, **options)
        pairs = (
            "aggregate(spans, cast(array() as array<struct<key: string, original: string, type: string>>), (a, x) ->"
            " if(exists(a, y -> y.type = x.type and y.key = lower(x.text)), a, array_append(a, named_struct('key',"
            " lower(x.text), 'original', x.text, 'type', x.type))))"
        )
        rows = F.expr(
            f"cast(transform({pairs}, y -> named_struct('placeholder', concat('[', y.type, ']'), 'original', y.original,"
            f" 'type', y.type, 'identity_id', cast(null as int))) as {MAPPING})"
        )
        return redact(out, text_col).withColumn("mapping", rows).withColumn("identities", F.lit(None).cast(IDENTITIES))
    return _sanitize_pseudonymized(df, text_col, lexicons, **options)


def _sanitize_pseudonymized(
    df: DataFrame,
    text_col: str,
    lex: Lexicons,
    types: Iterable[str] | None = None,
    min_confidence: float = 0.5,
    names: DataFrame | None = None,
    extra_spans: str | None = None,
) -> DataFrame:
    """Names, resolution and rewriting in one Arrow UDF, which gets the structured spans."""
    want = _wanted(types)
    deep = want & {"IBAN", "PERSON"}
    made = ["spans", "sanitized", "mapping", "identities"]
    keep = [c for c in df.columns if c not in made]
    out, by_kind = _structured(df, text_col, want, made)
    found = F.concat(*[F.col(c) for k in PII_TYPES for c in by_kind.get(k, [])], empty_spans())
    seeds = F.col("_seeds") if "PERSON" in want else empty_spans()
    live = _live(text_col, deep)
    lookup = df.sparkSession.sparkContext.broadcast(to_lookup(names) if "PERSON" in want else None)
    place = {k: i for i, k in enumerate(PII_TYPES)}

    def work(text, live, some, mail, extra):
        if text is None:
            return [], None, [], []
        all_ = spans_of(some)
        if live is not None:
            all_ += find_ibans(text) if "IBAN" in deep else []
            all_ += find_people(text, spans_of(mail), lookup.value, min_confidence, lex) if "PERSON" in deep else []
        # equal spans keep the order of registration, those from elsewhere come last
        all_ = sorted(all_, key=lambda s: place[s.type]) + spans_of(extra)
        spans = resolve_spans([s for s in all_ if s.confidence >= min_confidence])
        done = _pseudonymize(text, spans, lex)
        return as_rows(spans), done["sanitized"], done["mapping"], done["identities"]

    inputs = {"_live": live, "_found": found, "_mails": seeds, "_extra": _extra(extra_spans, want)}
    out = out.select(*keep, *[c.alias(k) for k, c in inputs.items()])
    kinds = {
        "spans": (SPANS, SPAN_ARROW),
        "sanitized": ("string", pa.string()),
        "mapping": (MAPPING, MAPPING_ARROW),
        "identities": (IDENTITIES, IDENTITY_ARROW),
    }
    return add_columns(out, [text_col, *inputs], kinds, work).select(*keep, *made)


def segments(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """df with segments: the text cut at its spans, (text, type, source), type null between them."""
    t = f"`{text_col}`"
    kind = "array<struct<text: string, type: string, source: string>>"
    plain = "named_struct('text', {}, 'type', cast(null as string), 'source', cast(null as string))"
    gap = plain.format(f"substring({t}, a.at + 1, x.start - a.at)")
    cut = (
        f"aggregate({spans_col}, named_struct('at', 0, 'out', cast(array() as {kind})), (a, x) -> named_struct('at', x.end, 'out',"
        f" concat(a.out, if(x.start > a.at, array({gap}), cast(array() as {kind})),"
        " array(named_struct('text', x.text, 'type', x.type, 'source', x.source)))),"
        f" a -> if(length({t}) > a.at, array_append(a.out, {plain.format(f'substring({t}, a.at + 1)')}), a.out))"
    )
    return df.withColumn("segments", F.expr(cut))


def count_by_type(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """(type, n), most frequent first."""
    return df.select(F.explode(spans_col).alias("x")).groupBy("x.type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def word_table(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, text, script) of all words; JVM only."""
    rows = df.select(F.col(id_col), F.explode(words(text_col)).alias("_word"))
    return rows.select(id_col, F.col("_word").alias("text"), script_of("_word").alias("script"))


def token_table(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, text, start, end, script) of all words; word_table() does without offsets."""
    fields = ["_id", "text", "start", "end", "script"]
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _bounded(whole, 1):
                found = [tokenize(t) if t is not None else [] for t in b.column(1).to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                cols = list(zip(*(t for f in found for t in f), strict=True)) or [()] * 4
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *map(pa.array, cols, kinds)], names=fields)

    out = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return out.mapInArrow(run, f"_id {kind}, text string, start int, end int, script string").withColumnRenamed("_id", id_col)


def detect_text(text: str, names: Dictionary | None = None, least: float = 0.5) -> list[Span]:
    """IBAN and PERSON spans of one string, for tests and small jobs."""
    return find_ibans(text) + find_people(text, [], names or to_lookup(None), least)


__all__ = ["Mapping", "count_by_type", "detect", "detect_text", "mapping_rows", "redact", "resolve", "sanitize", "segments", "token_table"]
