"""Readers, packs, evaluation, streams and the registered queries."""

import io
import re
import unicodedata
import zipfile
from pathlib import Path

import duckdb
import pytest

from cloakwork import sql
from cloakwork.operators import detect as d
from cloakwork.operators import evaluate
from cloakwork.operators.namedb import build_dictionary, core_dictionary
from cloakwork.plans import golden, queries
from cloakwork.sources import packs, readers
from cloakwork.streaming import stream

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document>{body}</w:document>")
    return out.getvalue()


def test_docx():
    p = lambda *t: "<w:p>" + "".join(t) + "</w:p>"
    t = lambda x: f"<w:r><w:t>{x}</w:t></w:r>"
    assert readers.docx_text(docx(p(t("Hello world")) + p(t("Second line")))) == "Hello world\nSecond line"
    assert readers.docx_text(docx(p(t("a &amp; b &lt;c&gt; &#65;")))) == "a & b <c> A"
    assert readers.docx_text(docx(p(t("a"), "<w:tab/>", t("b"), "<w:br/>", t("c")))) == "a\tb\nc"
    with pytest.raises(ValueError):
        out = io.BytesIO()
        zipfile.ZipFile(out, "w").close()
        readers.docx_text(out.getvalue())


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x,y\n1,2", "utf-8")
    (tmp_path / "b.docx").write_bytes(docx("<w:p><w:t>Hi</w:t></w:p>"))
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "x,y\n1,2", "b.docx": "Hi"}


def test_packs(spark, tmp_path):
    f = packs.BloomFilter.for_items(1000, 0.01)
    for i in range(1000):
        f.add(f"name{i}")
    g = packs.BloomFilter.from_bytes(f.to_bytes())
    assert all(f"name{i}" in g for i in range(1000))
    assert sum(f"other{i}" in g for i in range(10_000)) < 300
    with pytest.raises(ValueError):
        packs.BloomFilter.from_bytes(b"nope" + bytes(20))
    # the layout: magic, version, hashes, bits; and the hash of one name worked out by hand
    assert f.to_bytes()[:8] == bytes.fromhex("42494950 0100 0700") and int.from_bytes(f.to_bytes()[8:12], "little") == f.m
    one = (0x811C9DC5 ^ 0x61) * 0x01000193 % 2**32
    two = (0x9E3779B1 ^ 0x61) * 0x01000193 % 2**32 | 1
    assert packs.BloomFilter(1000, 3)._places("a") == [(one + i * two) % 2**32 % 1000 for i in range(3)]
    where = str(tmp_path / "packs")
    rows = build_dictionary(core_dictionary(spark))
    written = packs.write_packs(rows, where, "2024-01-01")
    assert "latin-core.bin" in packs.manifest(written, "2024-01-01") and (tmp_path / "packs" / "latin-core.bin").exists()
    names = packs.read_packs(spark, where)
    assert all(names.exact(r["name"], r["script"]) for r in rows.collect())
    assert set(packs.read_packs(spark, where, ["Latin"]).names) == {"Latin"}
    df = spark.createDataFrame([("A letter by John Anderson came.",)], "text string")
    assert [s["text"] for s in d.detect(df, names=names).first()["spans"]] == ["John Anderson"]


def test_evaluation(spark):
    assert evaluate.match_lenient(["John Smith", "x"], ["Smith", "Anna"]) == (["John Smith"], ["x"], ["Anna"])
    assert evaluate.meets_baseline(1.0, 1.0) and not evaluate.meets_baseline(0.9, 1.0)
    empty = spark.createDataFrame([], "case long, type string, text string")
    assert evaluate.scores(evaluate.match_strict(empty, empty)).count() == 1


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("Mail jane@example.com",)], "text string").write.parquet(src)
    live = spark.readStream.schema("text string").parquet(src)
    q = stream.write_stream(stream.redact_stream(live, types=["EMAIL"]), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["sanitized"] == "Mail [EMAIL]"


def test_sql_functions(spark):
    """The SQL functions give what detect and redact give."""
    sql.register(spark)
    texts = [c[0] for part in (golden.PHONE, golden.IBAN, golden.PEOPLE, golden.CARD) for c in part] + [golden.LETTER, golden.NOTE, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    df.createOrReplaceTempView("texts")
    want = d.redact(d.detect(df)).orderBy("i").collect()
    got = spark.sql("select i, pii_detect(text) as spans, pii_redact(text) as sanitized from texts order by i").collect()
    assert [(r["spans"], r["sanitized"]) for r in got] == [(r["spans"], r["sanitized"]) for r in want]
    rows = spark.sql("select i, s.value from texts, lateral pii_spans(texts.text) s").collect()
    assert sorted(map(tuple, rows)) == sorted((r["i"], s["text"]) for r in want for s in r["spans"])


def test_oracles(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    wrong = []
    for name, text in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, DATA)
        cols = sorted(df.columns)
        rel = con.sql(text)
        assert sorted(rel.columns) == cols, (name, rel.columns, cols)
        at = [rel.columns.index(c) for c in cols]
        rows = lambda rs, f: sorted(repr(tuple(f(r))) for r in rs)
        want = rows(rel.fetchall(), lambda r: (r[i] for i in at))
        got = rows(df.select(*cols).collect(), lambda r: r)
        if want != got:
            wrong.append((name, len(want), len(got), list(set(want) ^ set(got))[:3]))
    assert not wrong


def test_other_queries(spark):
    """Queries without SQL: every span is a piece of its text, and none overlaps another."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    whole = {i: unicodedata.normalize("NFC", t) for i, t in texts.items() if t is not None}
    for name in ("detect_phone", "detect_credit_card", "detect_all"):
        rows = queries.QUERIES[name](spark, DATA).collect()
        assert rows and all(whole[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in rows), name
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["type"]))
    assert all(a[1] <= b[0] for v in by_doc.values() for a, b in zip(sorted(v), sorted(v)[1:]))
    done = {r["doc_id"]: r for r in queries.redact_documents(spark, DATA).collect()}
    assert done.keys() == texts.keys()
    for i, t in whole.items():
        out, at = "", 0
        for s, e, k in sorted(x for x in by_doc.get(i, ())):
            out, at = out + t[at:s] + f"[{k}]", e
        if done[i]["n_spans"] == len(by_doc.get(i, ())):
            assert done[i]["sanitized"] == out + t[at:]
    cut: dict = {}
    for r in sorted(queries.document_segments(spark, DATA).collect(), key=lambda r: (r["doc_id"], r["n"])):
        cut[r["doc_id"]] = cut.get(r["doc_id"], "") + r["text"]
    assert cut == {i: t for i, t in whole.items() if t}
    assert queries.QUERIES.keys() - queries.ORACLES.keys() == {
        "detect_phone", "detect_credit_card", "detect_all", "redact_documents", "pseudonymize_documents", "document_segments"
    }


def test_nothing_imports_llm():
    """The corpus operators can be taken away."""
    root = Path(queries.__file__).parents[1]
    files = [p for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm"]
    assert files and not [p for p in files if re.search(r"^\s*(?:from|import)\s.*\bllm\b", p.read_text(), re.M)]
