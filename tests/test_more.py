"""DataFrame forms of overrides and findings, harvest cleaning, readers, evaluation writers."""

import io
import json
import zipfile

from pyspark.sql import functions as F

import cloakwork
from cloakwork.functions.lexicons import COUNTRIES, TITLES, Lexicons
from cloakwork.functions.text import SURNAME_SPELLINGS, hangul_spellings
from cloakwork.operators import detect as d
from cloakwork.operators import evaluate, external, mapping_view, namedb
from cloakwork.sources import readers


def test_exports():
    assert all(hasattr(cloakwork, n) for n in cloakwork.__all__)


def test_manual_spans(spark):
    df = spark.createDataFrame([("Ann saw Annika. ANN left.",), (None,), ("",)], "text string")
    got = external.add_manual_spans(df, [("PERSON", "ann")]).collect()
    assert [[(s["start"], s["text"]) for s in r["manual"]] for r in got] == [[(0, "Ann"), (16, "ANN")], [], []]
    own = df.withColumn("asked", F.expr("array(named_struct('type', 'PERSON', 'value', 'Annika'))"))
    made = external.add_manual_spans(own, "asked")
    assert [s["text"] for s in d.detect(made, extra_spans="manual").first()["spans"]] == ["Annika"]


def test_findings(spark):
    rows = [("mail ed@q.org now", '{"findings": [{"type": "email", "text": "ED@Q.ORG"}]}'), ("x", "none"), (None, None), ("y", None)]
    got = external.add_findings(spark.createDataFrame(rows, "text string, answer string"), "answer").collect()
    assert [[s["text"] for s in r["findings"]] for r in got] == [["ed@q.org"], [], [], []]


def test_mapping_views(spark):
    text = "Write to a@q.org, b@q.org."
    df = spark.createDataFrame([(1, text), (2, text), (3, None)], "i long, text string")
    ask = "if(i = 1, named_struct('disabled', array('EMAIL:a@q.org'), 'assignments', null, 'manual', array(named_struct('type', 'PERSON', 'value', 'Write')), 'custom', null), null)"
    df = d.detect(df).withColumn("asked", F.expr(ask).cast(mapping_view.OVERRIDES))
    got = {r["i"]: r for r in mapping_view.mapping_views(df, overrides_col="asked", mode="pseudonymize").collect()}
    assert got[1]["view_text"] == "[PERSON_1] to a@q.org, [EMAIL_1]."
    assert [r["key"] for r in got[1]["view_removed"]] == ["EMAIL:a@q.org"]
    assert got[2]["view_text"] == "Write to [EMAIL_1], [EMAIL_2]." and got[3]["view_text"] is None


def test_harvest(spark):
    assert len(SURNAME_SPELLINGS) == 85 and hangul_spellings("박") == ["bak", "park", "bak"]
    rows = [("José Núñez (footballer)",), ("김 하은",), ("O'Neil-Smith",), ("team 7",), ("王伟",), (None,), ("x",), ("Ελένη",)]
    df = spark.createDataFrame(rows, "label string")
    got = {tuple(r) for r in namedb.clean_labels(df).select("script", "name").collect()}
    assert got == {
        ("Latin", "josé"), ("Latin", "jose"), ("Latin", "núñez"), ("Latin", "nunez"), ("Hangul", "하은"), ("Latin", "haeun"),
        ("Latin", "o'neil-smith"), ("Greek", "ελένη"),
    }
    one = spark.createDataFrame([("하은",), ("김민준",), ("허한",)], "label string")
    assert ("Latin", "gimminjun") in {tuple(r) for r in namedb.clean_labels(one).select("script", "name").collect()}
    capped = namedb.cap_harvest(spark.createDataFrame([("Latin", n) for n in "bca"] + [("Runic", "z")], "script string, name string"), {"Latin": 2})
    assert sorted(map(tuple, capped.collect())) == [("Latin", "a"), ("Latin", "b")]


def test_census(spark, tmp_path):
    csv = "name,rank,count\nSMITH,1,9\nJONES,2,8\nSERVICE,3,7\nSMITH,4,1\nA1,5,1\nLee,6,1\n"
    (tmp_path / "names.csv").write_text(csv)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Names.csv", csv)
    (tmp_path / "names.zip").write_bytes(out.getvalue())
    for f in ("names.csv", "names.zip"):
        rows = namedb.rank_census(readers.read_census(spark, str(tmp_path / f)), top=2)
        assert [r["name"] for r in rows.collect()] == ["smith", "jones"], f


def test_readers(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"text": "t", "entities": [{"type": "IP", "text": "a"}]}, {"text": "t", "entities": []}]))
    rows = readers.read_cases(spark, str(tmp_path / "cases.json")).collect()
    assert len({r["case"] for r in rows}) == 2 and [len(r["entities"]) for r in rows] == [1, 0]
    files = spark.createDataFrame([("upload-1", b"plain", None), ("b", b"caf\xc3\xa9", "text/plain")], "path string, content binary, kind string")
    assert [r["text"] for r in readers.extract_documents(files, "kind").orderBy("path").collect()] == ["café", "plain"]
    names = spark.createDataFrame([("Latin", "b"), ("Latin", "a"), ("Greek", "ε")], "script string, name string")
    readers.write_name_files(names, str(tmp_path / "out"), "me", "CC0")
    back = readers.read_name_files(spark, str(tmp_path / "out"))
    assert sorted((r["script"], r["name"]) for r in back.collect()) == [("Greek", "ε"), ("Latin", "a"), ("Latin", "b")]


def test_evaluation(spark, tmp_path):
    want = spark.createDataFrame([(1, "IP", "a"), (1, "PERSON", "Ann Lee"), (1, "PERSON", "Bo"), (2, "IP", "b")], "case long, type string, text string")
    got = spark.createDataFrame([(1, "IP", "a"), (1, "PERSON", "ANN"), (1, "PERSON", "Cy"), (2, "IP", "c")], "case long, type string, text string")
    matched = evaluate.match_discovery(got, want)
    rows = sorted((r["type"], r["text"], r["outcome"]) for r in matched.collect())
    assert rows == [("IP", "a", "tp"), ("IP", "b", "fn"), ("IP", "c", "fp"), ("PERSON", "ANN", "tp"), ("PERSON", "Bo", "fn"), ("PERSON", "Cy", "fp")]
    cases = [(["John Smith", "x"], ["smith", "Anna"]), ([], ["a"]), (["a"], []), (["ab", "b"], ["b", "ab"])]
    df = spark.createDataFrame(cases, "predicted array<string>, expected array<string>")
    same = [(r["found"], r["spurious"], r["missed"]) for r in evaluate.match_lenient_cases(df).collect()]
    assert same == [evaluate.match_lenient(p, e) for p, e in cases]
    strict = evaluate.match_strict(want, want)
    assert evaluate.gate(strict, strict, 1.0) == []
    held = evaluate.gate(evaluate.match_strict(got, want), evaluate.match_strict(got, want), 1.0)
    assert any("proven fn: IP b" in x for x in held) and "below" in held[-1]
    text = evaluate.report(strict, strict, "today")
    assert "| ALL | 100.0 % | 100.0 % | 100.0 % | 4 | 0 | 0 |" in text and json.loads(evaluate.baseline_json(strict)) == {"overallF1": 1.0}
    evaluate.write_gap_report(matched, spark.createDataFrame([(1, "one"), (2, "two")], "case long, text string"), str(tmp_path / "gaps"))
    gaps = spark.read.json(str(tmp_path / "gaps" / "misses"))
    assert gaps.count() == 4 and gaps.where("case = 2 and context = 'two'").count() == 2


def test_word_lists():
    """The fixed lists are whole, and disjoint from what they must not hold."""
    assert "dr" in TITLES and "france" in COUNTRIES and not TITLES & COUNTRIES
    more = Lexicons().extended(cities=["Görlitz"], openers=["Hence"])
    assert {"görlitz", "goerlitz", "paris"} - more.cities == {"paris"} - Lexicons().cities and "hence" in more.openers
