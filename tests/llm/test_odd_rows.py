"""Columns of any name pass through every operator; nulls, repeats, empty tables and long texts give defined results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakwork.llm import chat_windows, cutting_stock, decontam, dom_boost, langid, line_spread, ngram_join, nn_descent, pii_boost, warc_merge
from cloakwork.llm.queries import tokenizer_path

#: Names that the operators use inside, all at once.
NAMES = (
    "doc site line pos line_hash text_hash body_hash body lost lost_doc lost_hash at leaked _leaked first_id fdoc fsite rows id h r row _row "
    "_in _t _text _cands w drow hs k m n v c a b d1 d2 sig sigs probe gram own rep best toks frag lo hi lead _drop_id _drop_hash "
    "cls salt rank slot base_x archive captured first sha sha0 u sim fresh members blk task win conv cum tok sys head target"
).split()


def odd(df):
    return df.select("*", *[F.lit(f"x-{n}").alias(n) for n in NAMES if n not in df.columns])


@pytest.fixture
def docs(spark, words):
    common = "a line that many sites carry along"
    rows = [(i, f"{words.text(60)}\n{common}", ("en", "de")[i % 2], f"s{i % 20}", 1) for i in range(60)]
    rows += [(60, rows[3][1] + "!", "en", "s1", 1), (61, None, "en", "s1", 0), (62, "", None, None, 0), (63, "½ ² ①", "de", "s2", 5)]
    rows += [rows[0], (None, "a row without an id " + common, "en", "s3", 1), (64, "word " * 30_000, "de", "s4", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def same(got, want, extra):
    """got has the rows of want, and the odd columns with their values."""
    assert [c for c in want.columns if c not in got.columns] == []
    for n in NAMES:
        if n in extra:
            assert got.where(F.col(f"`{n}`") != f"x-{n}").count() == 0, n
    cols = [F.col(f"`{c}`").cast("string") for c in want.columns]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_line_spread(docs):
    same(line_spread.remove_spread_lines(odd(docs)), line_spread.remove_spread_lines(docs), NAMES)


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "a line that many sites carry along"), (2, None)], "item_id long, text string")
    got = decontam.decontaminate(odd(docs), odd(items))
    same(got, decontam.decontaminate(docs, items), NAMES)
    assert got.where("doc_id is null").count() == 1
    # rows that share an id are judged by their texts
    two = spark.createDataFrame([(7, "a line that many sites carry along"), (7, "nothing of the kind is here at all")], "doc_id long, text string")
    assert [r["text"] for r in decontam.decontaminate(two, items).collect()] == ["nothing of the kind is here at all"]


def test_keep_one(docs):
    same(ngram_join.keep_one(odd(docs)), ngram_join.keep_one(docs), NAMES)


def test_keep_one_judges_texts(spark, words):
    """Rows that share an id are judged by their texts."""
    base, other = words.text(200), words.text(150)
    rows = [(1, base), (2, base + " end"), (2, other), (3, other + " more"), (4, "")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, base), (2, other), (4, "")]


def test_language(docs):
    got = langid.reject_unknown(odd(docs))
    same(got, langid.reject_unknown(docs), NAMES)
    held = {r["doc_id"] for r in got.collect()}
    assert not held & {61, 62, 63} and {0, 64} <= held


def test_pii(docs):
    rows = docs.where("doc_id < 5").withColumn("text", F.concat("text", F.lit(" mail a.b@example.org now")))
    rows = rows.withColumn("base", F.lit(1)).withColumn("spans", F.lit("kept"))
    got = pii_boost.redact(odd(rows))
    same(got, pii_boost.redact(rows), NAMES)
    assert got.where("spans <> 'kept' or base <> 1 or text not like '%[EMAIL] now'").count() == 0


def test_packing(docs):
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = cutting_stock.pack_documents(odd(docs), tokenizer_path(), with_ids=False)
    same(got.select(*cols), cutting_stock.pack_documents(docs, tokenizer_path(), with_ids=False).select(*cols), ())


def test_pages(spark):
    rows = [(1, "http://a.org/x", "<p>Some words of an article, which is long enough to stay.</p>"), (2, "http://a.org/x", None), (3, None, ""), (1, "http://a.org/x", "<p>Some words of an article, which is long enough to stay.</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    same(dom_boost.extract_main(odd(pages)), dom_boost.extract_main(pages), NAMES)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured"]
    want = warc_merge.capture_histories(pages).select(*cols)
    same(warc_merge.capture_histories(odd(pages)).select(*cols), want, ())
    assert want.where("page_id = 1 and record_type = 'response'").count() == 2
    # a time that can be read is taken, another is not
    timed = pages.withColumn("seen", F.when(F.col("page_id") == 1, "2024-05-06 07:08:09").otherwise("no\ttime"))
    got = warc_merge.capture_histories(timed, captured_col="seen").collect()
    assert {r["captured"] for r in got if r["page_id"] == 1} == {"2024-05-06T07:08:09Z"} and len(got) == 4


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [1.0, float("nan")], "a"), (6, [1.0, 0.0], None), (1, [1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    same(nn_descent.near_vectors(odd(df)), nn_descent.near_vectors(df), ())


def test_chat(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "hello there " * (i % 7)) for i in range(40)] + [(2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wins = chat_windows.format_windows(odd(df), 80, 20)
    same(chat_windows.read_back(wins), chat_windows.read_back(chat_windows.format_windows(df, 80, 20)), ())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages(spark, docs, name, stage):
    """Each stage with odd columns, and with an empty table."""
    sf = "/root/testdata/sf0.001"
    same(stage(spark, odd(docs), sf), stage(spark, docs, sf), NAMES)
    assert stage(spark, odd(docs).limit(0), sf).count() == 0
    assert stage(spark, odd(docs), sf).columns == odd(docs).columns
