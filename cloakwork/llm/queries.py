"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A file of the public tokenizers that the box offers; a parameter, never copied.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    net = langid.train(docs, ~langid.held_out())
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(rows, net).select("doc_id", "held_out", "lang_pred", "score")


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii_boost

    found = pii_boost.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii_boost.BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii_boost.listed("base").cast("binary"), 256).alias("base_sha256"),
        pii_boost.listed("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


#: A conversation whose texts hold control strings, besides those of the table.
EXTRA_CONVERSATION = (
    "select -1L as conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' as text"
    " from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"
)


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_windows import format_windows, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_windows(rows.unionByName(spark.sql(EXTRA_CONVERSATION))))


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_spread import remove_spread_lines

    docs = table(spark, sf_dir, "documents")
    return remove_spread_lines(docs.select("doc_id", "text", "source")).select("doc_id", "text", "removed_lines")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cutting_stock import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_merge import capture_histories

    rows = capture_histories(table(spark, sf_dir, "pages"))
    return rows.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "range", "place"
    )


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dom_boost import extract_main

    return extract_main(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_pii_boosting,
        op3_ngram_jaccard_join,
        op4_chat_windows,
        op5_line_spread,
        op6_decontamination,
        op7_cutting_stock_packing,
        op8_nn_descent,
        op9_warc_index_merge,
        op10_html_extraction,
    )
}

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_GRAMS = (
    "list_distinct(list_transform(range(1, len(w) - 3), lambda i: "
    "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]))"
)

ORACLES: dict[str, str] = {
    "op5_line_spread": """
        with base as (
            select doc_id, text, coalesce(source, '') as site from documents where text is not null
        ), firsts as (
            select text, min({'d': doc_id, 's': site}) as f from base group by text
        ), lines as (
            select distinct f.d as doc, f.s as site, unnest(string_split(text, chr(10))) as line from firsts
        ), spread as (
            select line, min(doc) as first_id from lines
            where length(regexp_replace(trim(line, ' '), ' +', ' ', 'g'))
                  - length(replace(regexp_replace(trim(line, ' '), ' +', ' ', 'g'), ' ', '')) >= 2
            group by line having count(distinct site) >= 16
        ), placed as (
            select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos,
                   unnest(string_split(text, chr(10))) as line from base
        ), judged as (
            select a.doc_id, a.pos, a.line,
                   s.line is not null and not (a.doc_id = s.first_id
                       and row_number() over (partition by a.doc_id, a.line order by a.pos) = 1) as lost
            from placed a left join spread s on a.line = s.line
        ), done as (
            select doc_id, string_agg(line, chr(10) order by pos) filter (not lost) as kept,
                   count(*) filter (lost) as removed_lines
            from judged group by doc_id
        )
        select d.doc_id, case when d.text is null then null when removed_lines = 0 then d.text else coalesce(kept, '') end as text,
               coalesce(removed_lines, 0) as removed_lines
        from documents d left join done using (doc_id)""",
    "op6_decontamination": f"""
        with dw as (select doc_id, {_WORDS} as w from documents where doc_id is not null and text is not null),
        iw as (select item_id, {_WORDS} as w from benchmark where item_id is not null and text is not null),
        dg as (select doc_id, unnest({_GRAMS}) as g from dw where len(w) >= 5),
        ig as (select item_id, {_GRAMS} as gs from iw where len(w) >= 5),
        ie as (select item_id, len(gs) as n, unnest(gs) as g from ig)
        select doc_id, item_id, n as n_item, count(*) as n_shared, count(*) / n as containment
        from dg join ie using (g) group by doc_id, item_id, n having count(*) >= ceil(n * 0.8 - 1e-9)""",
}
