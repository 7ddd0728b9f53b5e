"""From raw documents to packed sequences: five stages, each a written table.

Every stage works on all rows that its predecessor kept.  All but the last return the
columns of documents, extra columns of any name among them; the last returns the pieces of
packed sequences.  An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import cutting_stock, decontam, langid, line_spread, ngram_join, queries
from cloakwork.llm.common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no known language, go.

    Null and empty texts go; rows with a null lang or id are judged by their text; repeated
    rows stay or go together; texts of any length are read whole; without labels to learn
    from all rows stay.
    """
    return langid.reject_unknown(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites leave all texts but the first; n_chars follows the text.

    A null text stays null; a null source is the site ''; of documents tied as first, that is
    with one id, each keeps a line once; repeated rows are treated alike; n_chars of a text
    that lost nothing stays as it is, null or wrong as it may be.
    """
    done = line_spread.remove_spread_lines(docs)
    n = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.withColumn("n_chars", n).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id.

    Rows without words, and rows with a null id, stay; of texts with one id each is judged by
    itself, ties going to the lesser hash of the text; rows equal in id and text are one
    document and stay or go together.
    """
    return ngram_join.keep_one(docs, words=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts, and rows with a null id, stay; items that are null or without words
    are in no document; of rows with one id each is judged by its text; repeated rows stay or
    go together.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and their places in sequences.

    A null or empty text is the end id alone; repeated rows are packed each; ties in rank go
    by id, then start; texts of any length are cut into pieces.
    """
    return cutting_stock.pack_documents(docs, queries.tokenizer_path(), with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The tokenizer and the network cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
