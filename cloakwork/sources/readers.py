"""Documents from files, one row each: (path, text)."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD_MAIN = "word/document.xml"
_RUN = re.compile(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>|<w:(tab|br|cr)(?:\s[^>]*)?/?>", re.S)
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def decode_xml(text: str) -> str:
    """The five named and the numeric character references; the ampersand comes last."""
    text = re.sub(r"&#x([0-9a-fA-F]+);", lambda m: chr(int(m[1], 16)), text)
    text = re.sub(r"&#([0-9]+);", lambda m: chr(int(m[1])), text)
    for ref, char in _NAMED:
        text = text.replace(ref, char)
    return text


def docx_text(content: bytes) -> str:
    """Paragraphs as lines, tabs and breaks kept, at most one empty line in a row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if _WORD_MAIN not in z.namelist():
            raise ValueError("not a DOCX document: word/document.xml is missing")
        xml = z.read(_WORD_MAIN).decode("utf-8")
    lines = []
    for paragraph in xml.split("</w:p>"):
        parts = [decode_xml(m[1]) if m[2] is None else "\t" if m[2] == "tab" else "\n" for m in _RUN.finditer(paragraph)]
        lines.append("".join(parts))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def pdf_text(content: bytes) -> str:
    """Page texts, an empty line between pages; needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages).strip()


# Media types that are read like their extensions.
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PDF_TYPE = "application/pdf"


def extract_text(path: str, content: bytes, media_type: str | None = None) -> str:
    """By extension or media type: DOCX, PDF, or anything else as UTF-8 text."""
    low = path.lower()
    if low.endswith(".docx") or media_type == DOCX_TYPE:
        return docx_text(content)
    if low.endswith(".pdf") or media_type == PDF_TYPE:
        return pdf_text(content)
    return content.decode("utf-8", "replace")


def extract_documents(files: DataFrame, media_type_col: str | None = None) -> DataFrame:
    """files (path, content, ...) with text in place of content."""

    @F.pandas_udf("string")
    def text_of(paths: pd.Series, contents: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([extract_text(p, bytes(c), k) for p, c, k in zip(paths, contents, kinds, strict=True)], dtype=object)

    kind = F.lit(None).cast("string") if media_type_col is None else F.col(media_type_col)
    return files.withColumn("text", text_of("path", "content", kind)).drop("content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all files under path; CSV and JSON are plain text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return extract_documents(files.select("path", "content"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case, text, entities) of JSON arrays of {text, entities: [{type, text}]}, numbered by file and place."""
    schema = "array<struct<text: string, entities: array<struct<type: string, text: string>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("cases"))
    rows = whole.select("file", F.posexplode("cases").alias("n", "x"))
    return rows.select(F.xxhash64("file", "n").alias("case"), "x.text", "x.entities")


def read_name_files(spark: SparkSession, path: str) -> DataFrame:
    """(script, name) of JSON dictionaries {source, license, script, names}."""
    schema = "source string, license string, script string, names array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("script", F.explode("names").alias("name"))


def read_census(spark: SparkSession, path: str) -> DataFrame:
    """(name, rank): the first column of a frequency list in CSV, plain or zipped, in the order of its lines."""

    @F.pandas_udf("array<string>")
    def firsts(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            c = bytes(c)
            if c[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    c = b"\n".join(z.read(n) for n in z.namelist() if n.lower().endswith(".csv"))
            out.append([line.split(",")[0].strip() for line in c.decode("utf-8", "replace").splitlines()[1:]])
        return pd.Series(out)

    files = spark.read.format("binaryFile").load(path).select(firsts("content").alias("names"))
    return files.select(F.posexplode("names").alias("rank", "name")).select("name", "rank")


def write_name_files(names: DataFrame, path: str, source: str, license: str) -> None:
    """path/SCRIPT.json for each script of (script, name): {source, license, script, names}, names sorted.

    A script's names are one array of one row; caps (namedb.cap_harvest) bound them.
    """
    rows = names.groupBy("script").agg(F.sort_array(F.collect_set("name")).alias("names"))
    rows = rows.select(F.lower("script").alias("file"), F.lit(source).alias("source"), F.lit(license).alias("license"), "script", "names")
    rows.write.mode("overwrite").partitionBy("file").json(path)
