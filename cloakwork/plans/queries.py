"""Registered queries over the driver tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validators as v
from ..functions.spans import PII_TYPES
from ..operators import detect as d
from ..operators import evaluate, namedb
from ..streaming.stream import counts_by_window
from . import golden

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str = "documents", *cols: str) -> DataFrame:
    """The columns of a table of texts, dealt out for detection."""
    return d.spread(_table(spark, sf_dir, name).select(*(cols or ("doc_id", "text"))))


def _spans(df: DataFrame, id_col: str, kinds: list[str], text_col: str = "text", as_is: bool = False) -> DataFrame:
    out = d.detect(df.select(id_col, text_col), text_col, types=kinds, min_confidence=0.0, as_is=as_is)
    return out.select(id_col, F.explode("spans").alias("x")).select(
        id_col, F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), "x.type", F.col("x.text").alias("value")
    )


def _located(table: str, key: str, pattern: str, text: str = "text") -> str:
    """DuckDB: (key, text, s, m) of the matches of an RE2 pattern, s counted from 0."""
    return f"""
        raw as (select {key}, {text} as text, regexp_extract_all({text}, '{pattern}') as ms,
                       regexp_split_to_array({text}, '{pattern}') as gs from {table} where {text} is not null),
        nth as (select {key}, text, ms, gs, unnest(range(1, len(ms) + 1)) as i from raw),
        found as (select {key}, text, ms[i] as m,
                         cast(coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
                         + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as bigint) as s from nth)"""


_LUHN = (
    "list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when i % 2 = 1 then cast(substr(reverse({d}), i, 1) as bigint)"
    " when cast(substr(reverse({d}), i, 1) as bigint) > 4 then cast(substr(reverse({d}), i, 1) as bigint) * 2 - 9"
    " else cast(substr(reverse({d}), i, 1) as bigint) * 2 end)) % 10 = 0"
)
_EMAIL_RE = r"[\p{L}0-9._%+-]+@(?:[\p{L}0-9](?:[\p{L}0-9-]*[\p{L}0-9])?\.)+[A-Za-z]{2,}"
_IP_RE = r"[0-9]+(?:\.[0-9]+)*"
_OCTET_RE = "^(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_IP_FILTER = (
    f"len(string_split(m, '.')) = 4 and len(list_filter(string_split(m, '.'), lambda p: regexp_matches(p, '{_OCTET_RE}'))) = 4"
    " and substr(text, s, 1) <> '.' and m not in ('0.0.0.0', '255.255.255.255') and m not like '127.%'"
)
_CARD_RE = "[A-Za-z0-9_-]*(?: [0-9][A-Za-z0-9_-]*)*"


@query(
    f"""with {_located("documents", "doc_id", _EMAIL_RE)}
        select doc_id, s as start, s + length(m) as "end", 'EMAIL' as type, m as value from found"""
)
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_texts(spark, sf_dir), "doc_id", ["EMAIL"])


@query(
    f"""with {_located("documents", "doc_id", _IP_RE)}
        select doc_id, s as start, s + length(m) as "end", 'IP' as type, m as value from found where {_IP_FILTER}"""
)
def detect_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_texts(spark, sf_dir), "doc_id", ["IP"]).where("not value like '%:%'")


@query(
    f"""with {_located("documents", "doc_id", "[A-Za-z0-9_-]+")}
        select doc_id, s as start, s + length(m) as "end", m as value from found
        where regexp_matches(m, '^[1-9][0-9]{{14,15}}$') and {_LUHN.format(d="m")}"""
)
def detect_plain_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card numbers without blanks or hyphens inside."""
    rows = _spans(_texts(spark, sf_dir), "doc_id", ["CREDIT_CARD"])
    return rows.where("value rlike '^[0-9]+$'").drop("type")


@query(
    f"""with {_located("documents", "doc_id", "[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}")}
        select doc_id, s as start, s + length(m) as "end", m as value from found
        where not regexp_matches(substr(text, s, 1), '[A-Za-z0-9_+]') and not regexp_matches(substr(text, s + length(m) + 1, 1), '[A-Za-z0-9_]')"""
)
def detect_us_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """US numbers in print; offsets are those of the stored text, whatever its normal form."""
    rows = _spans(_texts(spark, sf_dir), "doc_id", ["PHONE"], as_is=True)
    return rows.where(r"value rlike '^[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}$'").drop("type")


@query()
def detect_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_texts(spark, sf_dir), "doc_id", ["PHONE"])


@query()
def detect_credit_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_texts(spark, sf_dir), "doc_id", ["CREDIT_CARD"])


@query(
    f"""with {_located("pages", "page_id", _EMAIL_RE, "html")}
        select page_id, s as start, s + length(m) as "end", 'EMAIL' as type, m as value from found"""
)
def detect_page_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_texts(spark, sf_dir, "pages", "page_id", "html"), "page_id", ["EMAIL"], "html")


@query()
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type, overlaps resolved."""
    return _spans(_texts(spark, sf_dir), "doc_id", list(PII_TYPES))


@query(
    f"""select doc_id, regexp_replace(text, '{_EMAIL_RE}', '[EMAIL]', 'g') as sanitized from documents where text is not null"""
)
def redact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _texts(spark, sf_dir).where("text is not null")
    return d.redact(d.detect(df, types=["EMAIL"])).select("doc_id", "sanitized")


@query()
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d.sanitize(_texts(spark, sf_dir), mode="redact")
    return out.select("doc_id", "sanitized", F.size("spans").alias("n_spans"))


@query()
def pseudonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = d.sanitize(_texts(spark, sf_dir), mode="pseudonymize")
    return out.select("doc_id", "sanitized", F.size("spans").alias("n_spans"))


@query(
    f"""with {_located("documents", "doc_id", _EMAIL_RE)},
        firsts as (select doc_id, lower(m) as k, min({{'s': s, 'm': m}}) as f from found group by all)
        select doc_id, 'EMAIL' as type, f.m as original,
               '[EMAIL_' || dense_rank() over (partition by doc_id order by f.s) || ']' as placeholder from firsts"""
)
def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _texts(spark, sf_dir)
    return d.mapping_rows(d.detect(df, types=["EMAIL"]), "doc_id")


@query(
    f"""with {_located("documents", "doc_id", _EMAIL_RE)}, ips as (
            with {_located("documents", "doc_id", _IP_RE)} select * from found where {_IP_FILTER})
        select lang, source, type, count(*) as n from (
            select doc_id, 'EMAIL' as type from found union all select doc_id, 'IP' from ips) join documents using (doc_id)
        group by all"""
)
def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail and IPv4 spans by language, source and type."""
    docs = _texts(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    out = d.detect(docs, types=["EMAIL", "IP"]).select("lang", "source", F.explode("spans").alias("x"))
    return out.where("not x.text like '%:%'").groupBy("lang", "source", "x.type").agg(F.count("*").alias("n"))


@query()
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = d.detect(_texts(spark, sf_dir).where("text is not null"))
    return d.segments(df).select("doc_id", F.posexplode("segments").alias("n", "x")).select("doc_id", "n", "x.*")


@query(
    """select o_orderkey, lpad(cast(o_orderkey * 7919 as varchar), 15, '4') as digits,
              """
    + _LUHN.format(d="lpad(cast(o_orderkey * 7919 as varchar), 15, '4')")
    + " as valid from orders"
)
def luhn_validator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr("lpad(cast(o_orderkey * 7919 as string), 15, '4')").alias("digits"))
    return rows.withColumn("valid", F.expr(v.luhn("digits")))


@query(
    """select o_orderkey, 'DE' || lpad(cast(o_orderkey % 100 as varchar), 2, '0') || lpad(cast(o_orderkey * 104729 as varchar), 18, '3') as code,
              cast(substr(lpad(cast(o_orderkey * 104729 as varchar), 18, '3'), 1, 18) || '1314' || lpad(cast(o_orderkey % 100 as varchar), 2, '0')
                   as hugeint) % 97 as rest from orders"""
)
def iban_mod97(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "concat('DE', lpad(string(o_orderkey % 100), 2, '0'), lpad(string(o_orderkey * 104729), 18, '3'))"
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(code).alias("code"))
    return rows.withColumn("rest", F.expr(v.mod97("code")).cast("long"))


@query(
    """with n as (select o_orderkey, lpad(cast(o_orderkey * 1237 % 1000000000 as varchar), 9, '9') as x from orders),
       p as (select o_orderkey, substr(x, 1, 3) as a, substr(x, 4, 2) as g, substr(x, 6, 4) as s from n)
       select o_orderkey, a || '-' || g || '-' || s as value,
              a not in ('000', '666') and a not like '9%' and g <> '00' and s <> '0000' as ssn,
              a like '9%' and s <> '0000' and (cast(g as int) between 50 and 65 or cast(g as int) between 70 and 88
                  or cast(g as int) between 90 and 92 or cast(g as int) between 94 and 99) as itin from p"""
)
def ssn_itin_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = "lpad(string(o_orderkey * 1237 % 1000000000), 9, '9')"
    value = f"concat_ws('-', substring({x}, 1, 3), substring({x}, 4, 2), substring({x}, 6, 4))"
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(value).alias("value"))
    return rows.select("*", F.expr(v.ssn("value")).alias("ssn"), F.expr(v.itin("value")).alias("itin"))


@query(
    """with n as (select l_orderkey, l_linenumber, lpad(cast((l_orderkey * 7 + l_linenumber) * 15485863 % 100000000000 as varchar), 11, '1') as digits from lineitem),
       c as (select *, list_transform(range(1, 11), lambda i: cast(substr(digits, i, 1) as int)) as ds from n),
       k as (select *, list_transform(range(0, 10), lambda x: len(list_filter(ds, lambda y: y = x))) as counts from c),
       f as (select *, list_reduce(list_prepend(10, ds), lambda a, y: case when (a + y) % 10 = 0 then 9 else (a + y) % 10 * 2 % 11 end) as product from k)
       select l_orderkey, l_linenumber, digits,
              digits not like '0%' and len(list_filter(counts, lambda x: x > 1)) = 1 and list_max(counts) <= 3
              and (11 - product) % 10 = cast(substr(digits, 11, 1) as int) as valid from f"""
)
def taxid_iso7064(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = "lpad(string((l_orderkey * 7 + l_linenumber) * 15485863 % 100000000000), 11, '1')"
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(x).alias("digits"))
    return rows.withColumn("valid", F.expr(v.tax_id("digits")))


@query(
    """select o_orderkey, cc, n, case cc when 'DE' then 22 when 'FR' then 27 when 'NO' then 15 when 'MT' then 31 end = n as fits
       from (select o_orderkey, list_extract(['DE', 'FR', 'NO', 'MT', 'ZZ'], cast(o_orderkey % 5 as int) + 1) as cc, o_orderkey % 20 + 14 as n from orders)"""
)
def iban_country_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    cc = "element_at(array('DE', 'FR', 'NO', 'MT', 'ZZ'), int(o_orderkey % 5) + 1)"
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(cc).alias("cc"), F.expr("o_orderkey % 20 + 14").alias("n"))
    return rows.withColumn("fits", F.expr(f"{v.iban_length('cc')} = n"))


@query(
    """with n as (select o_orderkey, lpad(cast(o_orderkey * 99991 as varchar), 16, cast(3 + o_orderkey % 4 as varchar)) as d from orders)
       select o_orderkey, d as digits, d like '4%' or cast(d[1:2] as int) between 51 and 55 or cast(d[1:4] as int) between 2221 and 2720
              or d like '6011%' or d like '65%' or cast(d[1:3] as int) between 644 and 649 or cast(d[1:4] as int) between 3528 and 3589 as network from n"""
)
def card_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = "lpad(string(o_orderkey * 99991), 16, string(3 + o_orderkey % 4))"
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(x).alias("digits"))
    return rows.withColumn("network", F.expr(v.card_network("digits")))


_TOKENS = r"""words as (select doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}]+(?:[-''’][\p{L}\p{M}]+)*')) as raw from documents),
       tokens as (select doc_id, case when regexp_matches(raw, '[''’][sS]$') and length(raw) >= 4 then left(raw, length(raw) - 2) else raw end as word from words)"""


@query(f"with {_TOKENS} select doc_id, count(*) as n_tokens, count(distinct word) as n_distinct from tokens group by doc_id")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = d.word_table(_texts(spark, sf_dir), "doc_id")
    return words.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("text").alias("n_distinct"))


@query(
    rf"""with {_TOKENS} select case when regexp_matches(word, '^\p{{M}}*\p{{Latin}}') then 'Latin' else 'other' end as script, count(*) as n
        from tokens group by 1"""
)
def script_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = d.word_table(_texts(spark, sf_dir), "doc_id")
    return words.groupBy(F.when(F.col("script") == "Latin", "Latin").otherwise("other").alias("script")).agg(F.count("*").alias("n"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary made of customers' and parts' text: (script, tier, name)."""
    nation = _table(spark, sf_dir, "nation").select(F.lit("Latin").alias("script"), F.lit("core").alias("tier"), F.col("n_name").alias("name"))
    region = _table(spark, sf_dir, "region").select(F.lit("Latin").alias("script"), F.lit("ext").alias("tier"), F.col("r_name").alias("name"))
    words = d.word_table(_table(spark, sf_dir, "benchmark"), "item_id").select("script", F.lit("ext").alias("tier"), F.col("text").alias("name"))
    return nation.unionByName(region).unionByName(words)


_NAMES = r"""names as (select 'core' as tier, lower(n_name) as name from nation union all select 'ext', lower(r_name) from region
       union all select 'ext', lower(unnest(regexp_extract_all(text, '[\p{L}\p{M}]+(?:[-''’][\p{L}\p{M}]+)*'))) from benchmark),
       dict as (select 'Latin' as script, name, min(tier) as tier from names group by name)"""


@query(f"with {_NAMES} select script, tier, name from dict")
def dict_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namedb.build_dictionary(_names(spark, sf_dir))


@query(
    f"""with {_NAMES} select 'Latin' as script, 'ext' as tier, name from (select distinct name from names where tier = 'ext') e
        where not exists (select 1 from names c where c.tier = 'core' and c.name = e.name)
        union all select distinct 'Latin', 'core', name from names where tier = 'core'"""
)
def dict_minus_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _names(spark, sf_dir)
    return namedb.merge_inputs(rows.where("tier = 'core'"), rows.where("tier = 'ext'"))


@query(
    f"""with {_NAMES} select script, name, rank from (select *, row_number() over (partition by script order by rank, name) as n
        from (select script, name, length(name) as rank from dict)) where n <= 50"""
)
def dict_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty shortest names of each script: a top-k report."""
    rows = namedb.build_dictionary(_names(spark, sf_dir)).select("script", "name", F.length("name").cast("long").alias("rank"))
    return namedb.cap_by_script(rows, 50).drop("n").select("script", "name", "rank")


@query(
    f"""with {_NAMES} select script, tier, count(*) as names, cast(sum(strlen(name)) as bigint) as bytes from dict
        group by rollup (script, tier)"""
)
def dict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return namedb.metrics(namedb.build_dictionary(_names(spark, sf_dir)))


@query(
    f"""with {_NAMES}, {_TOKENS} select tier, count(*) as n, count(distinct lower(word)) as words
        from tokens join dict on lower(word) = name group by tier"""
)
def token_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = d.word_table(_texts(spark, sf_dir), "doc_id").select("script", F.lower("text").alias("word"))
    found = namedb.token_tiers(words, namedb.build_dictionary(_names(spark, sf_dir)))
    return found.groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("word").alias("words"))


_EVAL = """pred as (select distinct doc_id as c, 'TOXIC' as t from labels where toxic = 1 and doc_id % 7 <> 0
                    union select distinct doc_id, 'QUALITY' from labels where quality = 1),
       want as (select distinct doc_id as c, 'TOXIC' as t from labels where toxic = 1
                union select distinct doc_id, 'QUALITY' from labels where quality = 1 and doc_id % 5 <> 0),
       matched as (select coalesce(p.t, w.t) as type, case when p.c is not null and w.c is not null then 'tp' when w.c is null then 'fp' else 'fn' end as o
                   from pred p full join want w on p.c = w.c and p.t = w.t),
       counted as (select coalesce(type, 'ALL') as type, count(*) filter (o = 'tp') as tp, count(*) filter (o = 'fp') as fp,
                          count(*) filter (o = 'fn') as fn from matched group by rollup (type))"""


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case"), "quality", "toxic", F.lit("x").alias("text"))
    toxic, good = rows.where("toxic = 1").withColumn("type", F.lit("TOXIC")), rows.where("quality = 1").withColumn("type", F.lit("QUALITY"))
    return toxic.where("case % 7 <> 0").unionByName(good), toxic.unionByName(good.where("case % 5 <> 0"))


@query(f"with {_EVAL} select type, o as outcome, count(*) as n from matched group by all")
def eval_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.match_strict(*_labelled(spark, sf_dir)).groupBy("type", "outcome").agg(F.count("*").alias("n"))


@query(
    f"""with {_EVAL}, pr as (select *, case when tp + fp = 0 then 1.0 else tp / (tp + fp) end as precision,
            case when tp + fn = 0 then 1.0 else tp / (tp + fn) end as recall from counted)
        select type, tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall,
               round(case when precision + recall = 0 then 0.0 else 2 * precision * recall / (precision + recall) end, 9) as f1 from pr"""
)
def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.scores(evaluate.match_strict(*_labelled(spark, sf_dir)))
    return out.select("type", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("select time_bucket(interval '5 minutes', ts) as window_start, event_type, count(*) as n from events group by all")
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by five-minute window; an extension that the batch and streaming API share."""
    return counts_by_window(_table(spark, sf_dir, "events"), "ts", "event_type")


for _name, (_run, _sql) in golden.QUERIES.items():
    QUERIES[_name] = _run
    ORACLES[_name] = _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonymised documents: (doc_id, sanitized, n_spans)."""
    return pseudonymize_documents(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
