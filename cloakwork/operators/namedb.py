"""The name dictionary as a DataFrame: (script, tier, name)."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.lexicons import NON_NAMES
from ..functions.text import WORD, fold, hangul_spellings, script_of
from .names import Dictionary

#: Names that a driver may gather for the name finder; beyond it, pass a smaller dictionary.
MAX_NAMES = 5_000_000

# A small core of common names, so that the finder works without data; pass your own for more.
CORE = {
    "Latin": (
        "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark donald steven"
        " paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric"
        " jonathan stephen larry justin scott brandon mary patricia jennifer linda elizabeth barbara susan jessica sarah"
        " karen nancy lisa margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie"
        " rebecca laura helen anna maria jane julia kai uwe kai-uwe hans klaus peter wolfgang jürgen günther stefan"
        " andreas martin sabine monika petra ursula heike smith johnson williams jones garcia miller davis rodriguez"
        " martinez hernandez lopez gonzalez wilson anderson taylor moore jackson lee perez thompson harris clark lewis"
        " robinson walker hall allen wright hill adams baker nelson campbell mitchell roberts müller schmidt schneider"
        " fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf braun omar ahmed mohammed ali"
        " hassan fatima farouk rashid amir leila gurion cohen levi yosef zhang li wang chen liu yang huang zhao wei nadia"
        " dimitri petrov ivanov priya sharma patel kumar singh raj anita frank rose will may berlin"
    ).split(),
    "Arabic": "محمد حسن علي فاطمة".split(),
    "Hebrew": "דוד משה שרה כהן".split(),
    "Devanagari": "प्रिया शर्मा राज कुमार".split(),
}


def core_rows() -> list[tuple[str, str, str]]:
    return [(script, "core", n) for script, names in CORE.items() for n in names]


def core_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(core_rows(), "script string, tier string, name string")


def build_dictionary(rows: DataFrame) -> DataFrame:
    """Lower-cased distinct names; a name in both tiers of a script is core."""
    named = rows.where(F.col("name").isNotNull() & (F.trim("name") != ""))
    named = named.select("script", F.lower(F.trim("name")).alias("name"), "tier")
    # of the two tier names the core one sorts first
    return named.groupBy("script", "name").agg(F.min("tier").alias("tier")).select("script", "tier", "name")


def merge_inputs(core: DataFrame, ingested: DataFrame) -> DataFrame:
    """Curated names are core; ingested Latin names that are not core are ext; other scripts are core."""
    c = core.select("script", F.lower("name").alias("name")).distinct()
    i = ingested.select("script", F.lower("name").alias("name")).distinct()
    ext = i.where("script = 'Latin'").join(c, ["script", "name"], "left_anti").select("script", F.lit("ext").alias("tier"), "name")
    native = i.where("script <> 'Latin'").unionByName(c).distinct().select("script", F.lit("core").alias("tier"), "name")
    return ext.unionByName(native)


def cap_by_script(rows: DataFrame, cap: int) -> DataFrame:
    """The first cap names of each script, by rank and name."""
    order = W.partitionBy("script").orderBy("rank", "name")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


#: Names kept of each script when a harvest is capped; fixed values.
CAPS = {
    "Latin": 150_000, "Cyrillic": 20_000, "Greek": 20_000, "Arabic": 20_000, "Hebrew": 10_000, "Devanagari": 20_000,
    "Hangul": 15_000, "Bengali": 20_000, "Tamil": 20_000, "Telugu": 20_000, "Gujarati": 20_000, "Kannada": 20_000,
    "Malayalam": 20_000, "Oriya": 20_000, "Armenian": 20_000, "Georgian": 20_000, "Gurmukhi": 20_000, "Thai": 20_000,
}
#: Letters that a romanised or folded variant has at least.
LEAST_VARIANT = 3


@F.pandas_udf(ArrayType(StringType()))
def _spellings(names: pd.Series) -> pd.Series:
    return names.map(hangul_spellings)


def clean_labels(labels: DataFrame, col: str = "label", split: bool = True, stop: Iterable[str] = NON_NAMES) -> DataFrame:
    """Distinct (script, name) of harvested labels.

    Brackets are cut out, labels split at white space if split, words lower-cased; words of
    letters with two or more of them stay, unless they are in stop.  Hangul names also come
    romanised, Latin names without diacritics, if that leaves LEAST_VARIANT letters.
    """
    plain = F.trim(F.regexp_replace(F.col(col), r"\s*\([^)]*\)\s*", " "))
    parts = F.split(plain, r"\s+") if split else F.array(plain)
    words = labels.select(F.explode(parts).alias("part")).select(F.lower(F.trim("part")).alias("name"))
    words = words.where(F.col("name").rlike(f"^{WORD}$") & (F.length("name") >= 2)).distinct()
    words = words.withColumn("script", script_of("name")).where(~F.col("script").isin("Han", "Other"))
    hangul = words.where("script = 'Hangul'").select(F.explode(_spellings("name")).alias("name"))
    folded = words.where("script = 'Latin'").select(fold(F.col("name")).alias("name"), F.col("name").alias("own")).where("name <> own")
    more = hangul.unionByName(folded.select("name")).where(F.length("name") >= LEAST_VARIANT)
    out = words.select("script", "name").unionByName(more.select(F.lit("Latin").alias("script"), "name"))
    return out.where(F.col("name").rlike(f"^{WORD}$") & ~F.col("name").isin(*sorted(stop))).distinct()


def cap_harvest(rows: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """(script, name): the first caps[script] names of each script in the order of names; other scripts go."""
    limit = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("script")]
    n = F.row_number().over(W.partitionBy("script").orderBy("name"))
    return rows.where(limit.isNotNull()).withColumn("n", n).where(F.col("n") <= limit).select("script", "name")


def rank_census(rows: DataFrame, stop: Iterable[str] = NON_NAMES, top: int = 50_000) -> DataFrame:
    """(name, rank): the first top distinct names of a frequency list (name, rank), without the words of stop."""
    low = rows.select(F.lower(F.trim("name")).alias("name"), "rank")
    low = low.where(F.col("name").rlike(f"^{WORD}$") & (F.length("name") >= 2) & ~F.col("name").isin(*sorted(stop)))
    return low.groupBy("name").agg(F.min("rank").alias("rank")).orderBy("rank").limit(top)


def metrics(rows: DataFrame) -> DataFrame:
    """Names by script and tier, with totals."""
    return rows.rollup("script", "tier").agg(F.count("*").alias("names"), F.sum(F.octet_length("name")).alias("bytes"))


def token_tiers(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """tokens (script, word) with the best tier of each word that the dictionary knows."""
    best = dictionary.groupBy("script", F.col("name").alias("word")).agg(F.min("tier").alias("tier"))
    return tokens.join(best, ["script", "word"])


def bloom_size(n: int, p: float = 1e-4) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n items at false-positive rate p."""
    m = max(8, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    return m, max(1, round(m / max(n, 1) * math.log(2)))


def to_lookup(rows: DataFrame | Dictionary | None) -> Dictionary:
    """A dictionary for the name finder; its size is checked before it is gathered."""
    if rows is None:
        return Dictionary(core_rows())
    if isinstance(rows, Dictionary):
        return rows
    n = rows.count()
    if n > MAX_NAMES:
        raise ValueError(f"{n} names; at most {MAX_NAMES} fit the name finder")
    return Dictionary((r["script"], r["tier"], r["name"]) for r in rows.select("script", "tier", "name").toLocalIterator())
