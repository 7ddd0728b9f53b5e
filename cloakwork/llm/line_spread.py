"""Removal of lines that are spread over many sites.

Each distinct text contributes its lines once, so copies of a whole document do
not make its lines look like boilerplate.  For each line hash the sites form a
HyperLogLog sketch; sketches merge by aggregation, so a line that stands in every
document costs one sketch a task.  Lines whose estimate is clearly above the
threshold are removed, lines clearly below stay, and those within `margin` of it are
counted exactly.  The first document (least id) that holds a removed line keeps
its first occurrence, so no content is lost altogether.

Defined cases: a null text stays null and has no lines; empty and blank lines, and
lines with fewer than min_words words, are never removed; a null source counts as
the site ''; repeated rows are treated alike; rows with a null id are treated as one
document a text; an empty table gives an empty one; lines of any length are hashed whole;
other columns pass unchanged, whatever their names (one named removed_lines is replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop_path, materialize

#: log2 of the sketch size; its standard error is about 1.04 / 2^(LG_K / 2).
LG_K = 12


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """(doc, site, text_hash, pos, line_hash) of the eligible lines, written once for all that read them."""
    base = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        F.xxhash64(text_col).alias("text_hash"),
        F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"),
    )
    held = base.where(_eligible("line", min_words))
    return materialize(held.select("doc", "site", "text_hash", "pos", F.xxhash64("line").alias("line_hash")), "lines-all")


def _spread(
    docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int, margin: float
) -> DataFrame:
    """(line_hash, first_id) of the lines on at least min_sites sites."""
    # a text counts at the site of its first copy
    base = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        F.xxhash64(text_col).alias("text_hash"),
    )
    firsts = base.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "site")).alias("f"))
    firsts = firsts.where("copies > 1").select("text_hash", F.col("f.doc").alias("fdoc"), F.col("f.site").alias("fsite"))
    firsts = materialize(firsts, "lines-firsts")
    own = lines.join(broadcast_if_small(firsts), "text_hash", "left").where(
        "fdoc is null or (doc <=> fdoc and site <=> fsite)"
    )
    sketched = own.groupBy("line_hash").agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc").alias("first_id"), F.count("*").alias("rows")
    )
    # fewer rows than sites: the line cannot reach the threshold
    spread = sketched.where(F.col("rows") >= min_sites).select(
        "line_hash", "first_id", F.hll_sketch_estimate("sketch").alias("sites")
    )
    spread = materialize(spread.where(F.col("sites") >= min_sites * (1 - margin)), "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + margin))
    near = spread.where(F.col("sites") <= min_sites * (1 + margin)).select("line_hash", "first_id")
    exact = (
        own.join(broadcast_if_small(near), "line_hash")
        .select("line_hash", "first_id", "site")
        .distinct()
        .groupBy("line_hash", "first_id")
        .count()
        .where(F.col("count") >= min_sites)
    )
    found = sure.select("line_hash", "first_id").unionByName(exact.select("line_hash", "first_id"))
    found = materialize(found, "lines-spread")
    drop_path(firsts)
    drop_path(spread)
    return found


def _eligible(line: str, min_words: int):
    """At least min_words words (one at least), parted by spaces."""
    return F.col(line).rlike("^ *+" + "[^ ]++ ++" * (min_words - 1) + "[^ ]")


def spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 16,
    min_words: int = 3,
    margin: float = 0.15,
) -> DataFrame:
    """(line_hash, first_id): lines on at least min_sites sites, and who keeps them."""
    lines = _lines(docs, id_col, text_col, site_col, min_words)
    return _spread(docs, lines, id_col, text_col, site_col, min_sites, margin)


def remove_spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 16,
    min_words: int = 3,
    margin: float = 0.15,
) -> DataFrame:
    """docs with text_col cleaned, plus removed_lines: how many lines each row lost."""
    lines = _lines(docs, id_col, text_col, site_col, min_words)
    bad = _spread(docs, lines, id_col, text_col, site_col, min_sites, margin)
    hits = lines.join(broadcast_if_small(bad), "line_hash").select("doc", "text_hash", "line_hash", "first_id", "pos")
    lost = (
        hits.groupBy("doc", "text_hash", "line_hash", "first_id")
        .agg(F.array_sort(F.collect_set("pos")).alias("at"))
        .select("doc", "text_hash", F.expr("if(doc <=> first_id, slice(at, 2, size(at)), at)").alias("at"))
        .groupBy("doc", "text_hash")
        .agg(F.flatten(F.collect_list("at")).alias("lost"))
        .where("size(lost) > 0")
    )
    lost = materialize(lost, "lines-lost")
    drop_path(lines)
    drop_path(bad)
    # the row is one struct, so that its columns may have any names
    names = [c for c in docs.columns if c != "removed_lines"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    # shuffled at every size: which texts change is not known to be few
    joined = rows.join(
        lost.hint("merge"),
        F.col("_row").getField(id_col).eqNullSafe(F.col("doc")) & (F.xxhash64(F.col("_row").getField(text_col)) == F.col("text_hash")),
        "left",
    )
    text = f"_row.`{text_col}`"
    kept = F.expr(f"array_join(filter(split({text}, '\\n', -1), (x, i) -> not array_contains(lost, i)), '\\n')")
    out = [
        F.when(F.col("lost").isNull(), F.expr(text)).otherwise(kept).alias(c) if c == text_col else F.col("_row").getField(c).alias(c)
        for c in names
    ]
    return joined.select(*out, F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("removed_lines"))
