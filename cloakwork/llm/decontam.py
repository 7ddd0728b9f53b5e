"""Benchmark items inside long documents: size-partitioned MinHash containment search.

An item with n shingles is contained at level t if a document holds at least
ceil(t * n) of them.  Items are partitioned by size; the sketch of an item keeps its
m least shingle hashes, with m = n - ceil(t * n) + 1 taken for each size, which is
the least m for which a document at the threshold must hold one of them.  Documents
are probed with all their shingle hashes, whatever their length and in one scan, so the
search loses nothing; what it finds is verified by counting equal shingles, as texts.

Only DataFrame functions are used.  Words are runs of letters and digits,
lower-cased; a shingle is five words in a row.  An item of one to four words is one
shingle of its own length and is looked for at that length; an item without words
or with a null id or text matches nothing.  A repeated item gives repeated
results, a repeated row counts once; a null or empty document has no shingles.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Hashes of benchmark shingles that may be broadcast; beyond it both sides are shuffled.
INDEX_ROWS = 2_000_000
#: Shingles with their texts, some 200 bytes each, that may be broadcast for the verification.
VERIFY_ROWS = 250_000


def words_of(text: str | Column) -> Column:
    """The words of a text, in order."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles_of(words: str, k: int) -> Column:
    """Hashes of all runs of k words."""
    run = f"transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64({', '.join(f'{words}[i + {j - 1}]' for j in range(k))}))"
    return F.expr(f"if(size({words}) >= {k}, {run}, cast(array() as array<bigint>))")


def named_shingles(words: str, k: int) -> Column:
    """(h, g) of all runs of k words: hash and text."""
    at = [f"{words}[i + {j - 1}]" for j in range(k)]
    run = f"transform(sequence(1, size({words}) - {k - 1}), i -> named_struct('h', xxhash64({', '.join(at)}), 'g', concat_ws(' ', {', '.join(at)})))"
    return F.expr(f"if(size({words}) >= {k}, {run}, cast(array() as array<struct<h: bigint, g: string>>))")


def index_items(items: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """(item, row, k, n, h, g, sketch): the distinct shingles of each item, its sketch marked."""
    parts = None
    base = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("item"), F.monotonically_increasing_id().alias("row"), words_of(text_col).alias("w")
    )
    base = materialize(base.where(F.size("w") > 0), "items")
    for size in range(1, k + 1):
        own = base.where(F.size("w") >= k if size == k else F.size("w") == size)
        part = own.select("item", "row", F.lit(size).alias("k"), F.array_sort(F.array_distinct(named_shingles("w", size))).alias("hs"))
        parts = part if parts is None else parts.unionByName(part)
    sized = parts.withColumn("n", F.size("hs"))
    # the size partition decides how many least hashes the sketch holds
    m = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    sized = sized.withColumn("m", m.cast("int"))
    return materialize(
        sized.select("item", "row", "k", "n", "m", F.posexplode("hs").alias("pos", "x")).select(
            "item", "row", "k", "n", "x.h", "x.g", (F.col("pos") < F.col("m")).alias("sketch")
        ),
        "items-index",
    )


def _found(
    docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, words: int, threshold: float
) -> DataFrame:
    """(doc, drow, item, n, n_shared) of all pairs at or above threshold; drow is the hash of the text."""
    index = index_items(items, item_id, item_text, words, threshold)
    total = index.count()
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("drow"), words_of(text_col).alias("w")
    )
    sizes = [r["k"] for r in index.select("k").distinct().orderBy("k").collect()]  # at most `words` values
    if not sizes:
        return base.select(
            "doc", "drow", F.lit(None).cast(items.schema[item_id].dataType).alias("item"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("n_shared")
        ).where(F.lit(False))
    # one scan probes for all lengths of shingles
    probe = base.select("doc", "drow", F.explode(F.concat(*[shingles_of("w", k) for k in sizes])).alias("h"))
    keys = broadcast_if_small(index.where("sketch").select("h").distinct(), total, INDEX_ROWS)
    met = materialize(probe.join(keys, "h", "left_semi").select("doc", "drow").distinct(), "leaks-met")
    found = base.join(broadcast_if_small(met), ["doc", "drow"], "left_semi")
    grams = F.array_distinct(F.flatten(F.array(*[F.transform(named_shingles("w", k), lambda x: x["g"]) for k in sizes])))
    held = found.select("doc", "drow", F.explode(grams).alias("g"))
    own = broadcast_if_small(index.select("g", "item", "row", "n", "sketch"), total, VERIFY_ROWS)
    shared = held.join(own, "g").distinct().groupBy("doc", "drow", "item", "row", "n").agg(
        F.count("*").alias("n_shared"), F.max("sketch").alias("sketched")
    )
    sure = shared.where("sketched").where(F.col("n_shared") >= F.ceil(F.col("n") * F.lit(threshold) - 1e-9))
    return sure.select("doc", "drow", "item", "n", "n_shared")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of all pairs at or above threshold."""
    return _found(docs, items, id_col, text_col, item_id, item_text, words, threshold).select(
        F.col("doc").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("n").cast("long").alias("n_item"),
        "n_shared",
        (F.col("n_shared") / F.col("n")).alias("containment"),
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words: int = 5,
    threshold: float = 0.8,
) -> DataFrame:
    """docs without the rows that contain an item; columns unchanged, rows with a null id kept.

    Of rows that share an id each is judged by its own text.
    """
    bad = _found(docs, items, id_col, text_col, item_id, item_text, words, threshold)
    bad = materialize(bad.select(F.col("doc").alias("_leaked"), F.col("drow").alias("_leak_hash")).distinct(), "leaks")
    # the row is one struct, so that its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    on = (F.col("_row").getField(id_col) == F.col("_leaked")) & (F.xxhash64(F.col("_row").getField(text_col)) == F.col("_leak_hash"))
    return rows.join(broadcast_if_small(bad), on, "left_anti").select("_row.*")
