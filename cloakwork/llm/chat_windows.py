"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut each conversation into spans of whole turns.  A turn
belongs to the window of the stretch of the prefix sum in which it starts; a stretch is two
thirds of the budget, and a turn that reaches beyond the budget is a window of its own, so
only a single turn can exceed it.  Every window starts with the system turn, repeats as many earlier turns
as fit the history budget, and puts only its own assistant texts under the loss mask,
so that repeated targets count once.

A turn is written <|im_start|>role, a line feed, the text, <|im_end|>, a line feed.
Inside roles and texts each run `<`, any number of backslashes, `|` gets one more
backslash, which reading back takes away, so a control string never stands inside.
In roles, backslash and line feed are escaped before that.

Prefix sums go in two levels (blocks of turn numbers, then within a block), so a
conversation that holds a third of all rows is not sorted in one task.  Tokens are
estimated as words and single other characters, plus TURN_TOKENS for the marks.

Defined cases: a null role or text is empty; null turns come first; turns with equal
numbers are ordered by role and text; repeated rows are repeated turns; rows with a
null conv_id are one conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURN_TOKENS = 4
#: Turn numbers that are summed together.
BLOCK_TURNS = 64
FIRST = -(2**62)

_ESC = r"regexp_replace({x}, '<(\\\\*)\\|', '<$1\\\\|')"
_UNESC = r"regexp_replace({x}, '<(\\\\*)\\\\\\|', '<$1|')"


def escape(x: str) -> str:
    """SQL: x without any control string."""
    return _ESC.format(x=x)


def unescape(x: str) -> str:
    return _UNESC.format(x=x)


def escape_role(x: str) -> str:
    return escape(rf"replace(replace({x}, '\\', '\\\\'), '\n', '\\n')")


def unescape_role(x: str) -> str:
    return rf"array_join(transform(split({unescape(x)}, '\\\\\\\\', -1), p -> replace(p, '\\n', '\n')), '\\')"


def token_count(text: Column) -> Column:
    """An estimate that needs no vocabulary: words and other visible characters."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def _turns(conversations: DataFrame, tokens) -> DataFrame:
    """(conv, t, n, sys, role, text, cum, tok): cum is the sum before a turn, sys apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = conversations.select(
        F.col("conv_id").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("t"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
        (tokens(text) + TURN_TOKENS).alias("tok"),
    ).withColumn("block", F.floor(F.col("t") / BLOCK_TURNS))
    inner = W.partitionBy("conv", "block").orderBy("t", "role", "text")
    base = base.withColumn("n", F.row_number().over(inner))
    blocks = base.groupBy("conv", "block").agg(
        F.sum("tok").alias("total"),
        F.count("*").alias("rows"),
        F.max(F.when((F.col("n") == 1) & (F.col("role") == "system"), F.col("tok")).otherwise(0)).alias("lead"),
    )
    by_block = W.partitionBy("conv").orderBy("block")
    blocks = blocks.withColumn("b", F.row_number().over(by_block))
    # the system turn is the first row of the first block
    blocks = blocks.withColumn("systok", F.when(F.col("b") == 1, F.col("lead")).otherwise(0))
    before = by_block.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv").alias("bconv"),
        F.col("block").alias("bblock"),
        "b",
        F.coalesce(F.sum(F.col("total") - F.col("systok")).over(before), F.lit(0)).alias("before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.max("systok").over(W.partitionBy("conv")).alias("systok"),
    )
    base = base.join(blocks, F.col("conv").eqNullSafe(F.col("bconv")) & (F.col("block") == F.col("bblock")))
    base = base.withColumn("sys", (F.col("b") == 1) & (F.col("n") == 1) & (F.col("role") == "system"))
    running = F.sum(F.when(F.col("sys"), 0).otherwise(F.col("tok"))).over(inner.rowsBetween(W.unboundedPreceding, 0))
    cum = F.col("before") + running - F.when(F.col("sys"), 0).otherwise(F.col("tok"))
    return base.select(
        "conv", (F.col("rows_before") + F.col("n")).alias("pos"), "sys", "role", "text", "tok", "systok", cum.alias("cum")
    )


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens=token_count) -> DataFrame:
    """(conv_id, window, n_repeated, n_turns, formatted, loss): one row for each window.

    loss holds the [start, end) code points of the assistant texts of the window's own
    turns; the first n_repeated of its n_turns turns stand in earlier windows too.
    """
    turns = _turns(conversations, tokens)
    free = F.greatest(F.lit(budget) - F.col("systok") - history, F.lit(max(history, budget // 8))).cast("long")
    # a stretch leaves a third of the budget to the turn that reaches beyond it
    turns = turns.withColumn("room", F.greatest(F.floor(free * 2 / 3), F.lit(history).cast("long"), F.lit(1).cast("long")))
    turns = turns.withColumn("stretch", F.floor(F.col("cum") / F.col("room")))
    crosses = ~F.col("sys") & (F.col("cum") + F.col("tok") > F.col("stretch") * F.col("room") + F.greatest(free, F.col("room")))
    turns = turns.withColumn("win", F.when(F.col("sys"), F.lit(0)).otherwise(F.col("stretch") * 2 + crosses.cast("long")))
    mark = F.expr(f"concat('{START}', {escape_role('role')}, '\\n')")
    turns = turns.select(
        "conv", "pos", "sys", "tok", "cum", "room", "stretch", "win", mark.alias("head"),
        F.expr(escape("text")).alias("body"), (F.col("role") == "assistant").alias("target"),
    )
    starts = turns.where("not sys").groupBy("conv", "win").agg(F.min("cum").alias("wstart"))
    starts = starts.select(F.col("conv").alias("wconv"), "win", F.floor(F.col("win") / 2).alias("wstretch"), "wstart")
    # windows that start within the history budget lie in this stretch or the next
    near = turns.where("not sys").withColumn("near", F.explode(F.array("stretch", F.col("stretch") + 1)))
    near = near.drop("win").join(
        starts,
        F.col("conv").eqNullSafe(F.col("wconv"))
        & (F.col("near") == F.col("wstretch"))
        & (F.col("wstart") >= F.col("cum") + F.col("tok"))
        & (F.col("wstart") <= F.col("cum") + history),
    )
    cols = ["conv", "win", "pos", "own", "head", "body", "target"]
    own = turns.withColumn("own", F.lit(True)).select(*cols)
    past = near.withColumn("own", F.lit(False)).select(*cols)
    lead = turns.where("sys").drop("win").join(starts.where("win > 0"), F.col("conv").eqNullSafe(F.col("wconv")))
    lead = lead.withColumn("own", F.lit(False)).select(*cols)
    rows = own.unionByName(past).unionByName(lead)
    part = F.struct("pos", "own", "head", "body", "target")
    # a window is bounded by the budget, or is one turn
    wins = rows.groupBy("conv", "win").agg(F.array_sort(F.collect_list(part)).alias("turns"))
    built = F.expr(
        "aggregate(turns, named_struct('out', '', 'loss', cast(array() as array<struct<s: int, e: int>>)), (a, x) ->"
        f" named_struct('out', concat(a.out, x.head, x.body, '{END}\\n'), 'loss', if(x.own and x.target,"
        " array_append(a.loss, named_struct('s', length(a.out) + length(x.head), 'e', length(a.out) + length(x.head) + length(x.body))),"
        " a.loss)))"
    )
    wins = wins.select("conv", "win", F.size(F.expr("filter(turns, x -> not x.own)")).alias("n_repeated"), F.size("turns").alias("n_turns"), built.alias("b"))
    return wins.select(
        F.col("conv").alias("conv_id"), F.col("win").alias("window"), "n_repeated", "n_turns",
        F.col("b.out").alias("formatted"), F.col("b.loss").alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the windows."""
    piece = r"split(formatted, '<\\|im_start\\|>', -1)"
    # what follows the last mark before it is a turn; repeated ones come first
    own = f"slice({piece}, n_repeated + 2, n_turns - n_repeated)"
    head = "substring_index(p, '\\n', 1)"
    body = f"substring(p, length({head}) + 2, length(p) - length({head}) - {len(END) + 2})"
    turn = f"concat({unescape_role(head)}, '\\n', {unescape(body)}, '\\n')"
    parsed = windows.select(
        "conv_id",
        "window",
        F.length("formatted").cast("long").alias("chars"),
        F.expr(f"transform({own}, p -> {turn})").alias("turns"),
        F.expr(f"array_join(transform(loss, x -> {unescape('substring(formatted, x.s + 1, x.e - x.s)')}), '')").alias("lost"),
    )
    # a digest of a whole conversation needs its text in one place
    conv = parsed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("window", "turns", "lost"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    text = F.expr("array_join(flatten(transform(w, x -> x.turns)), '')")
    lost = F.expr("array_join(transform(w, x -> x.lost), '')")
    conv = conv.select(
        "conv_id", "formatted_chars", F.expr("size(flatten(transform(w, x -> x.turns)))").cast("long").alias("n_turns"),
        text.alias("text"), lost.alias("lost"),
    )
    return conv.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("text").cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
