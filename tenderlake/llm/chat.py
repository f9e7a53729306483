"""Chat formatting in budgeted windows (native).

Turns are ordered within a conversation, their tokens summed up as prefix
sums, and every conversation is cut into turn-aligned windows: a turn belongs
to the window ``floor(tokens before it / span)``.  Each window starts with the
leading system turn, then repeats the last turns before it that fit the
history budget, then has its own turns.  The loss covers the text of a
window's own assistant turns only, so each assistant text is a target once;
repeated turns are masked.

With ``budget`` tokens a window, ``span`` is half of it and ``history`` an
eighth: own turns stay under ``span`` plus their last turn.  A turn longer
than the budget is never cut, its window is longer.

Prefix sums run over blocks of 256 turn numbers first and inside a block
second, so one very long conversation spreads over many tasks; a window
gathers a bounded number of turns, as even an empty turn counts tokens.

Text layout of one turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Control
strings inside roles and texts (these marks and those of other common
templates) are escaped by entities, reversibly.

Defined cases: a null text or role is empty; turns are ordered by turn number
(null first), then role, then text; repeated rows are turns of their own; null
conversation ids are one conversation; an empty table gives no windows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import saved

BUDGET = 2048
TURN_TOKENS = 4          # marks of one turn
BLOCK = 256
# Fixed strings of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM, TARGET = "system", "assistant"


def tokens(text: Column) -> Column:
    """Length in tokens, counted as words and single marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")) + TURN_TOKENS


def escape(text: Column) -> Column:
    """``&`` first, then the first character of each control string."""
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    text = F.regexp_replace(text, r"<(?=\||/?s>|</?SYS>>)", "&lt;")
    return F.regexp_replace(text, r"\[(?=/?INST\])", "&lsqb;")


def unescape(text: Column) -> Column:
    for entity, char in (("&lsqb;", "["), ("&lt;", "<"), ("&nl;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns with their 1-based position and tokens before them."""
    base = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("_block"),
        # keys without nulls, so that one equi-join serves all conversations
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_conv"))
    base = base.withColumn("_tok", tokens(F.col("text")).cast("long"))
    sums = base.groupBy("_conv", "_block").agg(F.sum("_tok").alias("_t"), F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy("_conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_conv", "_block", F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_t0"),
                       F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0"))
    within = Window.partitionBy("_conv", "_block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    return (base.withColumn("_i", F.row_number().over(within))
            .withColumn("_b", F.coalesce(F.sum("_tok").over(upto), F.lit(0)))
            .join(sums, ["_conv", "_block"])
            .withColumn("pos", F.col("_n0") + F.col("_i")).withColumn("before", F.col("_t0") + F.col("_b")))


def format_windows(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row per window: conv_id, window, text, n_context (leading repeated
    turns), n_turns (own turns), n_tokens, and loss: (start, end) spans in code
    points of the window's text.

    ``turns`` needs the columns conv_id, turn, role, text."""
    span, history = budget // 2, budget // 8
    t = _ordered(turns)
    t = saved(t.select("conv_id", "_conv", "role", "text", "pos", "before", "_tok",
                       F.floor(F.col("before") / span).alias("window")), "chat-turns")
    starts = t.groupBy("_conv", "window").agg(F.min("before").alias("_start"))
    own = t.withColumn("own", F.lit(True))
    system = (F.col("pos") == 1) & (F.col("role") == SYSTEM)
    # a turn can only be history of the very next window, as history < span
    again = (t.where(~system).withColumn("window", F.col("window") + 1)
             .join(starts, ["_conv", "window"])
             .where(F.col("_start") - F.col("before") <= history).drop("_start"))
    lead = (t.where(system).drop("window")
            .join(starts.where("window > 0").select("_conv", "window"), "_conv"))
    rows = own.unionByName(again.withColumn("own", F.lit(False))).unionByName(
        lead.withColumn("own", F.lit(False)))
    head = F.concat(F.lit(BEGIN), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("_body", escape(F.col("text"))).withColumn("_head", head)
    item = F.struct("pos", "own", F.concat("_head", "_body", F.lit(END)).alias("all"),
                    F.length("_head").alias("h"), F.length("_body").alias("b"),
                    (F.col("own") & (F.col("role") == TARGET)).alias("hit"))
    w = rows.groupBy("_conv", "window").agg(
        F.first("conv_id").alias("conv_id"), F.sum("_tok").alias("n_tokens"),
        F.sort_array(F.collect_list(item)).alias("_items"))
    state = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    folded = F.aggregate(
        "_items", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        .cast(state),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["all"])).alias("at"),
            F.when(x["hit"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["h"]).alias("start"), (acc["at"] + x["h"] + x["b"]).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")).cast(state))
    return w.select(
        "conv_id", "window",
        F.array_join(F.transform("_items", lambda x: x["all"]), "").alias("text"),
        F.size(F.filter("_items", lambda x: ~x["own"])).alias("n_context"),
        F.size(F.filter("_items", lambda x: x["own"])).alias("n_turns"),
        "n_tokens", folded["spans"].alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """The conversations again, from the formatted windows alone: conv_id and
    the arrays ``turns`` (role, text) and ``targets`` (text under the loss
    mask, per span), unescaped, plus formatted_chars."""
    parts = F.slice(F.split("text", r"<\|im_start\|>"), F.col("n_context") + 2, F.col("n_turns"))

    def turn(x: Column) -> Column:
        cut = F.locate("\n", x)
        return F.struct(unescape(F.substring(x, F.lit(1), cut - 1)).alias("role"),
                        unescape(F.substring(x, cut + 1, F.length(x) - cut - len(END))).alias("text"))

    w = windows.select(
        "conv_id", "window", F.length("text").alias("_chars"), F.transform(parts, turn).alias("_turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
        .alias("_targets"))
    g = w.groupBy("conv_id").agg(
        F.sum("_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("window", "_turns", "_targets"))).alias("_w"))
    return g.select("conv_id", "formatted_chars",
                    F.flatten(F.transform("_w", lambda x: x["_turns"])).alias("turns"),
                    F.flatten(F.transform("_w", lambda x: x["_targets"])).alias("targets"))
