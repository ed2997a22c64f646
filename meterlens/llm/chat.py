"""Chat formatting in windows of a token budget.

Prefix sums of turn tokens lay the turns of a conversation on a line. The line is ruled into cells of half the room a
window has for new turns, and a turn belongs to the cell its start lies in: as long as no turn is longer than a cell,
the turns of one cell never exceed the room; a longer turn gets a window of its own. So every window follows from the
prefix sums alone, without going through the conversation step by step, and a conversation of any length is spread
over many tasks. Each window repeats the system turn and the last turns before it, up to a limit of tokens; repeated
turns are context and only new assistant texts are under the loss mask.

Texts are marked up with control strings. Where a text itself holds something that reads as one, a backslash is put
after its first character, so a formatted window can be taken apart again exactly. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from meterlens.operators.ordering import running_totals

START, END = "<|im_start|>", "<|im_end|>\n"
# What follows the first character of each control string: ChatML marks, end of text, and the marks of other templates.
_TAILS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>"
_PLAIN = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"
NO_ID = -(2**63)


@dataclass(frozen=True)
class ChatParams:
    #: Tokens of a window, repeated turns included.
    budget: int = 1024
    #: Tokens of earlier turns that a window repeats at most.
    history: int = 256
    #: Tokens of a turn's marks.
    overhead: int = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_PLAIN), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED), F.lit("$1$2$3"))


def _escape_role(role: Column) -> Column:
    """A role stands on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def tokens(text: Column, overhead: int) -> Column:
    """Cost of a turn: its words and marks, and the marks of the template."""
    return (F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + overhead).cast("long")


def windows(conversations: DataFrame, params: ChatParams = ChatParams()) -> DataFrame:
    """Formatted windows of all conversations (conv_id, turn, role, text).

    Columns: conv_id, span (ascending within a conversation), text, loss (array of start and length in code points),
    n_turns and n_repeated (the first ``n_repeated`` turns of a window stood in earlier ones), n_tokens, over_budget.

    Turns go by number, then role and text; a null number comes first. Null roles and texts are empty. Repeated rows
    are turns of their own. Rows with a null conv_id make up one conversation. A first turn of the role ``system`` is
    retained in every window, unless it is the only turn. A turn that exceeds a window by itself is kept whole and its
    window is marked ``over_budget``. An empty table gives an empty result.
    """
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("conv_id").cast("long").alias("conv_id"),
    ).withColumn("cost", tokens(F.col("text"), params.overhead))
    summed = running_totals(rows, ["key"], ["turn", "role", "text"], {"pos": F.lit(1), "end": F.col("cost")})
    system = F.when((F.col("pos") == 1) & (F.col("role") == "system"), F.struct("text", "cost"))
    per_conv = summed.groupBy("key").agg(F.sum("cost").alias("total"), F.max(system).alias("system"))
    per_conv = per_conv.withColumn("system", F.when(F.col("system.cost") < F.col("total"), F.col("system")))
    kept = F.coalesce(F.col("system.cost"), F.lit(0))
    placed = (
        summed.join(per_conv, "key")
        .where(F.col("system").isNull() | (F.col("pos") > 1))
        .withColumn("start", F.col("end") - F.col("cost") - kept)
        .withColumn("total", F.col("total") - kept)
        # Half of what the system turn and the history leave of the budget; the history is no longer than a cell.
        .withColumn("cell", F.greatest(F.lit(1), F.floor((params.budget - params.history - kept) / 2)))
        .withColumn("reach", F.least(F.lit(params.history), F.col("cell")))
        .withColumn(
            "span", 2 * F.floor(F.col("start") / F.col("cell")) + F.when(F.col("cost") > F.col("cell"), 1).otherwise(0)
        )
        # Windows that could repeat the turn: those that start within reach, up to the last cell in use.
        .withColumn(
            "until",
            2 * F.floor(F.least(F.col("start") + F.col("reach"), F.col("total") - 1) / F.col("cell")) + 1,
        )
    )
    spread = placed.withColumn("at", F.explode(F.expr("sequence(span, greatest(span, until))")))
    fresh = F.col("at") == F.col("span")
    grouped = (
        spread.groupBy("key", F.col("at").alias("span"))
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.first("system").alias("system"),
            F.first("reach").alias("reach"),
            F.min(F.when(fresh, F.col("start"))).alias("from"),
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "start",
                        "pos",
                        fresh.alias("fresh"),
                        "cost",
                        _escape_role(F.col("role")).alias("role"),
                        escape(F.col("text")).alias("text"),
                    )
                )
            ).alias("turns"),
        )
        .where(F.col("from").isNotNull())
    )
    repeats = F.col("system").isNotNull() & (F.col("from") > 0)
    head = F.when(
        F.col("system").isNotNull(),
        F.array(
            F.struct(
                F.lit(-1).cast("long").alias("start"),
                F.lit(0).cast("long").alias("pos"),
                F.lit(False).alias("fresh"),
                F.col("system.cost").alias("cost"),
                F.lit("system").alias("role"),
                escape(F.col("system.text")).alias("text"),
            )
        ),
    )
    near = F.filter("turns", lambda t: t["fresh"] | (t["start"] >= F.col("from") - F.col("reach")))
    chosen = grouped.withColumn("repeats", repeats).withColumn("turns", near).withColumn(
        "n_repeated",
        F.size(F.filter("turns", lambda t: ~t["fresh"])) + F.when(F.col("repeats"), 1).otherwise(0),
    )
    chosen = chosen.withColumn("turns", F.when(head.isNotNull(), F.concat(head, "turns")).otherwise(F.col("turns")))
    before_text = lambda t: F.length(t["role"]) + len(START) + 1
    marked = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
        lambda acc, t: F.struct(
            (acc["at"] + before_text(t) + F.length(t["text"]) + len(END)).cast("int").alias("at"),
            F.when(
                t["fresh"] & (t["role"] == "assistant"),
                F.concat(
                    acc["loss"],
                    F.array(
                        F.struct(
                            (acc["at"] + before_text(t)).cast("int").alias("start"),
                            F.length(t["text"]).cast("int").alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(acc["loss"])
            .alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    spent = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["cost"])
    return chosen.select(
        "conv_id",
        "span",
        F.array_join(
            F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), ""
        ).alias("text"),
        marked.alias("loss"),
        F.size("turns").alias("n_turns"),
        "n_repeated",
        spent.alias("n_tokens"),
        (spent > params.budget).alias("over_budget"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """Windows with ``turns``, the new turns (role, text) taken back from the formatted text, and ``learned``, the
    texts under the loss mask."""
    parts = F.split("text", F.lit(r"<\|im_end\|>\n"), -1)
    opened = F.expr(f"transform(slice(__p, 1, size(__p) - 1), p -> substr(p, {len(START) + 1}))")
    return (
        formatted.withColumn("__p", parts)
        .withColumn("__p", opened)
        .withColumn("__p", F.expr("slice(__p, n_repeated + 1, size(__p))"))
        .withColumn(
            "turns",
            F.transform(
                "__p",
                lambda p: F.struct(
                    _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
                    unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2)).alias("text"),
                ),
            ),
        )
        .withColumn(
            "learned",
            F.transform(
                "loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"]))
            ),
        )
        .drop("__p")
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows.

    One conversation's texts meet in one row here, as a digest of them all needs.
    """
    read = read_turns(formatted).select(
        "conv_id",
        F.struct(
            "span",
            F.size("turns").alias("n"),
            F.array_join(
                F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
            ).alias("said"),
            F.array_join("learned", "").alias("learned"),
        ).alias("window"),
        F.length("text").cast("long").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("window")).alias("windows"), F.sum("chars").alias("formatted_chars")
    )
    joined = whole.select(
        "conv_id",
        F.aggregate("windows", F.lit(0).cast("long"), lambda acc, w: acc + w["n"]).alias("n_turns"),
        F.array_join("windows.said", "").alias("said"),
        F.array_join("windows.learned", "").alias("learned"),
        "formatted_chars",
    )
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
