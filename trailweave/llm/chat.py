"""Chat formatting in budgeted windows; DataFrame functions only.

Method: prefix sums of the turns' tokens cut each conversation into spans at turn
borders.  Half of the budget that the system turn and the history leave is the stride:
a span holds the turns whose prefix sum starts in one stride, so spans of ordinary
turns keep within the budget; a turn of more than a stride has a span of its own.  Only
such a turn can exceed the budget, or a system turn that alone leaves no room for a
stride; ``over_budget`` says so, and nothing is cut off.  Each window is the
system turn, then the last turns of the span before, as many as fit ``history`` tokens,
then its own span.  Only a window's own assistant turns are under its loss mask, so a
repeated target is never learned twice.

Tokens are estimated as the words and marks of a text plus ``TURN_TOKENS`` for a turn's
markers.  A turn is written as ``<|turn|>role\\ntext<|end|>\\n``; control strings inside
texts (every ``<|name|>``, ``<s>``, ``[INST]``, ``<<SYS>>`` and their closing forms) get one backslash after their first character (one more if they already have
some), which ``unescape`` takes away again.

Everything runs on one shuffle by conversation; sums and windows are streamed through
it, and only one window's turns are ever gathered in a row.  ``digest`` needs a whole
conversation in one row, as a hash of it does.

Defined cases: null text or role is empty; a null conversation id is a conversation of
its own; rows of the same turn number are ordered by role and text, repeated rows stay;
a conversation without turns has no rows; only a first turn of role ``system`` is
retained in all windows; other columns, whatever their names, are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUDGET, HISTORY, TURN_TOKENS = 1024, 128, 4
_TURN, _END = "<|turn|>", "<|end|>"
#: Strings with a meaning to chat templates, by their first character.
_ANGLE, _SQUARE = r"(\|\w+\|>|/?s>|</?SYS>>)", r"(/?INST\])"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)" + _ANGLE, r"<\\$1$2")
    return F.regexp_replace(text, r"\[(\\*)" + _SQUARE, r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"<\\(\\*)" + _ANGLE, "<$1$2")
    return F.regexp_replace(text, r"\[\\(\\*)" + _SQUARE, "[$1$2")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    role = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(role, F.lit("\\\\"), F.lit("\\"))


def windows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_context, n_tokens, over_budget, formatted, loss_spans) for each window.

    ``n_context``: turns at the start that stand in an earlier window too.
    ``loss_spans``: (start, length) in code points of ``formatted``, of the escaped texts to learn.
    """
    t = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumn("tokens", (F.regexp_count("text", F.lit(r"\w+|[^\w\s]")) + TURN_TOKENS).cast("long"))
    by_turn = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("rank", F.row_number().over(by_turn)).withColumn("system", (F.col("rank") == 1) & (F.col("role") == "system"))
    running = Window.partitionBy("conv").orderBy("rank")
    t = t.withColumns({"sys_tokens": F.coalesce(F.first(F.when(F.col("system"), F.col("tokens")), ignorenulls=True).over(running), F.lit(0)), "own": F.when(F.col("system"), 0).otherwise(F.col("tokens"))})
    t = t.withColumns({"sum": F.sum("own").over(running), "stride": F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("sys_tokens")) / 2))})
    t = t.withColumns({"big": F.col("own") > F.col("stride"), "slot": F.floor((F.col("sum") - F.col("own")) / F.col("stride"))})
    t = t.withColumn("breaks", ~F.col("system") & (F.col("big") | (F.col("slot") != F.lag("slot").over(running)) | F.lag("big").over(running)) & (F.col("rank") > 1) & ~F.coalesce(F.lag("system").over(running), F.lit(False)))
    t = t.withColumn("span", F.sum(F.when(F.col("breaks"), 1).otherwise(0)).over(running))
    every = Window.partitionBy("conv")
    t = t.withColumns({"last": F.max("span").over(every), "end": F.max("sum").over(Window.partitionBy("conv", "span"))})
    again = ~F.col("system") & (F.col("span") < F.col("last")) & (F.col("end") - F.col("sum") + F.col("own") <= history)
    where = F.when(F.col("system"), F.sequence(F.lit(0), F.col("last"))).when(again, F.array(F.col("span"), F.col("span") + 1)).otherwise(F.array("span"))
    t = t.select("conv", "rank", "role", "text", "tokens", "span", F.explode(where.cast("array<int>")).alias("window"))
    head = F.concat(F.lit(_TURN), _escape_role(F.col("role")), F.lit("\n"))
    t = t.withColumns({"fresh": F.col("window") == F.col("span"), "head": head, "body": escape(F.col("text"))})
    t = t.withColumn("piece", F.concat("head", "body", F.lit(_END + "\n")))
    place = Window.partitionBy("conv", "window").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(place), F.lit(0)) + F.char_length("head"))
    loss = F.when(F.col("fresh") & (F.col("role") == "assistant"), F.struct(F.col("at").alias("start"), F.char_length("body").cast("long").alias("length")))
    made = t.groupBy("conv", "window").agg(
        F.sum(F.when(F.col("fresh"), 0).otherwise(1)).alias("n_context"),
        F.sum("tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("rank", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(loss)).alias("loss_spans"),
    )
    return made.select(F.col("conv").alias(conv_id), "window", "n_context", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def parse(formatted: Column) -> Column:
    """The turns of a formatted window as an array of (role, text), unescaped."""
    raw = F.split(formatted, r"<\|turn\|>", -1)
    return F.transform(F.slice(raw, 2, F.size(raw)), _parse_turn)


def _parse_turn(x: Column) -> Column:
    role = F.substring_index(x, "\n", 1)
    start = F.char_length(role) + 2
    body = F.substring(x, start, F.char_length(x) - start + 1 - len(_END) - 1)
    return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))


def digest(made: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row for each conversation, read back from its windows: turns, what the loss mask covers, and sizes."""
    made = made.withColumn("_turns", parse(F.col("formatted")))
    turns = F.slice("_turns", (F.col("n_context") + 1).cast("int"), F.size("_turns"))
    lost = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    w = made.select(
        F.col(conv_id),
        "window",
        F.size(turns).cast("long").alias("n"),
        F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(lost, "").alias("loss"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    c = w.groupBy(conv_id).agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    whole = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return c.select(conv_id, "n_turns", F.sha2(whole("turns"), 256).alias("turns_sha256"), F.char_length(whole("loss")).cast("long").alias("loss_chars"), F.sha2(whole("loss"), 256).alias("loss_sha256"), "formatted_chars")
