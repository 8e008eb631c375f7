"""Chat formatting in budgeted windows, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediaspark.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"
#: Rows of one cell of a conversation, within which one task numbers the turns.
CELL_TURNS = 1 << 12


def escape(text: Column) -> Column:
    """Text without any ``<|``: one more backslash wherever ``<``, backslashes and ``|`` follow each other."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line: a backslash becomes backslash b, a newline backslash n; control strings are escaped."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def _cell() -> Column:
    """Cells follow the turn numbers; rows without one have the first cell."""
    return F.coalesce(F.floor(F.col("turn") / CELL_TURNS), F.lit(-(1 << 60)))


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place in the conversation and the tokens before them, cell by cell."""
    order = ["turn", "role", "body"]
    rows = turns.withColumn("cell", _cell())
    inside = Window.partitionBy("conv", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"place": F.count("*").over(inside), "start": F.coalesce(F.sum("tokens").over(inside), F.lit(0))})
    cells = turns.withColumn("cell", _cell()).groupBy("conv", "cell").agg(F.count("*").alias("of"), F.sum("tokens").alias("all"))
    before = Window.partitionBy("conv").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("conv", "cell", F.coalesce(F.sum("of").over(before), F.lit(0)).alias("o"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("a"))
    rows = rows.join(cells, ["conv", "cell"])
    return rows.withColumns({"place": F.col("place") + F.col("o"), "start": F.col("start") + F.col("a")}).drop("o", "a", "cell")


def format_windows(turns: DataFrame, *, budget: int = 1024, history: int = 2) -> DataFrame:
    """Training windows of conversations: ``(conv_id, window, text, loss, fresh, turns, chars)``.

    A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``; control strings inside texts and roles are escaped
    and can be read back.  Tokens are estimated as a third of the escaped text's bytes, and eight a turn.

    Spans come from prefix sums: the conversation's tokens are cut into cells of half the ``budget``; the turns
    that lie inside a cell are a span, and a turn that crosses a border is a span of its own.  So a span is turn
    aligned and fits half the budget, or it is one turn.  Each span is a window's fresh part.  In front of it
    stand the system turn, if the conversation opens with one, and as many of the last ``history`` turns as the
    rest of the budget holds, the latest first.  ``loss`` lists (start, length) in characters of ``text`` of the
    fresh assistant turns; repeated turns and other roles are masked, so each assistant text is learned once.
    ``turns`` counts the turns in the window and ``fresh`` says at which of them the fresh part begins.  A turn
    longer than the budget is a window that exceeds it; nothing is cut or dropped.

    Turns are ordered by turn number, role and text; null turn numbers come first, null roles and texts count as
    empty.  Rows of a null conv_id are one conversation.  Repeated rows are turns of their own.  A conversation is
    numbered in cells of CELL_TURNS turn numbers, and windows are built one by one, so a long conversation is
    spread over tasks.  An empty table gives an empty result; other columns are ignored.
    """
    rows = turns.select(
        F.struct("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"),
    )
    rows = rows.withColumn("tokens", F.ceil(F.octet_length("body") / 3).cast("bigint") + 8)
    rows = written(_numbered(rows), "turns")
    half = budget // 2
    cell, last = F.floor(F.col("start") / half), F.floor((F.col("start") + F.col("tokens") - 1) / half)
    rows = rows.withColumn("span", 2 * last + F.when(cell == last, 1).otherwise(0))

    spans = rows.groupBy("conv", "span").agg(F.min("place").alias("first"), F.min("start").alias("from"), F.sum("tokens").alias("size"))
    system = rows.where((F.col("place") == 0) & (F.col("role") == "system")).select("conv", F.col("tokens").alias("system"))
    spans = spans.join(system, "conv", "left")
    spans = written(spans.withColumn("window", F.col("span")), "spans")
    # The turns ahead of a span, by their places; those that fit the rest of the budget are repeated.
    ahead = F.sequence(F.greatest(F.col("first") - history, F.when(F.col("system").isNull(), 0).otherwise(1)), F.col("first") - 1)
    asked = spans.where(F.col("first") > F.when(F.col("system").isNull(), 0).otherwise(1)).withColumn("place", F.explode(ahead))
    room = F.lit(budget) - F.col("size") - F.coalesce("system", F.lit(0))
    repeats = rows.select("conv", "place", "role", "body", "start").join(asked.select("conv", "place", "window", "from", room.alias("room")), ["conv", "place"])
    repeats = repeats.where(F.col("from") - F.col("start") <= F.col("room")).select("conv", "window", "place", "role", "body", F.lit(False).alias("new"))
    lead = rows.where((F.col("place") == 0) & (F.col("role") == "system")).select("conv", "place", "role", "body")
    lead = spans.where((F.col("first") > 0) & F.col("system").isNotNull()).select("conv", "window").join(lead, "conv")
    parts = rows.select("conv", F.col("span").alias("window"), "place", "role", "body", F.lit(True).alias("new"))
    parts = parts.unionByName(repeats).unionByName(lead.withColumn("new", F.lit(False)))

    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    whole = F.concat(head, "body", F.lit(END + "\n"))
    piece = F.struct("place", whole.alias("whole"), F.char_length(head).alias("head"), F.char_length("body").alias("size"), F.char_length(whole).alias("all"), (F.col("new") & (F.col("role") == "assistant")).alias("learn"), "new")
    built = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    loss = """aggregate(p, named_struct('at', 0, 'loss', cast(array() as array<struct<start:int,length:int>>)),
        (s, x) -> named_struct('at', s.at + x.all, 'loss', if(x.learn, concat(s.loss, array(named_struct('start', s.at + x.head, 'length', x.size))), s.loss)), s -> s.loss)"""
    return built.select(
        F.col("conv.conv_id").alias("conv_id"), "window", F.expr("array_join(transform(p, x -> x.whole), '')").alias("text"), F.expr(loss).alias("loss"),
        F.expr("size(filter(p, x -> not x.new))").alias("fresh"), F.expr("size(p)").alias("turns"), F.expr("bigint(aggregate(p, 0L, (s, x) -> s + x.all))").alias("chars"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """What formatted windows say, per conversation: ``(conv_id, n_turns, turns, loss, chars)``.

    ``turns`` is role, newline, text and newline of all fresh turns in order, ``loss`` all text under the loss
    masks; both read from the formatted text.  The strings of a conversation meet in one row, as its digest needs.
    """
    body = f"substring(x, 1, char_length(x) - {len(END) + 1})"
    parsed = F.expr(rf"transform(slice(split(text, '<[|]im_start[|]>'), fresh + 2, turns), x -> {body})")
    turn = F.transform(parsed, lambda x: F.concat(unescape_role(F.substring_index(x, "\n", 1)), F.lit("\n"), unescape(F.substr(x, F.char_length(F.substring_index(x, "\n", 1)) + 2)), F.lit("\n")))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    rows = windows.select(F.struct("conv_id").alias("conv"), "window", (F.col("turns") - F.col("fresh")).alias("n"), F.array_join(turn, "").alias("t"), F.array_join(learned, "").alias("l"), "chars")
    whole = rows.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "t", "l"))).alias("w"), F.sum("chars").alias("chars"))
    return whole.select("conv.conv_id", F.col("n_turns").cast("bigint"), F.expr("array_join(transform(w, x -> x.t), '')").alias("turns"), F.expr("array_join(transform(w, x -> x.l), '')").alias("loss"), "chars")
