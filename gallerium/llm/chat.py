"""Chat formatting in budgeted windows, by DataFrame functions only.

A turn is `<s>role<n>text</s>`. In roles and texts a backslash is doubled and follows each less-than sign, so no control
string can occur in them and the change can be undone. A turn's tokens are its runs of letters, its digits and its runs of other
signs, and what the template adds. Prefix sums of these deal turns to windows: turns that begin in one stretch of a
conversation's stride are one window, a turn longer than that is a window of its own. The stride is half of what the budget
leaves beside the system turn and the history, so that a window keeps to the budget unless a turn can't. Each window repeats
the conversation's system turn and the turns of the window before that began within `history` tokens of its own first one. The
loss mask covers the texts of the assistant turns that a window is the first to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY = 2304, 256  # tokens of a window; tokens of history it repeats
LEAST_STRIDE = 8  # parts of the budget: the least stride, however long the system turn
PIECES, TURN_TOKENS = r"\p{L}+|\p{N}|[^ \t\n\x0B\f\r\p{L}\p{N}]+", 4
OPEN, CUT, CLOSE = "<s>", "<n>", "</s>"
TARGET, SYSTEM = "assistant", "system"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<)\\|(\\)\\", "$1$2")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_repeated (turns at the front that an earlier window held), n_new, tokens and loss (an
    array of (start, length) in code points of formatted).

    `turns` has conv_id, turn, role, text; other columns are ignored. A null role or text is empty; a null conv_id is a
    conversation of its own; rows of one turn number are ordered by role and text. An empty table has no windows. A
    conversation is ordered in one task; no row holds more of it than a window and the one before."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    base = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CUT))
    body = F.concat(head, escape(F.col("text")), F.lit(CLOSE))
    tokens = F.regexp_count("text", F.lit(PIECES)) + TURN_TOKENS
    counted = base.select("conv_id", "turn", "role", "text", tokens.alias("tokens"), F.row_number().over(own).alias("seq"))
    is_system = (F.col("seq") == 1) & (F.col("role") == SYSTEM)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    stride = F.greatest(F.floor((budget - history - F.first(F.when(is_system, F.col("tokens")).otherwise(0)).over(so_far)) / 2), F.lit(budget // LEAST_STRIDE))
    strided = counted.select("*", stride.alias("stride"), is_system.alias("is_system"), (F.sum("tokens").over(so_far) - F.col("tokens")).alias("before"), F.sum(F.length(body)).over(so_far).alias("written"))
    long = (F.col("tokens") > F.col("stride")).cast("int")
    placed = strided.select(
        "conv_id", "seq", "role", "before", "tokens", "is_system",
        F.floor(F.col("before") / F.col("stride")).alias("slot"),
        (2 * F.sum(long).over(so_far) - long).alias("part"),
        body.alias("body"),
        (F.col("written") - F.length(body)).alias("from"),
        F.length(head).alias("head"),
        F.length(escape(F.col("text"))).alias("chars"),
    )
    turn = F.struct("seq", "role", "before", "tokens", "body", "chars", "is_system", "from", "head")
    grouped = placed.groupBy("conv_id", "slot", "part").agg(F.sort_array(F.collect_list(turn)).alias("new"), F.min("before").alias("first"))
    by_slot = Window.partitionBy("conv_id").orderBy("first")
    first_turn = F.first("new").over(by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow))[0]
    linked = grouped.select("conv_id", "new", "first", (F.row_number().over(by_slot) - 1).alias("window"), F.lag("new").over(by_slot).alias("last"), first_turn.alias("start"))
    repeats_system = (F.col("window") > 0) & F.col("start.is_system")
    past = F.filter(F.coalesce("last", F.array_repeat(F.col("start"), 0)), lambda t: (F.col("first") - t["before"] <= history) & ~t["is_system"])
    front = linked.withColumn("past", F.concat(F.when(repeats_system, F.array("start")).otherwise(F.array_repeat(F.col("start"), 0)), past))
    shown = front.withColumn("front", F.array_join(F.transform("past", lambda t: t["body"]), ""))
    targets = F.filter("new", lambda t: t["role"] == TARGET)
    return shown.select(
        "conv_id", "window",
        F.concat("front", F.array_join(F.transform("new", lambda t: t["body"]), "")).alias("formatted"),
        F.size("past").alias("n_repeated"),
        F.size("new").alias("n_new"),
        F.aggregate(F.concat("past", "new"), F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"),
        F.transform(targets, lambda t: F.struct((F.length("front") + t["from"] - F.col("new")[0]["from"] + t["head"]).cast("long").alias("start"), t["chars"].cast("long").alias("length"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from windows as written."""
    parts = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    turns = F.transform(F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - F.col("n_repeated"), F.lit(0))), lambda x: F.split(F.substring(x, len(OPEN) + 1, 2147483647), CUT, 2))
    text = F.array_join(F.transform(turns, lambda x: F.concat(unescape(x[0]), F.lit("\n"), unescape(x[1]), F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    read = formatted.select("conv_id", "window", F.size(turns).alias("n"), text.alias("turns"), masked.alias("masked"), F.length("formatted").alias("size"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", c))), lambda w: w[c]), "")
    whole = read.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), joined("turns").alias("turns"), joined("masked").alias("masked"), F.sum("size").cast("long").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")
