"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn costs OVERHEAD tokens and one for each piece of at most 5 code points of a word. A turn starts at the sum of
the tokens of the turns before it. A conversation has room for `fresh` new tokens a window: BUDGET less HISTORY less
its system turn, but at least a quarter of BUDGET. The multiples of `fresh` cut it into spans: the turns that lie between
two multiples are a span, and a turn that lies on a multiple is one by itself. A span thus holds at most `fresh` tokens,
or one turn. A window is the system turn (the first turn, if that is its role), the turns that begin in the last HISTORY
tokens before the span, and the span. What is repeated is masked: the loss lies on the assistant texts of the span only,
so each lies under it in one window.

The template is `<|im_start|>role`, a new line, the text, `<|im_end|>`, a new line. In texts, every `<` that only
backslashes part from a `|` gets one backslash more, so no text holds a control string, and reading takes one away. In
roles `%`, `<` and new lines are written as %25, %3C and %0A.

No task holds a whole conversation: prefix sums are made in blocks of BLOCK turns and over the blocks, windows within
cells of CELL multiples, and the turns that a cell repeats from the one before are dealt to both. `chat_facts` is another
matter: a digest of a conversation needs its text in one value.

Defined cases: a null text or role is empty; a null turn comes first, a null conversation is one of its own; turns of one
number are ordered by role and text, and equal rows are all kept; a turn that exceeds the budget is a span of its own, and
`over_budget` says so; other columns of the table aren't read; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framelens.llm.common import keyed, unkeyed, written

BUDGET, HISTORY, OVERHEAD = 1024, 256, 4
BLOCK, CELL = 1024, 64
START, END = "<|im_start|>", "<|im_end|>\n"
PIECE = r"[^\x20\x09-\x0D]{1,5}"
SYSTEM, TARGET = "system", "assistant"


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PIECE)) + OVERHEAD


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


_ROLE = {"%": "%25", "<": "%3C", "\n": "%0A"}


def _role_written(role: Column) -> Column:
    for a, b in _ROLE.items():
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_read(role: Column) -> Column:
    for a, b in reversed(_ROLE.items()):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def _blocks(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """For each block of a conversation: the tokens before it, those of the whole, `fresh`, and the system turn in the first one."""
    system = F.col("_role") == SYSTEM
    first = F.struct("_turn", "_role", F.when(system, F.col("_text")).alias("_text"), "_tok")
    sums = rows.groupBy("_conv", "_block").agg(F.sum("_tok").alias("_own"), F.min(first).alias("_first"))
    w = Window.partitionBy("_conv")
    head = F.struct(F.col("_first._role").alias("role"), F.col("_first._tok").alias("tok"))
    sums = sums.withColumns({
        "_before": F.coalesce(F.sum("_own").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_total": F.sum("_own").over(w), "_head": F.min_by(head, "_block").over(w),
    })
    own = F.when(F.col("_head.role") == SYSTEM, F.col("_head.tok")).otherwise(0)
    led = (F.col("_before") == 0) & (F.col("_head.role") == SYSTEM)
    return sums.select(
        "_conv", "_block", "_before", "_total", F.greatest(F.lit(budget - history) - own, F.lit(budget // 4)).cast("long").alias("_fresh"),
        own.alias("_own"), F.when(led, F.col("_first._text")).alias("_system"), led.alias("_led"),
    )


def _piece(role: str, text: str) -> Column:
    """What stands in a window for a turn, its length, and where its text lies in it."""
    head, body = F.concat(F.lit(START), _role_written(F.col(role)), F.lit("\n")), escaped(F.col(text))
    piece = F.concat(head, body, F.lit(END))
    return F.struct(piece.alias("piece"), F.char_length(piece).alias("size"), F.char_length(head).alias("at"), F.char_length(body).alias("length"))


def format_windows(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY
) -> DataFrame:
    """conv, window (ascending, with gaps), n_turns (new ones), n_context (the turns that lead it and are masked), n_tokens, over_budget,
    formatted, and loss (start and length in code points of each masked-in text)."""
    if not 0 < history < budget:
        raise ValueError("the history must be smaller than the budget")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(keyed(conv_col).alias("_conv"), keyed(turn_col).alias("_turn"), text(role_col).alias("_role"), text(text_col).alias("_text"))
    rows = rows.select("*", tokens(F.col("_text")).cast("long").alias("_tok"), F.expr(f"_turn div {BLOCK}").alias("_block"))
    blocks = written(_blocks(rows, budget, history), "chat-blocks")

    order = Window.partitionBy("_conv", "_block").orderBy("_turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.join(blocks.select("_conv", "_block", "_before", "_fresh"), ["_conv", "_block"]).withColumn("_start", F.col("_before") + F.sum("_tok").over(order) - F.col("_tok"))
    at = at.withColumn("_mark", F.expr("_start div _fresh")).withColumn("_on", F.expr("(_start + _tok - 1) div _fresh > _mark"))
    at = at.select(
        "_conv", "_start", "_tok", (2 * F.col("_mark") + F.col("_on").cast("long")).alias("_span"), F.expr(f"_mark div {CELL}").alias("_cell"), "_fresh",
        ((F.col("_start") == 0) & (F.col("_role") == SYSTEM)).alias("_is_system"), (F.col("_role") == TARGET).alias("_target"), _piece("_role", "_text").alias("_p"),
    )

    # the turns at the end of a cell are dealt to the next one too, which may repeat them
    ends = F.col("_start") >= (F.col("_cell") + 1) * CELL * F.col("_fresh") - history
    dealt = at.withColumn("_to", F.explode(F.when(ends, F.array(F.col("_cell"), F.col("_cell") + 1)).otherwise(F.array("_cell"))))
    near = F.collect_set("_span").over(Window.partitionBy("_conv", "_to").orderBy("_start").rangeBetween(1, history))
    dealt = dealt.withColumn("_near", near)
    again = F.filter("_near", lambda s: (s != F.col("_span")) & (F.expr(f"_to * {2 * CELL}") <= s) & (s < F.expr(f"(_to + 1) * {2 * CELL}")))
    new = F.when(F.col("_to") == F.col("_cell"), F.array(F.struct(F.col("_span").alias("span"), F.lit(False).alias("repeated")))).otherwise(F.array().cast("array<struct<span:bigint,repeated:boolean>>"))
    old = F.when(F.col("_is_system"), F.array().cast("array<struct<span:bigint,repeated:boolean>>")).otherwise(F.transform(again, lambda s: F.struct(s.alias("span"), F.lit(True).alias("repeated"))))
    placed = dealt.select("*", F.explode(F.concat(new, old)).alias("_w"))
    turn = F.struct("_start", F.col("_w.repeated").alias("repeated"), "_tok", (F.col("_target") & ~F.col("_w.repeated")).alias("target"), "_p")
    spans = placed.groupBy("_conv", "_to", F.col("_w.span").alias("_window")).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))

    systems = blocks.where("_led").select("_conv", F.explode(F.expr(f"sequence(0L, _total div ({CELL} * _fresh))")).alias("_to"), F.lit(SYSTEM).alias("_role"), "_system", "_own")
    lead = F.struct(F.lit(-1).cast("long").alias("_start"), F.lit(True).alias("repeated"), F.col("_own").cast("long").alias("_tok"), F.lit(False).alias("target"), _piece("_role", "_system").alias("_p"))
    spans = spans.join(systems.select("_conv", "_to", lead.alias("_lead")), ["_conv", "_to"], "left")
    led = F.col("_lead").isNotNull() & (F.col("_turns")[0]["_start"] > 0)
    spans = spans.withColumn("_turns", F.when(led, F.concat(F.array("_lead"), F.col("_turns"))).otherwise(F.col("_turns")))
    before = lambda i: F.aggregate(F.slice("_turns", 1, i), F.lit(0), lambda s, y: s + y["_p"]["size"])
    places = F.transform("_turns", lambda x, i: F.struct(x["target"].alias("target"), (before(i) + x["_p"]["at"]).alias("start"), x["_p"]["length"].alias("length")))
    n = F.aggregate("_turns", F.lit(0).cast("long"), lambda s, x: s + x["_tok"])
    return spans.select(
        unkeyed("_conv").alias(conv_col), F.col("_window").alias("window"), F.size(F.filter("_turns", lambda x: ~x["repeated"])).alias("n_turns"),
        F.size(F.filter("_turns", lambda x: x["repeated"])).alias("n_context"), n.alias("n_tokens"), (n > budget).alias("over_budget"),
        F.array_join(F.transform("_turns", lambda x: x["_p"]["piece"]), "").alias("formatted"),
        F.transform(F.filter(places, lambda x: x["target"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
    )


def read_windows(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv, window, turns (role and text of the new ones), lost (the texts under the loss) and formatted, from the formatted text alone, the number
    of turns that lead it and the places of the loss."""
    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    said = F.slice(pieces, F.col("n_context") + 2, F.size(pieces))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 1 - len(END))
        return F.struct(_role_read(role).alias("role"), unescaped(body).alias("text"))

    lost = F.transform("loss", lambda x: unescaped(F.substr(F.col("formatted"), x["start"] + 1, x["length"])))
    return windows.select(conv_col, "window", F.transform(said, turn).alias("turns"), lost.alias("lost"), "formatted")


def chat_facts(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """For each conversation, read back from its windows: turns and their digest, code points and digest of what is under the loss, and
    the code points of all windows."""
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = read_windows(windows, conv_col).select(
        conv_col, F.struct("window", turns.alias("said"), F.array_join("lost", "").alias("lost")).alias("_w"), F.size("turns").alias("_n"), F.char_length("formatted").cast("long").alias("_c")
    )
    g = read.groupBy(conv_col).agg(F.sum("_n").alias("n_turns"), F.sum("_c").alias("formatted_chars"), F.array_sort(F.collect_list("_w")).alias("_ws"))
    joined = lambda f: F.array_join(F.transform("_ws", lambda x: x[f]), "")
    return g.select(
        conv_col, "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.char_length(joined("lost")).cast("long").alias("loss_chars"),
        F.sha2(joined("lost"), 256).alias("loss_sha256"), "formatted_chars",
    )
