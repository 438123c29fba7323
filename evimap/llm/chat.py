"""Chat formatting into budgeted windows, with DataFrame functions only.

Each turn is written <|im_start|>role\\ntext<|im_end|>\\n. Its cost is an estimate of its tokens: the pieces of its text
(runs of letters and digits, other marks one by one) plus the four of its frame; callers may give their own estimate.
Windows are runs of whole turns: prefix sums of the costs say what any run costs, and a fold over a conversation's
costs opens the next window where a turn would pass the budget. Every window starts with the conversation's system
turn, if its first turn is one, and repeats the turns before its own ones that fit into the history budget. The loss
mask has the text of each assistant turn in the one window where it is no repetition. Nothing is cut off:

- where system turn, history and a first own turn are over the budget, the window goes without history; a turn that
  is over the budget even so has a window of its own, with the system turn, over the budget;
- of a system turn no more than half of the budget counts, so that other turns keep the other half: it stands in every
  window all the same, and windows are over the budget by what it has over half of it.

Texts stay out of the planning: positions, prefix sums and where a history begins come from window functions over rows
without texts, the fold sees three numbers a turn. Each text then meets its windows by a join on its row's digest and
is copied only where it is repeated. The fold holds four numbers for each turn of one conversation (32 MB for a million
turns) and its work is linear in them.

In texts, a [ or < that begins a control string (<|, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>) gets a backslash
after it, and where backslashes follow it already, one more; taking one away restores the text. Roles are URL-encoded.
So the marks of the template are nowhere but where the template put them, and read_back() parses by them.

Defined results: a null text or role is empty; null conversation ids are one conversation; turns with equal
numbers follow by role, then by the first 64 characters of the text, then by digest; null turns come first; repeated
rows stay; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evimap.llm.common import let

BUDGET, HISTORY = 2048, 256
#: Control strings after their first character, for a lookahead: fixed values of the template and of common ones.
_CONTROL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
_START, _END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2")


def pieces(text: Column) -> Column:
    """An estimate of a text's tokens."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(_START), role, F.lit("\n"), text, F.lit(_END))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def _placed(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Rows without texts: position in the conversation, prefix sum of costs, where a history before it would begin, what that costs."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "head", "key")
    before = F.coalesce(F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.first(F.when(F.col("role") == "system", F.col("cost")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("conv_id", "key", "cost", (F.row_number().over(order) - 1).cast("long").alias("pos"), before.alias("before"), lead.alias("lead"))
    rows = rows.withColumn("system", F.least("lead", F.lit(budget // 2).cast("long")))
    near = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)
    own = F.when((F.col("lead") == 0) | (F.col("pos") > 0), F.struct("pos", "before"))  # the system turn is no history
    rows = rows.withColumn("past", F.coalesce(F.min(own).over(near), F.struct("pos", "before")))
    cost = F.when((F.col("pos") == 0) & (F.col("lead") > 0), F.col("system")).otherwise(F.col("cost")).alias("cost")
    return rows.select("conv_id", "key", cost, "pos", "system", F.col("past.pos").alias("past"), (F.col("before") - F.col("past.before")).alias("past_cost"))


def _planned(placed: DataFrame, budget: int) -> DataFrame:
    """One row per turn of each window: conv_id, window, pos, repeated."""
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "cost", "past", "past_cost"))).alias("ts"), F.max("system").alias("system"))
    # a window: its first own turn, and from where on turns are repeated before it
    lead = "if(t.pos = 0, 0L, system)"
    past = f"if({lead} + t.past_cost + t.cost <= {budget}, t.past_cost, 0L)"
    opened = f"""named_struct(
        'at', array_append(a.at, named_struct('own', t.pos, 'past', if({lead} + t.past_cost + t.cost <= {budget}, t.past, t.pos))),
        'used', {lead} + {past} + t.cost)"""
    fold = f"""aggregate(ts, named_struct('at', cast(array() as array<struct<own:bigint,past:bigint>>), 'used', cast(null as bigint)),
        (a, t) -> if(a.used + t.cost <= {budget}, named_struct('at', a.at, 'used', a.used + t.cost), {opened})).at"""
    end = lambda at, i: F.when(i + 1 < F.size(at), at[i + 1]["own"]).otherwise(F.element_at("ts", -1)["pos"] + 1)
    ends = let(F.expr(fold), lambda at: F.transform(at, lambda w, i: F.struct(w["own"].alias("own"), w["past"].alias("past"), end(at, i).alias("end"))))
    windows = whole.select("conv_id", "system", F.explode(ends).alias("w")).select("conv_id", "system", "w.*")
    turns = F.expr("concat(if(system > 0 and own > 0, array(0L), cast(array() as array<bigint>)), sequence(past, end - 1))")
    return windows.select("conv_id", F.col("own").alias("window"), F.explode(turns).alias("pos")).withColumn("repeated", F.col("pos") < F.col("window"))


def format_chats(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", cost: Callable[[Column], Column] = pieces
) -> DataFrame:
    """One row per window: conv_id, window (the position of its first own turn), formatted, turns.

    turns: for each turn in formatted, its place and length (code points) of role and text, whether it is repeated
    and whether its text is under the loss mask."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (conv_col, turn_col)]
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.url_encode(role).alias("role"), text.alias("text"), F.unhex(F.md5(F.concat_ws("\x01", *parts, F.url_encode(role), text))).alias("key"))
    placed = _placed(rows.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), "key", (cost(F.col("text")) + 4).cast("long").alias("cost")), budget, history)
    keys = placed.select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"), "key")
    planned = _planned(placed, budget).join(keys, _same("conv_id", "_conv") & (F.col("pos") == F.col("_pos"))).select("conv_id", "window", "pos", "repeated", "key")
    texts = rows.groupBy("key").agg(F.first("role").alias("role"), escaped(F.first("text")).alias("text"))
    turns = planned.join(texts, "key").groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("pos", "repeated", "role", "text"))).alias("_all"))
    spans = F.expr(
        f"""aggregate(_all, named_struct('pos', 0, 'out', cast(array() as array<struct<role_at:int,role_chars:int,text_at:int,text_chars:int,repeated:boolean,loss:boolean>>)),
              (a, t) -> named_struct('pos', a.pos + {len(_START)} + length(t.role) + 1 + length(t.text) + {len(_END)}, 'out', array_append(a.out, named_struct(
                'role_at', a.pos + {len(_START)}, 'role_chars', length(t.role), 'text_at', a.pos + {len(_START)} + length(t.role) + 1, 'text_chars', length(t.text),
                'repeated', t.repeated, 'loss', t.role = 'assistant' and not t.repeated)))).out"""
    )
    formatted = F.array_join(F.transform("_all", lambda t: _turn(t["role"], t["text"])), "")
    return turns.select("conv_id", "window", formatted.alias("formatted"), spans.alias("turns"))


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from formatted texts and masks alone: conv_id, n_turns, turns (role, text), loss (texts), formatted_chars.

    Turns are found by the template's marks; which of them are repetitions, and which texts are under the mask, is what
    the list of turns says."""
    marked = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda t: t != "")
    body = lambda t: t.substr(F.lit(len(_START) + 1), F.length(t))
    parsed = F.transform(F.transform(marked, body), lambda t: F.struct(F.url_decode(F.substring_index(t, "\n", 1)).alias("role"), unescaped(t.substr(F.length(F.substring_index(t, "\n", 1)) + 2, F.length(t))).alias("text")))
    own = F.filter(F.arrays_zip(parsed.alias("turn"), F.col("turns").alias("at")), lambda x: ~x["at"]["repeated"])
    masked = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: unescaped(F.substring(F.col("formatted"), t["text_at"] + 1, t["text_chars"])))
    read = windows.select("conv_id", F.struct("window", F.transform(own, lambda x: x["turn"]).alias("turns"), masked.alias("loss")).alias("w"), F.length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"))
    flat = whole.select("conv_id", F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"), F.flatten(F.transform("ws", lambda w: w["loss"])).alias("loss"), "formatted_chars")
    return flat.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns", "loss", "formatted_chars")


def digests(windows: DataFrame) -> DataFrame:
    """What read_back gives, as counts and digests."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("loss"), "")
    return read_back(windows).select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
