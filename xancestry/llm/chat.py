"""Preference formatting of conversations, with DataFrame functions only.

A chosen and a rejected conversation share a prompt: the longest common prefix of their turns, rendered once.
What follows it in each is a completion, with a mask of the characters that count for the loss: those of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact

#: Fixed values of the rendering: what stands before a role, between role and text, and after a text.
BEGIN, BETWEEN, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: The role whose turns count for the loss.
LEARNED = "assistant"


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns) with turns an array of (turn, role, text) in order; ties by role and text, nulls first.

    A null role or text counts as empty. Turns of a null id make up one conversation. An array holds one conversation,
    which is also what a row of any rendering has to hold.
    """
    turn = F.struct(exact(turn_col).cast("long").alias("turn"), F.coalesce(exact(role_col), F.lit("")).alias("role"), F.coalesce(exact(text_col), F.lit("")).alias("text"))
    return conversations.select(exact(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rendered(part: Column) -> Column:
    each = F.transform(part, lambda t: F.concat(F.lit(BEGIN), t["role"], F.lit(BETWEEN), t["text"], F.lit(END)))
    return F.array_join(each, "")


def spans(part: Column) -> Column:
    """[start, end) of the characters of a rendering that count for the loss: text and end mark of learned turns."""
    empty = F.array().cast("array<struct<start:long,end:long>>")
    around = len(BEGIN) + len(BETWEEN)

    def step(state, t):
        start = state["at"] + around + F.length(t["role"])
        end = start + F.length(t["text"]) + len(END)
        found = F.when(t["role"] == LEARNED, F.concat(state["found"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(part, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found")), step, lambda s: s["found"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(id, chosen, rejected) with arrays of turns as from turns() -> paired masked completions.

    Returns id, n_prompt (turns in common), prompt, chosen, rejected (renderings), chosen_spans and rejected_spans
    (arrays of start and end within the completion). Turns are the same if role and text are. A null array counts as an
    empty conversation; equal conversations have empty completions; without a common turn the prompt is empty. Every row
    gives one row, in whatever multiplicity, and other columns are left out. A whole conversation is compared turn
    by turn, without a shuffle.
    """
    none = F.array().cast("array<struct<turn:long,role:string,text:string>>")
    d = pairs.select("id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    first_other = F.array_position(same, False)
    n = F.when(first_other > 0, first_other - 1).otherwise(F.size(same))
    d = d.withColumn("n", n.cast("int"))
    after = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    d = d.select("id", F.col("n").cast("long").alias("n_prompt"), F.slice("chosen", F.lit(1), F.col("n")).alias("common"), after("chosen").alias("c"), after("rejected").alias("r"))
    return d.select("id", "n_prompt", rendered(F.col("common")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), spans(F.col("c")).alias("chosen_spans"), spans(F.col("r")).alias("rejected_spans"))


def counterfactuals(conversations: DataFrame) -> DataFrame:
    """Pairs for format_preferences() from conversations (conv_id, turn, role, text) without a preference of their own.

    Each conversation is chosen; rejected are its turns with the last one answered as its neighbour's last turn is, the
    neighbour being the conversation whose conv_id differs in the last bit. Without a neighbour the last turn is
    missing. Keys are conversations, so no key holds more than two of them.
    """
    each = turns(conversations).select("id", "turns", F.shiftright(F.col("id").cast("long"), 1).alias("pair"))
    mine = F.struct("id", "turns")
    own = each.groupBy("pair").agg(F.collect_list(mine).alias("m")).select(F.explode("m").alias("own"), "m")
    other = F.filter("m", lambda x: ~x["id"].eqNullSafe(F.col("own")["id"]))
    mine_turns = F.col("own")["turns"]
    last = F.element_at(mine_turns, -1)
    answer = F.element_at(F.get(other, F.lit(0))["turns"], -1)
    swapped = F.array(F.struct(last["turn"].alias("turn"), last["role"].alias("role"), answer["text"].alias("text")))
    kept = F.slice(mine_turns, F.lit(1), F.size(mine_turns) - 1)
    return own.select(F.col("own")["id"].alias("id"), mine_turns.alias("chosen"), F.when(F.size(other) > 0, F.concat(kept, swapped)).otherwise(kept).alias("rejected"))
