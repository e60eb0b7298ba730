"""Chat formatting of preference pairs, in DataFrame functions alone.

A pair has a chosen and a rejected conversation.  Turns are matched by place; the
longest common prefix ends before the first place where role or text differ, or where
either conversation ends.  The prefix is rendered once, as the prompt; what follows is
each side's completion.  A mask lists the spans ``start:length`` (characters of the
completion) that are trained on: the content and end mark of assistant turns.  Headers
and other roles' turns are not.

Defined results: a null role or text is an empty string, and null equals null; turns
are ordered by number (null first), ties by role and text; sides that are equal
throughout give two empty completions and ``differs`` false; a side without turns is
an empty conversation; pairs with a null id take no part; repeated turns are turns of
their own.  Other columns take no part, whatever they are called.  A pair becomes one
row, so it is gathered in one task; turns are matched by place before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _header(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


def _numbered(turns: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns at ``(turn, nth)``: nth tells repeated numbers apart."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = turns.filter(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text")
    )
    return plain.withColumn("nth", F.row_number().over(Window.partitionBy("pair_id", "turn").orderBy("role", "text")))


def _places(turns: DataFrame) -> DataFrame:
    """Places 0, 1, ... of the turns of each pair."""
    order = Window.partitionBy("pair_id").orderBy(F.col("turn").asc_nulls_first(), "nth")
    return turns.select("pair_id", (F.row_number().over(order) - 1).alias("place"), "role", "text")


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, differs``."""
    sides = [
        _places(_numbered(t, pair, turn, role, text)).select("pair_id", "place", F.struct("role", "text").alias(name))
        for t, name in ((chosen, "c"), (rejected, "r"))
    ]
    both = sides[0].join(sides[1], ["pair_id", "place"], "full_outer")
    turns = F.sort_array(F.collect_list(F.struct("place", "c", "r")))
    pairs = both.groupBy("pair_id").agg(turns.alias("t"), F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("place"))).alias("cut"))
    head = F.coalesce("cut", F.size("t"))
    length = lambda s: F.char_length(_header(s["role"])) + F.char_length(s["text"]) + len(END) + 1
    shown = lambda s: F.concat(_header(s["role"]), s["text"], F.lit(END + "\n"))

    def completion(side: str) -> tuple[Column, Column]:
        rest = F.filter("t", lambda x: (x["place"] >= head) & x[side].isNotNull())
        rendered = F.array_join(F.transform(rest, lambda x: shown(x[side])), "")
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
        walk = lambda acc, x: F.struct(
            (acc["at"] + length(x[side])).alias("at"),
            F.when(
                x[side]["role"] == TRAINED,
                F.array_append(acc["spans"], F.concat_ws(
                    ":", (acc["at"] + F.char_length(_header(x[side]["role"]))).cast("string"),
                    (F.char_length(x[side]["text"]) + len(END)).cast("string"),
                )),
            ).otherwise(acc["spans"]).alias("spans"),
        )
        return rendered, F.array_join(F.aggregate(rest, start, walk, lambda acc: acc["spans"]), ",")

    prompt = F.array_join(F.transform(F.filter("t", lambda x: x["place"] < head), lambda x: shown(x["c"])), "")
    (chosen_text, chosen_mask), (rejected_text, rejected_mask) = completion("c"), completion("r")
    return pairs.select(
        "pair_id", head.cast("int").alias("n_prompt_turns"), prompt.alias("prompt"), chosen_text.alias("chosen"), rejected_text.alias("rejected"),
        chosen_mask.alias("chosen_mask"), rejected_mask.alias("rejected_mask"), F.col("cut").isNotNull().alias("differs"),
    )
