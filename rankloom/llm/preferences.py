"""Chat formatting (operator 10): preference pairs with a shared prompt and masked completions, as column expressions.

A pair is two conversations. Their longest common prefix of turns is rendered once, as the prompt; what follows is
rendered for either side as a completion with the character spans that count for training: the text and end mark of assistant turns.
A conversation is one training record, so its turns meet in one row; nothing wider is ever gathered.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"

_TURN = "struct<turn:bigint,role:string,text:string>"


def sibling_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) with turns as arrays: one pair for every conversation.

    Chosen is the conversation; rejected has the same turns, but its last assistant turn holds the last assistant text of the sibling
    (conv_id with its lowest bit flipped). Without a sibling or an assistant turn in it, rejected ends before that turn. Turns go by number, then
    role and text; repeated rows are repeated turns. A row without a conv_id is a conversation of one turn, with no pair_id and no sibling, so such
    rows never meet.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("c"), F.struct(F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    odd = F.col("c").bitwiseAND(F.lit(1)) == 1
    both = c.filter("c is not null").groupBy(F.shiftright("c", 1).alias("k")).agg(F.collect_list(F.when(~odd, F.col("t"))).alias("a"), F.collect_list(F.when(odd, F.col("t"))).alias("b"))
    alone = c.filter("c is null").select(F.col("c").alias("k"), F.array("t").alias("a"), F.slice(F.array("t"), 1, 0).alias("b"))
    both = both.unionByName(alone)
    both = both.select("k", F.sort_array("a").alias("a"), F.sort_array("b").alias("b"))
    sides = F.array(F.struct(F.lit(0).alias("bit"), F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.lit(1).alias("bit"), F.col("b").alias("own"), F.col("a").alias("other")))
    one = both.select("k", F.explode(sides).alias("s")).filter(F.size("s.own") > 0)
    one = one.select((F.shiftleft("k", 1) + F.col("s.bit")).alias("pair_id"), F.col("s.own").alias("chosen"), F.filter("s.other", lambda t: t["role"] == LEARNED).alias("replies"),
                     F.transform("s.own", lambda t: F.coalesce(t["role"] == LEARNED, F.lit(False))).alias("is_reply"))
    last = F.size("is_reply") - F.array_position(F.reverse("is_reply"), True) + 1  # 1-based; size + 1 when there is none
    reply = F.element_at("replies", -1)["text"]
    has = F.array_contains("is_reply", True)
    swapped = F.transform("chosen", lambda t, i: F.when(i + 1 == last, F.struct(t["turn"].alias("turn"), t["role"].alias("role"), reply.alias("text"))).otherwise(t))
    ended = F.slice("chosen", F.lit(1), (last - 1).cast("int"))
    rejected = F.when(~has, F.col("chosen")).when(F.size("replies") > 0, swapped).otherwise(ended)
    return one.select("pair_id", "chosen", rejected.cast(f"array<{_TURN}>").alias("rejected"))


def _rendered(turn: Column) -> Column:
    role = F.coalesce(turn["role"], F.lit("none"))
    return F.concat(F.lit(START), role, F.lit("\n"), F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit(END + "\n"))


def _spans(turns: Column) -> Column:
    """[start, end) of learned characters of each assistant turn in the rendered turns: text and end mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        size = F.length(_rendered(t)).cast("long")
        head = F.length(F.concat(F.lit(START), F.coalesce(t["role"], F.lit("none")), F.lit("\n")))
        own = F.struct((s["at"] + head).alias("start"), (s["at"] + size - 1).alias("end"))
        return F.struct((s["at"] + size).alias("at"), F.when(t["role"] == LEARNED, F.concat(s["spans"], F.array(own))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans) of every pair of turn arrays.

    Turns are equal when role and text are, nulls included. Two equal conversations have only a prompt; without a common turn the prompt is
    empty. A mark of the template within a text is broken by a space, so no text can open or close a turn.
    """
    same = F.zip_with(F.transform("chosen", lambda t: F.struct(t["role"], t["text"])), F.transform("rejected", lambda t: F.struct(t["role"], t["text"])), lambda a, b: a.eqNullSafe(b))
    p = pairs.withColumn("same", F.slice(same, F.lit(1), F.least(F.size("chosen"), F.size("rejected"))))
    first = F.array_position("same", False)
    p = p.withColumn("k", F.when(first > 0, first - 1).otherwise(F.size("same")).cast("int"))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("k") + 1, F.greatest(F.size(side) - F.col("k"), F.lit(0)))

    p = p.select("pair_id", "k", F.slice("chosen", F.lit(1), F.col("k")).alias("shared"), rest("chosen").alias("c"), rest("rejected").alias("r"))

    def render(turns: str) -> Column:
        return F.array_join(F.transform(turns, _rendered), "")

    return p.select(
        "pair_id", F.col("k").alias("n_prompt_turns"), render("shared").alias("prompt"), render("c").alias("chosen"), render("r").alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"))
