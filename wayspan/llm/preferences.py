"""Chat formatting of preference pairs.

The longest common prefix of turns (same role and text) of the chosen and the rejected conversation is rendered once
as prompt; what is left of each is a completion, with a mask of the spans that count for the loss: the text and the
end mark of assistant turns.

Turns are ordered by their number; turns that tie are ordered by role, then text. A null role or text counts as
empty. A side without turns has an empty completion; a pair of equal conversations has two empty completions and is
marked ``identical``. Sides without a partner are paired with an empty conversation, so no conversation is lost.
Texts are rendered whole, whatever their length; repeated turns count each; other columns are carried through, unless
they bear the name of a result, which then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation with its ordered turns; a conversation is one training sample and fits one row."""
    t = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(t)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return turns.groupBy(key).agg(ordered.alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns in the longest common prefix."""
    miss = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(miss > 0, miss - 1).otherwise(F.size(a)).cast("int")


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def mask(turns: Column) -> Column:
    """Spans (start, length) in code points of the rendered turns that count for the loss."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = F.length(t["role"]) + len(OPEN) + len(CLOSE)
        body = F.length(t["text"]) + len(END)
        span = F.array(F.struct((acc["at"] + head).alias("start"), body.alias("length")))
        return F.struct((acc["at"] + head + body).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")


def format_preferences(pairs: DataFrame, chosen: str = "chosen_turns", rejected: str = "rejected_turns") -> DataFrame:
    """``pairs`` with prompt, completions and masks in place of the two turn arrays."""
    none = F.array().cast(TURNS)
    keep = [c for c in pairs.columns if c not in (chosen, rejected, "prompt", "n_prompt_turns", "identical", "chosen", "rejected", "chosen_mask", "rejected_mask")]
    d = pairs.select(*keep, F.coalesce(chosen, none).alias("__c"), F.coalesce(rejected, none).alias("__r"))
    d = d.select("*", common_turns(F.col("__c"), F.col("__r")).alias("__n"))
    rest = lambda c: F.slice(c, F.col("__n") + 1, F.greatest(F.size(c) - F.col("__n"), F.lit(0)))
    d = d.select(*keep, "__n", F.slice("__c", F.lit(1), F.col("__n")).alias("__p"), rest(F.col("__c")).alias("__c"), rest(F.col("__r")).alias("__r"))
    return d.select(
        *keep,
        F.col("__n").alias("n_prompt_turns"),
        render(F.col("__p")).alias("prompt"),
        render(F.col("__c")).alias("chosen"),
        render(F.col("__r")).alias("rejected"),
        mask(F.col("__c")).alias("chosen_mask"),
        mask(F.col("__r")).alias("rejected_mask"),
        ((F.size("__c") == 0) & (F.size("__r") == 0)).alias("identical"),
    )


def derived_pairs(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """A pair per conversation of a table without preferences: (key, chosen_turns, rejected_turns).

    Chosen is the whole conversation. Rejected has the second half of its assistant turns (of an odd number the middle
    one too) replaced by those of the same number of the partner, the conversation whose id differs in the lowest bit;
    one that the partner lacks is left out. All other turns stay in both, so the two part anywhere from the first
    assistant turn on and may meet again. Conversations without assistant turns are equal to their rejected side. Turns
    with a null id are one conversation without a partner.

    Both conversations of a pair meet in one group of one shuffle, as they are one training sample.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d = turns.select(F.col(key).bitwiseAND(F.lit(-2)).alias("__pair"), F.coalesce(F.col(key).bitwiseAND(F.lit(1)), F.lit(0)).alias("__side"), F.col(key).alias("__id"), "turn", role.alias("role"), text.alias("text"))
    order = W.partitionBy("__pair", "__side").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = (F.col("role") == "assistant").cast("int")
    # Dealt by pair first, so that neither the numbering nor the grouping deals anew.
    d = d.repartition("__pair").withColumns({"n": F.row_number().over(order), "of": F.sum(own).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")})
    turn = F.struct("n", "of", "role", "text")
    sides = [F.col("__side") == i for i in (0, 1)]
    g = d.groupBy("__pair").agg(*[F.sort_array(F.collect_list(F.when(s, turn))).alias(f"t{i}") for i, s in enumerate(sides)], *[F.first(F.when(s, F.col("__id")), ignorenulls=True).alias(f"id{i}") for i, s in enumerate(sides)])
    g = g.withColumns({f"a{i}": F.filter(f"t{i}", lambda t: t["role"] == "assistant") for i in (0, 1)})
    pick = lambda i: F.struct(F.col(f"id{i}").alias("id"), F.col(f"t{i}").alias("own"), F.size(f"a{i}").alias("k"), F.col(f"a{1 - i}").alias("other"))
    x = F.explode(F.filter(F.array(pick(0), pick(1)), lambda s: F.size(s["own"]) > 0))
    d = g.select(x.alias("x")).select(F.col("x.id").alias(key), "x.own", "x.k", "x.other")
    pair = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    swapped = lambda t: (t["role"] == "assistant") & (t["of"] > F.floor(F.col("k") / 2))
    kept = F.filter("own", lambda t: ~swapped(t) | (t["of"] <= F.size("other")))
    return d.select(key, F.transform("own", pair).alias("chosen_turns"), F.transform(kept, lambda t: F.when(swapped(t), pair(F.get("other", t["of"] - 1))).otherwise(pair(t))).alias("rejected_turns"))
