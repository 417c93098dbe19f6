"""Preference formatting: one prompt and two masked completions per pair.

The longest common turn prefix of the chosen and the rejected conversation is rendered
once as the prompt; what follows on either side is that side's completion. Results
are segments, a row per rendered turn: `header` names the speaker, `body` is the
text with its end marker, and `train` says whether the loss covers the body, which
is so for assistant turns of completions. Segments of a pair in the order of part and place make
the three strings; `assemble` joins them for pairs of ordinary length. Rows of a
long conversation stay spread over tasks: the prefix comes from joins on (pair, place)
and a minimum per pair.

Defined results: turns are ordered by their number, null first. Several turns of one
number in a conversation are ordered by role and text, and exact repeats after that;
a null role is shown as an empty name and a null text as an empty one. A side
without turns has no completion. A null pair id belongs to no pair and is left out. Very long
texts are whole; only their digests are compared. Empty tables have no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import small, stored

# The markers of the chat template.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
TURN = ("pair_id", "turn", "copy", "role", "text")


def numbered(turns: DataFrame) -> DataFrame:
    """(pair_id, turn, copy, role, text): `copy` tells turns of one number apart.

    Texts are only sorted if some number occurs twice in a conversation.
    """
    rows = turns.filter(F.col("pair_id").isNotNull()).select("pair_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    if rows.groupBy("pair_id", "turn").count().filter("count > 1").isEmpty():
        return rows.withColumn("copy", F.lit(1)).select(*TURN)
    place = Window.partitionBy("pair_id", "turn").orderBy("role", "text")
    return rows.withColumn("copy", F.row_number().over(place)).select(*TURN)


def first_differences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, first): where two numbered conversations differ first; digests stand for texts."""

    def marks(rows: DataFrame, side: str) -> DataFrame:
        digest = F.sha2(F.to_json(F.struct("role", "text")), 256)
        return rows.select("pair_id", "turn", "copy", digest.alias("mark")).alias(side)

    same_place = (F.col("l.pair_id") == F.col("r.pair_id")) & F.col("l.turn").eqNullSafe(F.col("r.turn")) & (F.col("l.copy") == F.col("r.copy"))
    both = marks(chosen, "l").join(marks(rejected, "r"), same_place, "full_outer")
    place = F.struct(F.coalesce("l.turn", "r.turn").alias("turn"), F.coalesce("l.copy", "r.copy").alias("copy"))
    differing = both.filter(~F.col("l.mark").eqNullSafe(F.col("r.mark"))).select(F.coalesce("l.pair_id", "r.pair_id").alias("pair_id"), place.alias("place"))
    return differing.groupBy("pair_id").agg(F.min("place").alias("first"))


def segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part, turn, copy, role, header, body, train from two frames (pair_id, turn, role, text).

    Texts meet only the place of their pair's first difference, by broadcast when pairs are few.
    """
    left, right = numbered(chosen), numbered(rejected)
    firsts = small(stored(first_differences(left, right), "first-differences"))
    place = F.struct("turn", "copy")
    part = F.when(F.col("first").isNull() | (place < F.col("first")), "prompt").otherwise("chosen")
    said = left.join(firsts, "pair_id", "left").withColumn("part", part)
    other = right.join(firsts, "pair_id").filter(place >= F.col("first")).withColumn("part", F.lit("rejected"))
    role = F.coalesce("role", F.lit(""))
    return said.unionByName(other).select(
        "pair_id", "part", "turn", "copy", "role",
        F.concat(F.lit(START), role, F.lit(MIDDLE)).alias("header"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(END)).alias("body"),
        ((F.col("part") != "prompt") & (role == TRAINED_ROLE)).alias("train"),
    )


def assemble(rows: DataFrame) -> DataFrame:
    """pair_id with prompt, chosen, rejected and the masked bodies; for pairs whose texts fit into a row.

    `*_trained` are (start, end) character positions of the trained bodies in the completion.
    """
    ordered = F.array_sort(F.collect_list(F.struct("part", "turn", "copy", "header", "body", "train")))
    pairs = rows.groupBy("pair_id").agg(ordered.alias("all"))

    def of(part: str) -> Column:
        return F.filter("all", lambda s: s["part"] == part)

    def joined(part: str) -> Column:
        return F.array_join(F.transform(of(part), lambda s: F.concat(s["header"], s["body"])), "")

    def trained(part: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("found"))

        def step(acc: Column, s: Column) -> Column:
            begin = acc["at"] + F.length(s["header"])
            end = begin + F.length(s["body"])
            span = F.struct(begin.alias("start"), end.alias("stop"))
            return F.struct(end.alias("at"), F.when(s["train"], F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

        return F.aggregate(of(part), start, step, lambda acc: acc["found"])

    return pairs.select(
        "pair_id", joined("prompt").alias("prompt"), joined("chosen").alias("chosen"), joined("rejected").alias("rejected"),
        trained("chosen").alias("chosen_trained"), trained("rejected").alias("rejected_trained"),
    )


def swapped_endings(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation as chosen, and as rejected with the last turns of its neighbour instead of its own.

    Neighbours are conversations 2k and 2k + 1. The last turns are all those of the
    largest number; a conversation whose neighbour is missing just lacks them.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    lasts = small(stored(turns.groupBy("pair_id").agg(F.max("turn").alias("last")), "last-turns"))
    turns = turns.filter(F.col("pair_id").isNotNull()).join(lasts, "pair_id")
    ending = F.col("turn").eqNullSafe(F.col("last"))
    neighbour = F.col("pair_id") + F.when(F.pmod("pair_id", F.lit(2)) == 0, 1).otherwise(-1)
    moved = turns.filter(ending).select(neighbour.alias("pair_id"), "role", "text").join(lasts, "pair_id")
    body = turns.filter(~ending).select("pair_id", "turn", "role", "text")
    rejected = body.unionByName(moved.select("pair_id", F.col("last").alias("turn"), "role", "text"))
    return turns.select("pair_id", "turn", "role", "text"), rejected
