"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

Every participant of a dialogue gets a rendering in which that speaker is the assistant and everyone else a named user;
the mask covers the assistant's words and the marker that ends them. Context roles (system) are rendered in every
perspective and take none of their own.

A rendering comes in parts of ``PART_TURNS`` turns, by rank: a dialogue of up to so many turns is one row for each participant, a longer one
has rows 0, 1, 2, ... for each of all its participants, whether they speak in a part or not, so that the parts joined in order are the whole
rendering. Column context repeats the last context turn before a part, rendered, so that a part can be used alone; it is empty in part 0.

Rows equal in every column used are one turn; turns sort by number, nulls first, then by a digest of role and text. A null role
is the speaker "unknown", a null text is empty, a null conv_id is one dialogue. Control markers inside a text or a name are broken up, so that no
text can end its turn. Dialogues of context roles alone give no row, an empty table none. Extra columns are left out.

Dialogues of up to ``PART_TURNS`` rows take one shuffle, with partial collection before it. Of longer ones turns are ranked first in blocks of
turn numbers, and blocks in which a number repeats beyond ``PART_TURNS`` times by number and digest, so that no task takes a whole long dialogue;
only counts of blocks are ordered by dialogue. Speakers meet the parts of a long dialogue in salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns rendered in one row.
PART_TURNS = 1024
#: Roles that set a dialogue's context and aren't speakers.
CONTEXT = ("system",)
#: Markers of a rendering: fixed values.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Salts in which the speakers of a long dialogue meet its parts, at most.
SALTS = 64

BUCKET = ["key", "block", "number", "sub"]


def plain(text: Column) -> Column:
    """A text in which no control marker stands."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def prepared(turns: DataFrame, context: tuple[str, ...]) -> DataFrame:
    """Rows (key, turn, tie, role, text, context); key is a struct of the conv_id, which a null one keeps from being null."""
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    rows = turns.select(F.struct("conv_id").alias("key"), "turn", plain(role).alias("role"), plain(F.coalesce(F.col("text"), F.lit(""))).alias("text"), role.isin(*context).alias("context"))
    return rows.withColumn("tie", F.md5(F.concat_ws("\x1f", "role", "text")))


def rendered_context(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"), turn["text"], F.lit(END))


def collected(rows: DataFrame, *keys: str) -> DataFrame:
    """Turns of each group in order, as array turns."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("turn", "tie", "role", "text", "context"))).alias("turns"))


def speaking(turn: Column) -> Column:
    return ~turn["context"]


def bucketed(rows: DataFrame, most: int) -> DataFrame:
    """Turns of long dialogues with the bucket in which they are ranked: block of turn numbers; number and sub where a number of it is crowded."""
    rows = rows.withColumn("block", F.floor(F.col("turn") / F.lit(most)).cast("long"))
    many = rows.groupBy("key", "block", "turn").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    crowded = many.select("key", F.struct("turn").alias("at"), F.lit(True).alias("crowded"))
    blocks = many.select("key", F.struct("block").alias("in"), F.lit(True).alias("fine")).distinct()
    held = rows.withColumn("at", F.struct("turn")).withColumn("in", F.struct("block")).join(crowded, ["key", "at"], "left").join(blocks, ["key", "in"], "left")
    number = F.when(F.col("fine"), F.col("turn"))
    return held.withColumn("number", F.struct(number)).withColumn("block", F.struct("block")).withColumn("sub", F.when(F.col("crowded"), F.substring("tie", 1, 2)).otherwise("")).drop("at", "in", "crowded", "fine")


def parted(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Distinct turns of long dialogues with their rank and part, and (key, parts) of each dialogue."""
    rows = bucketed(rows, most)
    sizes = rows.groupBy(*BUCKET).agg(F.countDistinct(F.struct("turn", "tie")).alias("size"))
    before = Window.partitionBy("key").orderBy("block", "number", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    once = rows.repartition(*BUCKET).dropDuplicates([*BUCKET, "turn", "tie"])  # both this and the ranks below keep the buckets' partitions
    rank = F.row_number().over(Window.partitionBy(*BUCKET).orderBy("turn", "tie"))
    ranked = once.withColumn("rn", rank).join(starts, BUCKET).withColumn("rank", F.col("start") + F.col("rn") - 1)
    parts = sizes.groupBy("key").agg(F.ceil(F.sum("size") / F.lit(most)).cast("long").alias("parts"))
    return ranked.withColumn("part", F.floor(F.col("rank") / F.lit(most)).cast("long")), parts


def long_perspectives(rows: DataFrame, most: int) -> DataFrame:
    """Rows (key, part, turns, last, speaker) of long dialogues: last is the context turn before the part."""
    ranked, parts = parted(rows, most)
    ends = ranked.groupBy("key", "part").agg(F.max(F.when(F.col("context"), F.struct("rank", "role", "text"))).alias("last"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("last", F.last("last", ignorenulls=True).over(before))
    salts = F.least(F.col("parts"), F.lit(SALTS))
    speakers = rows.filter("NOT context").select("key", F.col("role").alias("speaker")).distinct().join(parts, "key")
    speakers = speakers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).select("key", "salt", "speaker")
    held = collected(ranked, "key", "part").join(ends, ["key", "part"]).join(parts, "key").withColumn("salt", F.pmod("part", salts))
    return held.join(speakers, ["key", "salt"]).select("key", "part", "turns", F.coalesce(rendered_context(F.col("last")), F.lit("")).alias("context"), "speaker")


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """One row for each dialogue, part and participant: conv_id, part, speaker, n_turns, context, rendered, mask (array of start, end
    in code points of rendered, ends exclusive)."""
    rows = prepared(turns, context)
    long = turns.groupBy(F.struct("conv_id").alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") > part_turns).select("key")
    short = collected(rows.join(long, "key", "left_anti"), "key")
    own = F.array_distinct(F.transform(F.filter("turns", speaking), lambda x: x["role"]))
    faced = short.select("key", F.lit(0).cast("long").alias("part"), "turns", F.lit("").alias("context"), F.explode(own).alias("speaker"))
    faced = faced.unionByName(long_perspectives(rows.join(long, "key", "left_semi"), part_turns))

    def header(x: Column) -> Column:
        return F.concat(F.lit(START), F.when(x["context"], x["role"]).when(x["role"] == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), x["role"])), F.lit("\n"))

    pieces = F.transform("turns", lambda x: F.struct(header(x).alias("head"), F.concat(x["text"], F.lit(END)).alias("body"), (~x["context"] & (x["role"] == F.col("speaker"))).alias("own")))
    cut = faced.select(F.col("key.conv_id").alias("conv_id"), "part", "speaker", F.size("turns").cast("long").alias("n_turns"), "context", pieces.alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda held, x: F.struct(
            (held["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(
                x["own"],
                F.concat(held["mask"], F.array(F.struct((held["at"] + F.length(x["head"])).alias("start"), (held["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end")))),
            )
            .otherwise(held["mask"])
            .alias("mask"),
        ),
    )
    return cut.select(
        "conv_id",
        "part",
        "speaker",
        "n_turns",
        "context",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        spans["mask"].alias("mask"),
    )
