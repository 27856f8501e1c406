"""What the registered queries do to ``conversations`` before the operators see them."""

from pyspark.sql import functions as F

from towerlens.llm import turns

HEADS = 8


def head_length(conv_id):
    return F.crc32(conv_id.cast("string")) % (HEADS + 1)


def members(conversations):
    """Every conversation once."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()


def rebuilt(conversations):
    """(conv_id, section, place, digest, size): the first h turns of conversation c - c % 5, then
    those of c behind its own first h, with h = crc32(c) % 9.

    A null c has no such neighbour and keeps its turns. The remainder of a negative c is negative,
    as in SQL. Turns of one number follow each other by role, then by digest.
    """
    rows = turns.placed(turns.ordered_turns(conversations), turns.turn_order())
    rows = turns.with_rank(rows, turns.carries(rows)[0]).select("conv_id", "rank", "digest", "size")
    heads = rows.filter((F.col("rank") <= HEADS) & (F.col("conv_id") % 5 == 0))
    heads = heads.select(F.col("conv_id").alias("base"), "rank", "digest", "size")
    bases = members(conversations).select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), head_length(F.col("conv_id")).alias("h")
    )
    first = bases.join(heads, "base").filter("rank <= h").select(
        "conv_id", F.lit(0).alias("section"), F.col("rank").alias("place"), "digest", "size"
    )
    own = rows.filter(F.coalesce(F.col("rank") > head_length(F.col("conv_id")), F.lit(True)))
    return first.unionAll(own.select("conv_id", F.lit(1).alias("section"), "rank", "digest", "size"))


def damaged(conversations):
    """Turns with faults by the remainder of crc32("conv_id:turn") by 20; a null is one space.

    0 drops the turn, 1 empties its text, 2 takes full stops and marks out of it, 3 repeats it, 4
    makes it the user's; all others stay.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("long").cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    text = F.coalesce("text", space)
    return (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
        )
        .drop("_copy")
    )
