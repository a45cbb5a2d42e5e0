"""Chat formatting: collapse of cumulative snapshots, then rendering.

A chat log often holds a conversation several times, each snapshot with a few
more turns.  Every turn gets a rolling hash of all turns up to it (position-
tagged turn hashes folded with xor, 2 x 64 bits); a conversation whose whole
hash is the prefix hash of a longer one is a snapshot and goes (anti-join), and
of equal conversations the one with the smallest id stays.  The others are
rendered with a turn template.  DataFrame functions only.

Edge cases: turns are ordered by (turn, role, text), nulls first; a turn given
twice counts once; a null role or text is a value of its own and renders as
empty; rows without a conversation id are conversations of one turn each; an
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turn_hash(salt: int) -> Column:
    parts = [F.lit(salt), F.col("pos")]
    for c in ("role", "text"):
        parts += [F.col(c).isNull(), F.coalesce(c, F.lit(""))]  # the hash function skips nulls
    return F.xxhash64(*parts)


def prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn once, with its position (from 1), the rolling hashes ``h1`` and ``h2`` of
    the turns up to it, and ``n``, the conversation's number of turns."""
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    # rows without an id are dealt out by what they hold, not gathered in one group
    t = t.withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", *[
        c for n in ("role", "text") for c in (F.col(n).isNull(), F.coalesce(n, F.lit("")))])))
    group = Window.partitionBy("conv_id", "own")
    order = group.orderBy("turn", "role", "text")
    whole = F.struct("turn", "role", "text")
    t = t.withColumn("again", F.coalesce(F.lag(whole).over(order).eqNullSafe(whole), F.lit(False)))
    t = t.withColumn("pos", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    for k in (1, 2):
        t = t.withColumn(f"h{k}", F.bit_xor(F.when(F.col("again"), F.lit(0).cast("long")).otherwise(_turn_hash(k))).over(upto))
    return t.withColumn("n", F.max("pos").over(group)).where(~F.col("again")).drop("again")


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations to keep, from ``prefixes``: (conv_id, own, n, copies)."""
    whole = turns.where(F.col("pos") == F.col("n")).groupBy("n", "h1", "h2").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("last"), "conv_id", "own")).alias("first"), F.count(F.lit(1)).alias("copies"))
    shorter = turns.where(F.col("pos") < F.col("n")).select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(shorter, ["n", "h1", "h2"], "left_anti").select("first.conv_id", "first.own", "n", "copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the conversations in ``kept``."""
    line = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    k = kept.select(F.col("conv_id").alias("k_id"), F.col("own").alias("k_own"), "copies")
    own = turns.join(k, F.col("conv_id").eqNullSafe(F.col("k_id")) & F.col("own").eqNullSafe(F.col("k_own")))
    out = own.groupBy("conv_id", "own", "n", "copies").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return out.select("conv_id", F.col("n").alias("n_turns"), F.col("copies").alias("n_copies"),
                      F.array_join(F.col("lines.line"), "").alias("rendered"))


def collapse_and_render(turns: DataFrame, **columns: str) -> DataFrame:
    p = prefixes(turns, **columns)
    return render(p, maximal(p))
