"""Chat formatting: logged snapshots of a growing conversation collapse into the longest, then turns are rendered.

Every turn gets the hash of the conversation up to it: the exclusive or of its turns' hashes, each of which has the turn's number
in it, in 2 x 64 bits, from role and text hashed twice with seeds of their own. A conversation that equals the first turns of a longer one is dropped by an anti-join on that hash; of equal
conversations the one with the smallest id stays.

A conversation may be of any length: turns are dealt by ranges of (conversation, turn), so one may lie in many partitions, and
a row for each partition that a conversation crosses into carries its count and hash on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagefold.llm.common import positions, written

#: A turn's rendering, and what roles without a name are called.
TEMPLATE, NO_ROLE = "<|{role}|>\n{text}\n", "unknown"


def _ordered() -> list[str]:
    return ["conv_id", "turn", "role_key", "text_key"]


def key(column: str, seed: int = 0) -> Column:
    """64 bits of a string, other ones for each even seed; null has a key that no string gets by being that text."""
    return F.when(F.col(column).isNull(), F.xxhash64(F.lit(seed + 1))).otherwise(F.xxhash64(F.lit(seed), F.col(column)))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role_key, text_key (hashes of role and text), place (from 1) and the hashes one, two of the conversation up to the row.

    Only hashes are dealt and sorted, not the texts. Rows of one turn number are in order of their hashes.
    """
    light = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key("role").alias("role_key"), key("text").alias("text_key"), F.xxhash64(key("role", 2), key("text", 2)).alias("second"))
    rows = positions(light, _ordered())
    part = rows.groupBy("conv_id", "pid").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    crossing = part.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select(F.col("conv_id").alias("crosses"))  # fewer than there are partitions
    earlier = W.partitionBy("conv_id").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    shift = part.join(F.broadcast(crossing), F.col("conv_id").eqNullSafe(F.col("crosses")), "left_semi").withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    carried = F.broadcast(shift.select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), "before"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p"))
    begin = F.min("at").over(W.partitionBy("conv_id", "pid"))
    numbered = rows.withColumn("place", F.col("at") - begin + 1).join(carried, same, "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("c", "p", "before", "at")
    hashed = numbered.withColumn("h1", F.xxhash64("place", "role_key", "text_key")).withColumn("h2", F.xxhash64("second", "place"))
    inside = W.partitionBy("conv_id", "pid").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    scanned = written(hashed.withColumn("one", F.bit_xor("h1").over(inside)).withColumn("two", F.bit_xor("h2").over(inside)), "turns")
    whole = scanned.join(F.broadcast(crossing), F.col("conv_id").eqNullSafe(F.col("crosses")), "left_semi").groupBy("conv_id", "pid").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    add = F.broadcast(whole.select(F.col("conv_id").alias("c"), F.col("pid").alias("p"), F.bit_xor("x1").over(earlier).alias("b1"), F.bit_xor("x2").over(earlier).alias("b2")))
    fold = lambda x, b: F.col(x).bitwiseXOR(F.coalesce(F.col(b), F.lit(0).cast("long"))).alias(x)
    return scanned.join(add, same, "left").select(*_ordered(), "place", fold("one", "b1"), fold("two", "b2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that stay, from turns().

    Equal conversations and equal prefixes are one row each before they meet, so a first turn that many share is one key.
    """
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", "one", "two")).alias("end")).select("conv_id", "end.*")
    distinct = whole.groupBy("place", "one", "two").agg(F.min("conv_id").alias("conv_id"))
    mine = prefixes.alias("p").join(whole.select(F.col("conv_id").alias("c"), F.col("place").alias("last")), F.col("conv_id").eqNullSafe(F.col("c")))
    shorter = mine.where("place < last").select("place", "one", "two").distinct()
    return distinct.join(shorter, ["place", "one", "two"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template; a null role is "unknown", null text is empty."""
    head, tail = TEMPLATE.split("{role}")
    middle, end = tail.split("{text}")
    return F.concat(F.lit(head), F.coalesce(role, F.lit(NO_ROLE)), F.lit(middle), F.coalesce(text, F.lit("")), F.lit(end))


def collapse(conversations: DataFrame) -> DataFrame:
    """The turns of the conversations that stay: conv_id, turn, place (from 1), n_turns, role, rendered.

    conversations: conv_id, turn, role, text; other columns are left out. Turns are ordered by number (null first), rows of one
    number by hashes of role and text; repeated rows are turns of their own. Null conv_ids are one conversation, which of equal
    ones is never the one to stay. Texts of any length are hashed whole and read once more to be rendered. Joined by place, the rendered turns of a conversation are its document.
    """
    prefixes = written(turns(conversations), "prefixes")
    stay = maximal(prefixes).select(F.col("conv_id").alias("c"), "n_turns")
    names = prefixes.select(F.col("conv_id").alias("i"), F.col("turn").alias("t"), F.col("role_key").alias("rk"), F.col("text_key").alias("tk"), "place").join(stay, F.col("i").eqNullSafe(F.col("c"))).drop("c")
    # rows alike in all four are interchangeable: each row's places are listed once and given out by number
    alike = names.groupBy("i", "t", "rk", "tk", "n_turns").agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    texts = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("role_key", key("role")).withColumn("text_key", key("text"))
    same = F.col("conv_id").eqNullSafe(F.col("i")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role_key") == F.col("rk")) & (F.col("text_key") == F.col("tk"))
    once = texts.join(alike, same)
    single = once.where("copies = 1").withColumn("place", F.col("first"))
    again = once.where("copies > 1").dropDuplicates(["conv_id", "turn", "role_key", "text_key"])
    many = again.withColumn("place", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    columns = ["conv_id", "turn", "place", "n_turns", "role", render(F.col("role"), F.col("text")).alias("rendered")]
    return single.select(columns).union(many.select(columns))
