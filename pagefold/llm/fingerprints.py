"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of its paragraphs' digests: a paragraph is a line, and a long line is cut after the first sentence that
ends past PIECE characters. The sketch has CELLS cells in three parts; a digest goes to one cell of each part, where it
adds to a count and is folded by exclusive or into a key and a check. Two sketches subtract cell by cell; what both have
cancels, and peeling cells that hold one digest recovers the digests that differ. If that stops early, larger sketches
are tried: digests are dealt to groups of about GROUP by further bits, with CELLS cells for each, and each group that does not peel
is dealt to four by two more bits, again and again. After RETRIES rounds every bit of the digests has been used, so a group
holds one digest, which always peels: the sketches alone recover every difference.

Only DataFrame functions, and no explode: each document's work is on arrays in its row. A text of any length is read whole; its
digests are held in its row, 8 bytes and some overhead each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagefold.functions.lambdas import let
from pagefold.llm.common import shuffle_partitions, text_partitions

PIECE, SLOTS, GROUP, ROUNDS, RETRIES = 100, 8, 14, 12, 32
CELLS = 3 * SLOTS
PARAGRAPH = rf"[^\n]{{1,{PIECE}}}+[^\n.!?]*+[.!?]*+\n*+|\n++"


def digests(text: Column) -> Column:
    """The distinct digests of the text's paragraphs; none for empty text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cells(key: Column) -> Column:
    """One bit for a cell of each part: the slots that three bits each of the digest name."""
    slot = lambda part: F.shiftrightunsigned(key, 3 * part).bitwiseAND(SLOTS - 1).cast("int")
    one = lambda part: F.element_at(F.array(*(F.lit(1 << (SLOTS * part + k)) for k in range(SLOTS))), slot(part) + 1)
    return one(0).bitwiseOR(one(1)).bitwiseOR(one(2))


def items(keys: Column) -> Column:
    """Digests with their checks and cells, which are worked out once here."""
    return F.transform(keys, lambda k: F.struct(k.alias("key"), _check(k).alias("check"), _cells(k).alias("cells")))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(0xFFFFFFFF)


def _bits() -> Column:
    return F.array(*(F.lit(1 << k) for k in range(CELLS)))


def sketch(some: Column, less: Column | None = None) -> Column:
    """Cells (n, key, check) of items; those of less, if given, count as minus one, so that the cells are those of a difference."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("check"))

    def put(bit: Column, sign: int):
        grown = lambda c, x: F.struct((c["n"] + sign).alias("n"), c["key"].bitwiseXOR(x["key"]).alias("key"), c["check"].bitwiseXOR(x["check"]).alias("check"))
        return lambda c, x: F.when(x["cells"].bitwiseAND(bit) != 0, grown(c, x)).otherwise(c)

    cell = lambda bit: F.aggregate(some, zero, put(bit, 1))
    both = lambda bit: F.aggregate(less, cell(bit), put(bit, -1))
    return F.transform(_bits(), cell if less is None else both)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["check"].bitwiseXOR(y["check"]).alias("check")))


def peel(cells: Column) -> Column:
    """The digests that differ (key, n: 1 or -1 for the side), or null if peeling stops before all cells are empty."""
    nothing = F.array().cast("array<struct<key:bigint,n:int>>")
    start = F.struct(cells.alias("cells"), nothing.alias("out"), F.lit(True).alias("on"))

    def round_(state: Column, _: Column) -> Column:
        alone = F.filter(state["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (c["check"] == _check(c["key"])))
        pure = F.array_distinct(F.transform(alone, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n"), c["check"].alias("check"), _cells(c["key"]).alias("cells"))))
        less = lambda c, p: F.struct((c["n"] - p["n"]).alias("n"), c["key"].bitwiseXOR(p["key"]).alias("key"), c["check"].bitwiseXOR(p["check"]).alias("check"))
        take = lambda bit: lambda c, p: F.when(p["cells"].bitwiseAND(bit) != 0, less(c, p)).otherwise(c)
        without = lambda pure: F.zip_with(state["cells"], _bits(), lambda c, bit: F.aggregate(pure, c, take(bit)))
        found = lambda p: F.transform(p, lambda x: F.struct(x["key"].alias("key"), x["n"].alias("n")))
        stop = F.struct(state["cells"].alias("cells"), state["out"].alias("out"), F.lit(False).alias("on"))
        next_ = lambda p: F.when(F.size(p) == 0, stop).otherwise(F.struct(without(p).alias("cells"), F.concat(state["out"], found(p)).alias("out"), F.lit(True).alias("on")))
        return F.when(state["on"], let(pure, next_)).otherwise(state)

    empty = lambda cells: F.forall(cells, lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_, lambda s: F.when(empty(s["cells"]), s["out"]))


def _split(a: Column, b: Column, n: Column, at: Column) -> Column:
    """Two sides' items in n groups (a power of two), by the digests' bits from at on."""
    mine = lambda xs, i: F.filter(xs, lambda x: F.call_function("shiftrightunsigned", x["key"], at).bitwiseAND((n - 1).cast("long")) == i.cast("long"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(mine(a, i).alias("a"), mine(b, i).alias("b")))


def _dealt(a: Column, b: Column, bits: Column) -> Column:
    """The two sides in 2 ** bits groups. Past eight groups items are dealt in two steps, so that the work grows little faster than the sets."""
    two = lambda n: F.element_at(F.array(*(F.lit(1 << k) for k in range(24))), n + 1)
    fine = lambda k, n: lambda g: _split(g["a"], g["b"], two(n - k), F.lit(9) + k)
    steps = lambda s: F.flatten(F.transform(_split(a, b, two(s["first"]), F.lit(9)), fine(s["first"], s["bits"])))
    first = lambda n: F.struct(n.alias("bits"), F.when(n > 3, F.shiftright(n, 1)).otherwise(0).alias("first"))
    return let(F.least(bits, F.lit(40)), lambda n: let(first(n), steps))


DIGESTS = "array<struct<key:bigint,n:int>>"


def difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Struct of the digests (key, n: 1 or -1 for the side) that differ between items a and b, whose sketches are cells_a and cells_b, and the level that gave them: 0 these sketches, 1 larger ones, 2 and more as many groups dealt again."""
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), (F.size(a) + F.size(b)) / GROUP))).cast("int")
    start = F.struct(_dealt(a, b, bits).alias("groups"), F.array().cast(DIGESTS).alias("out"), F.lit(0).alias("level"))

    def round_(state: Column, r: Column) -> Column:
        tried = F.transform(state["groups"], lambda g: F.struct(g["a"].alias("a"), g["b"].alias("b"), peel(sketch(g["a"], g["b"])).alias("found")))
        again = lambda gs: F.flatten(F.transform(F.filter(gs, lambda g: g["found"].isNull()), lambda g: _split(g["a"], g["b"], F.lit(4), F.pmod(40 + 2 * r, F.lit(64)))))
        found = lambda gs: F.flatten(F.transform(F.filter(gs, lambda g: g["found"].isNotNull()), lambda g: g["found"]))
        next_ = lambda gs: F.struct(again(gs).alias("groups"), F.concat(state["out"], found(gs)).alias("out"), (r + 1).alias("level"))
        return F.when(F.size(state["groups"]) == 0, state).otherwise(let(tried, next_))

    larger = F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES)), start, round_, lambda s: F.struct(s["out"].alias("digests"), s["level"].alias("level")))
    return let(peel(subtract(cells_a, cells_b)), lambda x: F.when(x.isNotNull(), F.struct(x.alias("digests"), F.lit(0).alias("level"))).otherwise(larger))


def differing(a: Column, b: Column) -> Column:
    """difference() of two texts: the paragraphs' digests that only one of them has, and on which side."""
    sides = F.struct(items(digests(F.coalesce(a, F.lit("")))).alias("a"), items(digests(F.coalesce(b, F.lit("")))).alias("b"))
    return let(sides, lambda s: difference(s["a"], s["b"], sketch(s["a"]), sketch(s["b"])))


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """Shared digests by all digests of two sets; 1 for two empty sets."""
    n = (F.size(a) + F.size(b)).cast("double")
    return F.when(n == 0, F.lit(1.0)).otherwise((n - differ) / (n + differ))


def as_text(cells: Column) -> Column:
    hexed = lambda x: F.lower(F.hex(x))
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(".", c["n"].cast("string"), hexed(c["key"]), hexed(c["check"]))), " ")


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text, bucket, at (order in the bucket's sort), halo for docs (doc_id, text), dealt so that each row's next row by doc_id is in its bucket.

    Buckets are ranges of doc_id, by quantiles; rows of one doc_id are in one bucket, as their order is part of the result. A range's first row is also put, as halo 1, at the end of the range before, and the first row
    of all at the end of the last (halo 2). Null ids come first; rows of one id are in order of their text.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    share = [k / buckets for k in range(1, buckets)] or [0.5]
    bounds, nulls, least = ids.agg(F.percentile_approx("doc_id", share, 10_000), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    bounds = sorted({x for x in bounds or []})
    step = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    d = F.col("doc_id")
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= d))
    if bounds:
        fine = F.array(longs([]), *map(longs, rows))
        row = upto(longs([r[0] for r in rows]))
        bucket = F.when(d.isNull(), 0).otherwise(let(row, lambda k: F.when(k == 0, 0).otherwise((k - 1) * step + upto(F.element_at(fine, k + 1)))))
        at_bound = let(row, lambda k: F.array_contains(F.element_at(fine, k + 1), F.coalesce(d, F.lit(0).cast("long")))) & d.isNotNull()
    else:
        bucket, at_bound = F.lit(0), F.lit(False)
    first = d.isNull() if nulls else d == F.lit(least).cast("long")
    place = lambda b, halo: F.struct(b.cast("int").alias("bucket"), F.lit(halo).alias("halo"))
    none = F.lit(None).cast("struct<bucket:int,halo:int>")
    own = docs.select(d.cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", bucket)
    copies = F.array_compact(F.array(place(F.col("bucket"), 0), F.when(at_bound, place(F.col("bucket") - 1, 1)).otherwise(none), F.when(first, place(F.lit(len(bounds)), 2)).otherwise(none)))
    return own.withColumn("place", F.explode(copies)).select("doc_id", "text", "place.bucket", "place.halo").repartition(buckets, "bucket")


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text; others are left out) its fingerprint, that of its edited text, and their likenesses; also
    how many digests differ, and the level of sketches that gave them.

    The edited text has the last quarter (rounded down) of the code points replaced by as many from the start of the next row's
    text, or all of that; the next row is that of the next larger doc_id, after the last the first, alone itself. Null text is empty:
    no digests, and like another empty text by 1. Repeated rows stay, in order of text within a doc_id; null ids come first.
    """
    rows = with_next(docs, text_partitions(docs, least=2 * shuffle_partitions(docs.sparkSession)))
    rows = rows.withColumn("keys", items(digests(F.col("text")))).withColumn("cells", sketch(F.col("keys")))
    order = W.partitionBy("bucket").orderBy("halo", F.asc_nulls_first("doc_id"), "text")
    rows = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "keys", "cells"))).where("halo = 0")
    n, tail = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail)))
    rows = rows.withColumn("edited_keys", items(digests(F.col("edited")))).withColumn("edited_cells", sketch(F.col("edited_keys")))
    for other in ("edited", "next"):
        rows = rows.withColumn(f"{other}_found", difference(F.col("keys"), F.col(f"{other}_keys"), F.col("cells"), F.col(f"{other}_cells")))
    differ = lambda other: F.size(f"{other}_found.digests")
    near = lambda other: likeness(F.col("keys"), F.col(f"{other}_keys"), differ(other))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("cells")).alias("fingerprint"), as_text(F.col("edited_cells")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"), near("next").alias("near_next"),
        *(x for o in ("edited", "next") for x in (differ(o).alias(f"{o}_differ"), F.col(f"{o}_found.level").alias(f"{o}_level"))),
    )
