"""Mixing sources to target weights by Pareto order sampling.

Every source's target is filled with whole documents. A document is expected in the mix c * w(size)
times, at most `most` times: w falls slowly with the document's length (32 less the number of binary
digits after the first), so that repeats go to shorter documents first, and c is the source's level at
which the expected words are its target. The whole part of that is certain copies; the rest, p, is
the document's inclusion odds in a sample, unlike for documents of unlike length. The source's documents
are ranked in one order by (u / (1 - u)) / (p / (1 - p)), u a uniform number hashed from the document,
and taken from its start. The size that is fixed is the source's remaining words, as targets are set in words: a
fixed number of documents would miss its target by the spread of their lengths. The sample ends before or
after the document in which the words are full, whichever is nearer. Equal rows are told apart by a number, so each
has its own place in the order.

The cut in a source's order is found by counts over digits of the rank, two rounds of at most 4,096
buckets a source, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 4096
#: Equal rows that are dealt out together.
REPEATS = 10_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> with target: shares by weight, what is above `most` times a
    source's size dealt to the others by weight until none is above.

    A row for each source; the sources are ranked by code point, null last. The level at which
    the dealing ends is found directly: with sources by rising most * size / weight, those before
    the cut get their most, the others the rest by weight.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rank = (F.row_number().over(names) - 1) % len(weights)
    out = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), rank + 1))
    out = out.withColumn("_cap", most * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    total = share * F.sum("source_size").over(every)
    full, light = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    out = out.withColumn("_level", (total - full) / (F.sum("_w").over(every) - light))
    out = out.withColumn("_order", F.row_number().over(by_cap))
    cut = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_order", "_level"))).over(every)
    out = out.withColumn("_cut", cut)
    target = F.when(F.col("_cut").isNull() | (F.col("_order") < F.col("_cut._order")), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_cut._level")))
    return out.select("source", "source_size", target.alias("target"))


def _uniform(*columns: str, seed: int) -> Column:
    """A number in (0, 1) hashed from the columns: 52 bits of an MD5 sum."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def weight(size: Column) -> Column:
    """32 less the number of binary digits after the first, 1 at least; sizes are 1 or more."""
    return F.greatest(F.lit(1), F.lit(33) - F.length(F.bin(size))).cast("long")


def levels(classes: DataFrame, most: float) -> DataFrame:
    """classes (_key, _w, _words, target) -> with _times: the expected copies of a class's documents.

    A source's weights number 32 at most. Classes by falling weight: those before the cut get `most`,
    the others c * weight, with c found directly from the words that are left.
    """
    by = Window.partitionBy("_key").orderBy(F.desc("_w"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = F.coalesce(F.sum("_words").over(before), F.lit(0))
    out = classes.withColumn("_c", (F.col("target") - most * full) / F.sum(F.col("_w") * F.col("_words")).over(after))
    cut = F.min(F.when(F.col("_c") * F.col("_w") <= most, F.struct(F.lit(-1) * F.col("_w"), F.col("_c").alias("_c")))).over(Window.partitionBy("_key"))
    out = out.withColumn("_cut", cut)
    below = F.col("_cut").isNotNull() & (F.col("_w") <= -F.col("_cut").getField("col1"))
    return out.withColumn("_times", F.when(below, F.least(F.lit(most), F.col("_cut._c") * F.col("_w"))).otherwise(F.lit(most))).drop("_cut", "_c")


def _cut(rows: DataFrame, digit: str, keys: list[str], room: str) -> DataFrame:
    """Per key the first bucket whose words no longer fit in `room`, and the words before it."""
    sums = rows.groupBy(*keys, digit, room).agg(F.sum("size").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(digit))
    over = sums.withColumn("_upto", upto).where(F.col("_upto") > F.col(room))
    first = over.groupBy(*keys).agg(F.min(F.struct(digit, F.expr("_upto - _sum"))).alias("_first"))
    return first.select(*keys, F.col("_first").getField(digit).alias(f"{digit}_cut"), F.col("_first.col2").alias(f"{digit}_before"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 20260101) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every row.

    Null texts have size 0 and are taken 0 times; null sources are one source, the last. The same
    rows and seed give the same mix, in whatever order they come. Repeated rows, and rows without doc_id, are ranked
    each. A source without words has target 0. Texts of any length are counted whole.
    """
    sized = stored(_told_apart(_keys(docs)), "sized")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_key")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stored(targets(sums, weights, share, most).select(key, "source_size", "target"), "targets")
    keyed = sized.withColumn("_key", key).withColumn("_w", F.when(F.col("size") > 0, weight(F.col("size"))).otherwise(0))
    classes = keyed.where("size > 0").groupBy("_key", "_w").agg(F.sum("size").alias("_words")).join(goal, "_key")
    classes = levels(classes, most).withColumn("_whole", F.floor(F.col("_times") + 1e-12).cast("long"))
    room = F.col("target") - F.sum(F.col("_whole") * F.col("_words")).over(Window.partitionBy("_key"))
    classes = stored(classes.select("_key", "_w", "_whole", F.greatest(F.col("_times") - F.col("_whole"), F.lit(0.0)).alias("_p"), room.alias("_room")), "levels")
    rows = keyed.join(goal, "_key").join(classes, ["_key", "_w"], "left").fillna(0, ["_whole", "_p", "_room"])
    u, p = _uniform("doc_id", "size", "source", "_repeat", seed=seed), F.col("_p")
    odds = (u / (1 - u)) / (p / (1 - p))
    rows = rows.withColumn("_q", F.when(p > 0, odds)).withColumn("_v", F.col("_q") / (1 + F.col("_q")) * BUCKETS)
    rows = rows.withColumn("_d1", F.floor("_v")).withColumn("_d2", F.floor((F.col("_v") - F.col("_d1")) * BUCKETS))
    rows = stored(rows, "ranked")
    live = rows.where("_p > 0 and size > 0")
    one = stored(_cut(live, "_d1", ["_key"], "_room"), "cut")
    inside = live.join(one, "_key").where("_d1 = _d1_cut").withColumn("_room2", F.col("_room") - F.col("_d1_before"))
    two = stored(_cut(inside, "_d2", ["_key"], "_room2"), "cut")
    last = inside.join(two, "_key").where("_d2 = _d2_cut")
    order = ("_q", "doc_id", "size", "_repeat")
    upto = F.sum("size").over(Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("_gap", F.expr("_room2 - _d2_before") - (upto - F.col("size"))).where("size > _gap")
    stop = last.groupBy("_key").agg(F.min(F.struct(*order, "_gap")).alias("_stop"))
    rows = rows.join(stored(stop, "stop"), "_key", "left")
    here, end = F.struct(*order), F.struct(*(F.col(f"_stop.{c}").alias(c) for c in order))
    taken = F.col("_stop").isNull() | (here < end) | (here.eqNullSafe(end) & (F.col("size") <= 2 * F.col("_stop._gap")))
    copies = (F.col("_whole") + F.when((p > 0) & taken, 1).otherwise(0)).cast("long")
    return rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))


def _told_apart(rows: DataFrame) -> DataFrame:
    """rows with _repeat, a number from 0 that tells equal rows apart. Equal rows are counted and dealt out again
    in blocks of REPEATS, so that however many there are, no task holds or sorts them."""
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    once = counts.where("_n = 1").select(*rows.columns, F.lit(0).cast("long").alias("_repeat"))
    many = counts.where("_n > 1").select(*rows.columns, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(REPEATS).cast("long"))).alias("_block"))
    many = many.repartition(*rows.columns, "_block")
    return once.union(many.select(*rows.columns, F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + REPEATS, F.col("_n")) - 1)).alias("_repeat")))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as in docs.

    Of rows that share a doc_id (or have none), a source and a size as many are taken once more as `mix` says. These
    rows, few in most tables, are written once, so that each task's share of them is the same when it is read again.
    Texts are shuffled once for all other rows, at every size alike, and once more only where many rows share these.
    """
    ids = ("_id", "_of", "_words")
    chosen = mix(docs, weights, share, most).groupBy("doc_id", "source", "size").agg(F.count("*").alias("_n"), F.min("copies").alias("_least"), F.sum("copies").alias("_sum"))
    chosen = stored(chosen.where("_sum > 0").toDF(*ids, "_n", "_least", "_sum"), "chosen")
    same = F.col("_id").eqNullSafe(docs["doc_id"].cast("long")) & F.col("_of").eqNullSafe(docs["source"].cast("string")) & (F.col("_words") == word_count(docs["text"].cast("string")))
    every = docs.join(chosen.where("_n = 1").hint("merge"), same).withColumn("_copies", F.col("_sum")).select(*docs.columns, "_copies")
    shared = stored(chosen.where("_n > 1"), "shared")
    if not shared.isEmpty():
        every = every.union(_dealt(docs.join(shared, same), ids).select(*docs.columns, "_copies"))
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long")))).select(docs.columns)


def _dealt(rows: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """Rows that share their ids, with _copies: as many as `_sum` asks for are taken once more than `_least`."""
    many = stored(rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "repeats")
    parts = many.groupBy(*ids, "_part").agg(F.count("*").alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*ids).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"{c}_") for c in ids), F.col("_part").alias("_part_"), before.alias("_before"))
    of = F.col("_part") == F.col("_part_")
    for c in ids:
        of = of & F.col(c).eqNullSafe(F.col(f"{c}_"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*ids, "_part").orderBy("_row"))
    more = F.col("_sum") - F.col("_least") * F.col("_n")  # rows that are taken once more than the others
    return many.join(parts, of).withColumn("_copies", F.col("_least") + F.when(place <= more, 1).otherwise(0)).where("_copies > 0")
