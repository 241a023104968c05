"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import WORD, cut, table

CYCLE = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(text: Column, digits: int) -> Column:
    """A whole number from the first hex digits of the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def cycle_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """Weights that repeat over the sources in code-point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.lit(cycle[-1])
    for i, w in list(enumerate(cycle))[-2::-1]:
        weight = F.when(place % len(cycle) == i, w).otherwise(weight)
    return sources.withColumn("weight", weight)


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, weight).

    The sources share ``share`` of all sizes by weight. A target stops at ``most`` times its source's size and the excess
    is shared anew by weight; that fixes one water level: target = least(most * size, weight * level). Sources are taken
    in the order in which they reach their stop; the first level that isn't above the next stop is the right one, later ones are lower. One row a source:
    the single ordered window here reads as many rows as there are sources, whatever the number of documents.
    """
    stop = F.col("source_size") * F.lit(most)
    order = Window.orderBy(F.col("stop_level"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.when(F.col("level") <= F.col("stop_level"), F.col("level"))
    return (
        sources.withColumn("stop", stop.cast("double"))
        .withColumn("stop_level", F.col("stop") / F.col("weight"))
        .withColumn("level", left / weight_left)
        .withColumn("found", F.max(level).over(everything))
        .withColumn("target", F.least(F.col("stop"), F.col("weight") * F.coalesce("found", F.lit(0.0))))
        .select("source", "source_size", "weight", "target")
    )


def copies(docs: DataFrame, cycle: tuple[float, ...] = CYCLE, share: float = SHARE, most: float = MOST, seed: str = SEED, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """How often the mix takes each row: (key..., source, size, source_size, target, copies, taken).

    Systematic sampling: the rows of a source stand in order of size (largest first, then by a keyed hash, then doc_id), each expects
    target / source_size copies, and a row is taken once for each whole number that the running sum plus the source's
    random offset crosses at it. In this order the words taken differ from the target by less than the largest size.

    The running sum is built from counts: rows before a size (window over the source's distinct sizes), before a hash slice
    in a size, and in the slice. The slices number the square root of the rows, so a source, or a size, with a third of
    all rows makes neither long windows nor large groups.

    Null text: size 0, taken 0. Null source: a source of its own. Null doc_id: kept. Repeated rows: rows of their own.
    Empty table: empty result.
    """
    first = key[0]
    sized = docs.select(*key, "source", n_words(F.col("text")).alias("size"), _unit(F.coalesce(F.col(first).cast("string"), F.lit("")), 7).alias("draw"))
    sized = cut(sized)
    slices = F.broadcast(sized.agg(F.greatest(F.lit(1), F.floor(F.sqrt(F.count(F.lit(1))))).cast("long").alias("slices")))  # one row
    sliced = sized.join(slices).withColumn("slice", F.floor(F.col("draw") * F.col("slices") / F.lit(1 << 28)).cast("long")).drop("slices")
    per_slice = sliced.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    by_slice = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = cut(per_slice.withColumn("before_slice", F.coalesce(F.sum("n").over(by_slice), F.lit(0))))
    per_size = per_slice.groupBy("source", "size").agg(F.sum("n").alias("n"))
    by_size = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.withColumn("before_size", F.coalesce(F.sum("n").over(by_size), F.lit(0))).drop("n")
    sizes = per_slice.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = targets(cycle_weights(sizes, cycle), share, most)
    offset = _unit(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("\x00"))), 5) / F.lit(float(1 << 20))
    aims = aims.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", offset)
    per_size = per_size.alias("s").join(aims.alias("a"), F.expr("s.source <=> a.source")).select("s.source", "s.size", "before_size", "source_size", "target", "rate", "offset")
    per_slice = per_slice.alias("p").join(per_size.alias("s"), F.expr("p.source <=> s.source and p.size = s.size"))
    place = per_slice.select("p.source", "p.size", "p.slice", (F.col("before_size") + F.col("before_slice")).alias("before"), "source_size", "target", "rate", "offset")
    in_slice = Window.partitionBy("source", "size", "slice").orderBy("draw", *key)
    ranked = sliced.withColumn("rank", F.row_number().over(in_slice))
    joined = ranked.alias("r").join(place.alias("p"), F.expr("r.source <=> p.source and r.size = p.size and r.slice = p.slice"))
    rank = F.col("before") + F.col("rank")
    crossed = F.floor(rank * F.col("rate") + F.col("offset")) - F.floor((rank - 1) * F.col("rate") + F.col("offset"))
    return joined.select(*(f"r.{k}" for k in key), "r.source", "r.size", "source_size", "target", crossed.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed documents themselves: every row of ``docs`` as often as it is taken, with ``copy_no`` from 1.

    Texts are shuffled at most once, to meet their counts; only rows that repeat are brought together once more, and come out as often as they are taken in all.
    """
    named = docs.select(*(F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns)).withColumn("text_hash", F.xxhash64("d_text"))
    plain = named.select(F.col("d_doc_id").alias("doc_id"), F.col("d_text").alias("text"), F.col("d_source").alias("source"), "text_hash")
    taken = copies(plain, key=("doc_id", "text_hash"), **settings).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    same = F.expr("d.d_doc_id <=> t.doc_id and d.text_hash = t.text_hash and d.d_source <=> t.source")
    rows = named.alias("d").join(table(taken.where("copies > 0")).alias("t"), same).select("d.*", "t.copies", "t.rows")
    once = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(["d_doc_id", "text_hash", "d_source"]))
    return once.select(*(F.col(f"`d_{c}`").alias(c) for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"))
