"""What follows from sentences and shots: owners, ranges, statistics, suspense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import fixed, is_short

KEY = ["project", "chapter"]


def owners(shots: DataFrame) -> DataFrame:
    """(project, chapter, sid, owner): the last shot that lists a sentence."""
    listed = shots.select(*KEY, "pos", "shot_id", F.explode("sentence_ids").alias("sid"))
    return listed.groupBy(*KEY, "sid").agg(F.max(F.struct("pos", "shot_id")).alias("last")).select(*KEY, "sid", F.col("last.shot_id").alias("owner"))


def with_owners(sentences: DataFrame, shots: DataFrame) -> DataFrame:
    """Sentences with their shot_id filled in; one that no shot lists keeps what it had."""
    return sentences.join(owners(shots), [*KEY, "sid"], "left").withColumn("shot_id", F.coalesce("owner", "shot_id")).drop("owner")


def orphans(sentences: DataFrame, shots: DataFrame) -> DataFrame:
    """Sentences that no shot lists."""
    return sentences.join(owners(shots), [*KEY, "sid"], "left_anti")


def sid_number(sid: Column) -> Column:
    return F.regexp_extract(sid, "([0-9]+)", 1).try_cast("int")


def with_ranges(shots: DataFrame) -> DataFrame:
    """Shots with sentence_range, the least and greatest number of their sentences; without sentences it stays as it was."""
    numbers = F.filter(F.transform("sentence_ids", sid_number), lambda x: x.isNotNull())
    was = F.col("sentence_range") if "sentence_range" in shots.columns else F.lit(None).cast("array<int>")
    return shots.withColumn("sentence_range", F.when(F.size(numbers) > 0, F.array(F.array_min(numbers), F.array_max(numbers))).otherwise(was))


def distribution(shots: DataFrame, of: str) -> DataFrame:
    """(project, chapter, value, n) of shot types or of their functions."""
    rows = shots.select(*KEY, F.explode("funcs").alias("value")) if of == "funcs" else shots.select(*KEY, F.col(of).alias("value"))
    return rows.groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("n"))


def as_map(dist: DataFrame, name: str) -> DataFrame:
    return dist.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(name))


def sentence_counts(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sentence_count"), F.count_if(is_short(F.col("text"))).alias("short_count"), F.count_if(F.col("struct") == "句从").alias("cluster_count"))


def chapter_stats(sentences: DataFrame, shots: DataFrame) -> DataFrame:
    """D3: counts, distributions and rates of each chapter. Each side is aggregated before the join."""
    counts = sentence_counts(sentences)
    n_shots = shots.groupBy(*KEY).agg(F.count(F.lit(1)).alias("shot_count"))
    rows = counts.join(n_shots, KEY, "full_outer").join(as_map(distribution(shots, "type"), "shot_type_dist"), KEY, "left").join(as_map(distribution(shots, "funcs"), "func_dist"), KEY, "left")
    rows = rows.na.fill(0, ["sentence_count", "short_count", "cluster_count", "shot_count"])
    of = F.greatest(F.col("sentence_count"), F.lit(1))
    return rows.withColumns({"short_sentence_rate": fixed(F.col("short_count") / of, F.lit(2)), "sentence_cluster_rate": fixed(F.col("cluster_count") / of, F.lit(2))})


def suspense(shots: DataFrame) -> DataFrame:
    """Shots with the function of suspense, with their place among them."""
    ranged = with_ranges(shots).where(F.array_contains("funcs", "悬念"))
    return ranged.select(*KEY, "pos", "shot_id", "label", F.coalesce("sentence_range", F.array(F.lit(0), F.lit(0))).alias("sentence_range"))
