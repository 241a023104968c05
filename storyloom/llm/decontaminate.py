"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 21
BLOCKS = 11
STRETCH = 256  # words


def with_shingles(df: DataFrame, text: str, hashes: str, shingle: int = SHINGLE) -> DataFrame:
    """Adds the XXH64 of each run of ``shingle`` words; of the whole sequence where there are fewer; none for no words.

    Words are lower-cased runs of letters and digits.
    """
    tokens, n = F.col("_tokens"), F.size("_tokens")
    every = F.transform(F.slice(tokens, 1, F.greatest(n - (shingle - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(tokens, i + k) for k in range(1, shingle)]))
    whole = F.array(F.xxhash64(F.lit("short"), F.concat_ws(" ", tokens)))
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # _tokens stands in the lambda: as a column of its own it is computed once a row
    return df.withColumn("_tokens", split).withColumn(hashes, F.when(n >= shingle, every).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))).drop("_tokens")


def with_simhash(df: DataFrame, hashes: str, fp: str) -> DataFrame:
    """Adds the 64-bit SimHash ``fp`` of an array of hashes; repeated shingles weigh as often as they occur.

    For each k below 32 one pass sums the bits k and k + 32 of all hashes, one in each half of a long.
    """
    places = F.sequence(F.lit(0), F.lit(31))
    sums = F.transform(places, lambda k: F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(0x0000000100000001))))

    def bit(count: Column, place: Column) -> Column:
        return F.when(count * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long"))

    bits = F.zip_with("_sums", places, lambda s, k: bit(s.bitwiseAND(F.lit(0xFFFFFFFF)), k).bitwiseOR(bit(F.shiftrightunsigned(s, 32), k + 32)))
    return df.withColumn("_sums", sums).withColumn(fp, F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))).drop("_sums")


def block_keys(fp: Column, blocks: int = BLOCKS, near: bool = False) -> Column:
    """Array of (block, value) for the blocks of a fingerprint; with ``near`` also the values that differ in one bit."""
    bounds = [round(k * 64 / blocks) for k in range(blocks + 1)]
    out = []
    for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        value = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).cast("int")
        flips = [0, *[1 << b for b in range(hi - lo)]] if near else [0]
        out += [F.struct(F.lit(k).alias("block"), value.bitwiseXOR(F.lit(x)).alias("value")) for x in flips]
    return F.array(*out)


def with_multiset(df: DataFrame, hashes: str, multiset: str) -> DataFrame:
    """Adds each hash with how often it occurred before, hashed once more: a set that stands for the multiset.

    In sorted order the equal ones before an element are a run that ends there, so their number is found by halving steps, only where there are any.
    """
    ordered = F.col("_ordered")

    def before(h: Column, i: Column) -> Column:
        def step(n: Column, k: Column) -> Column:
            further = n + F.call_function("shiftleft", F.lit(1), k)
            return F.when(F.get(ordered, i - further) == h, further).otherwise(n)

        return F.when(F.get(ordered, i - 1) == h, F.aggregate(F.sequence(F.lit(29), F.lit(0), F.lit(-1)), F.lit(0), step)).otherwise(0)

    number = F.transform(ordered, lambda h, i: F.xxhash64(h, before(h, i)))
    return df.withColumn("_ordered", F.array_sort(hashes)).withColumn(multiset, number).drop("_ordered")


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, n, hashes, multiset, fp) for each item; n: its shingles."""
    items = with_shingles(benchmark, "text", "hashes", shingle).select("item_id", "hashes")
    return with_multiset(with_simhash(items, "hashes", "fp"), "hashes", "multiset").select("item_id", F.size("hashes").alias("n"), "hashes", "multiset", "fp")


def rarest(where: DataFrame, often: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h, item_no, n): of each item's n shingles, repeats included, the floor((1 - similarity) * n) + 1 that the documents have least often (``often``: h, often)."""
    counted = where.groupBy("item_no", "n", "h").agg(F.count(F.lit(1)).alias("copies")).join(often, "h", "left").na.fill(0, ["often"])
    before = F.coalesce(F.sum("copies").over(Window.partitionBy("item_no").orderBy("often", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("place", before).where(F.col("place") < F.floor((1 - similarity) * F.col("n") + 1e-9) + 1).select("h", "item_no", "n")


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, text_hash, item_id, start, similarity): benchmark items found in documents, at their best place.

    A window of item size can only be similar if it shares a shingle, so windows are laid where a document's shingle equals
    one of an item: at the start that puts the two on each other, once for each run of equal shingles. A similar window lacks at most a fifth of an item's n
    shingles (of a similarity s follows: shared >= s * n, also where the text's edge cuts the window), so it holds one of any floor(n / 5) + 1 of them. Windows are
    only laid with one of the rarest so many in reach, so a phrase that very many documents and items share lays none by itself. The windows' SimHash fingerprints
    meet those of the items of the same size by multi-index Hamming blocks: of 11 blocks of two fingerprints within 21 bits, one
    differs by at most one bit, so an item is entered under each block value and its one-bit neighbours. What lies within
    the radius is verified by the exact weighted (multiset) Jaccard similarity of the shingles. At a similarity of just 0.8 two fingerprints
    differ in about ten bits, so the radius misses about one such window in ten thousand, and no exact copy.

    The plan is the same for all sizes: the words that are joined carry no arrays, and which side of a join is broadcast is the optimizer's choice by
    the size of the written tables.

    Passages are found anywhere in whole texts, case and punctuation aside; an item cut off by the end of a text is compared with what is there.
    Items and texts of fewer than five words have the whole sequence as one shingle: they match only if equal. Null or empty texts and
    items: no result. Null ids: carried. Repeated rows: one result row for each distinct (doc_id, text, item). Empty tables: empty result.
    """
    items = table(benchmark_items(benchmark, shingle).where("n > 0").withColumn("item_no", F.monotonically_increasing_id()))
    # written, so that the join knows its size: a small one is broadcast by the optimizer, a large one is not
    at = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), F.get("hashes", i - 1).alias("before")))
    where = table(items.select("item_no", "n", F.posexplode(at).alias("offset", "at")).select("item_no", "n", "offset", F.col("at.h").alias("h"), F.col("at.before").alias("item_before")))
    sought = table(where.select("h").distinct())
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    hashed = with_shingles(keyed, "text", "hashes", shingle).select("doc_id", "text_hash", at.alias("pairs"))
    # outer: of the inner form the optimizer infers a filter on the array, which it moves down and computes from scratch for each word
    words = hashed.select("doc_id", "text_hash", F.posexplode_outer("pairs").alias("pos", "at")).select("doc_id", "text_hash", "pos", "at.h", "at.before")
    shared = table(words.join(sought, "h").distinct())
    rare = rarest(where, shared.groupBy("h").agg(F.count(F.lit(1)).alias("often")), similarity)
    # the stretches of a document near a rare shingle of an item, then the shared shingles there that the item has
    stretch = F.explode(F.sequence(F.floor((F.col("pos") - F.col("n")) / STRETCH), F.floor((F.col("pos") + F.col("n")) / STRETCH)))
    reach = shared.join(rare, "h").select("doc_id", "text_hash", "item_no", stretch.alias("stretch")).distinct()
    there = F.expr(f"s.doc_id <=> r.doc_id and s.text_hash = r.text_hash and floor(s.pos / {STRETCH}) = r.stretch")
    close = shared.alias("s").join(reach.alias("r"), there).select("s.*", "r.item_no")
    hits = close.join(where, ["item_no", "h"]).where(F.col("item_before").isNull() | (F.col("pos") == 0) | ~F.col("before").eqNullSafe(F.col("item_before")))
    start, length = F.greatest(F.col("pos") - F.col("offset"), F.lit(0)), F.col("n") - F.greatest(F.col("offset") - F.col("pos"), F.lit(0))
    hits = table(hits.select("doc_id", "text_hash", "n", start.alias("start"), length.alias("length")).distinct())
    # only documents with a hit are hashed again, once each; so the rows of the joins above hold no arrays
    same = F.expr("d.doc_id <=> h.doc_id and d.text_hash = h.text_hash")
    again = with_shingles(keyed.alias("d").join(hits.select("doc_id", "text_hash").distinct().alias("h"), same, "left_semi"), "text", "hashes", shingle).drop("text")
    windows = again.alias("d").join(hits.alias("h"), same).select("h.*", F.slice("hashes", F.col("start") + 1, F.col("length")).alias("window"))
    windows = table(with_multiset(with_simhash(windows, "window", "window_fp"), "window", "window_set").drop("window", "length").distinct())
    probes = windows.select("doc_id", "text_hash", "n", "start", "window_fp", F.explode(block_keys(F.col("window_fp"), blocks)).alias("key"))
    index = table(items.select("n", "item_no", "fp", F.explode(block_keys(F.col("fp"), blocks, near=True)).alias("key")))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("window_fp"))) <= radius
    candidates = probes.join(index, ["n", "key"]).where(near).select("doc_id", "text_hash", "n", "start", "item_no").distinct()
    same_window = F.expr("w.doc_id <=> c.doc_id and w.text_hash = c.text_hash and w.n = c.n and w.start = c.start")
    found = windows.alias("w").join(candidates.alias("c"), same_window).select("w.*", "item_no").join(items.select("item_no", "item_id", "multiset"), "item_no")
    shared = F.size(F.array_intersect("window_set", "multiset"))
    found = found.withColumn("similarity", shared / (F.size("window_set") + F.size("multiset") - shared)).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.start")).alias("start"), F.round("best.similarity", 6).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    found = table(leaks(docs, benchmark, **settings).select("doc_id", "text_hash").distinct())  # written: where it is small, no text is shuffled
    named = docs.select(*(F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns)).withColumn("text_hash", F.xxhash64("d_text"))
    rows = named.alias("d").join(found.alias("f"), F.expr("d.d_doc_id <=> f.doc_id and d.text_hash = f.text_hash"), "left_anti")
    return rows.select(*(F.col(f"`d_{c}`").alias(c) for c in docs.columns))
