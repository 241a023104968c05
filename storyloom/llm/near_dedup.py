"""SimHash near-duplicates: tiles of fingerprints compared exactly with numpy exclusive-or and bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import cut, map_values, row_key, table
from storyloom.llm.components import components

RADIUS = 3
SHINGLE = 3
TILE = 2048
_HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of the word shingles in order, some at a time; of the whole sequence if there are fewer words; nothing for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return
    n = max(1, len(words) - shingle + 1)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[len(ends) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, _HASHES_AT_ONCE):
        yield np.array([digest(flat[i:j], 42) for i, j in zip(starts[k : k + _HASHES_AT_ONCE], stops[k : k + _HASHES_AT_ONCE], strict=True)], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles as a signed number; no words: 0."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        n += len(hashes)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) for each row. Null and empty texts: fingerprint 0. Texts are read whole."""
    schema = T.StructType([T.StructField("fp", T.LongType())])
    return map_values(docs, row_key(), F.col("text"), lambda text: (fingerprint(text, shingle),), schema)


def stars(fps: np.ndarray, pops: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the near fingerprints of one or two tiles: for each component found, every other member with its first.

    fps are in order of pops; rows whose population counts differ by more than the radius are not compared.
    """
    n = len(fps)
    near = np.zeros((n, n), bool)
    for i in range(0, n, 256):
        j = min(i + 256, n)
        lo, hi = np.searchsorted(pops, [int(pops[i]) - radius, int(pops[j - 1]) + radius + 1])
        near[i:j, lo:hi] = np.bitwise_count(fps[i:j, None] ^ fps[None, lo:hi]) <= radius
    open_ = near.sum(axis=1) > 1
    tails, heads = [], []
    for seed in np.flatnonzero(open_):
        if not open_[seed]:
            continue
        open_[seed] = False
        edge = np.array([seed])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & open_)
            open_[edge] = False
            tails.append(fps[edge])
            heads.append(np.full(len(edge), fps[seed]))
    empty = np.empty(0, fps.dtype)
    return np.concatenate([empty, *tails]), np.concatenate([empty, *heads])


def _ordered(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fps = np.concatenate(parts)
    pops = np.bitwise_count(fps)
    order = np.argsort(pops, kind="stable")
    return fps[order], pops[order]


def near_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the values of ``distinct.fp``, enough to join all that are joined by pairs within ``radius`` bits.

    Two fingerprints that differ in at most ``radius`` bits agree on one of radius + 1 blocks. So the fingerprints are laid out
    once for each block, range-partitioned by (block value, population count, fingerprint): as fingerprints are distinct, partitions
    stay even even if all share a block value. Each run of ``tile`` rows is a tile. A tile is compared with itself; where a block value goes on over
    several tiles, the parts that have it meet pair by pair, unless their population counts lie more than the radius apart.
    """
    width = 64 // (radius + 1)
    mask = (1 << width) - 1
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(mask if k < radius else -1)).alias("value")) for k in range(radius + 1)])
    rows = distinct.select("fp", F.bit_count("fp").alias("pop"), F.explode(blocks).alias("at")).select("at.block", "at.value", "pop", "fp")
    rows = rows.repartitionByRange("block", "value", "pop", "fp").sortWithinPartitions("block", "value", "pop", "fp")
    schema = "block int, value long, tile long, part int, pop_min int, pop_max int, fps binary"
    names = ["block", "value", "tile", "part", "pop_min", "pop_max", "fps"]

    def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tile whole (part 0), and the parts that share its first and its last block value (part 1)."""
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() << 40) - 1
        held: list[np.ndarray] = [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint64)]

        def made(block: np.ndarray, value: np.ndarray, fps: np.ndarray) -> Iterator[tuple]:
            nonlocal number
            for k in np.unique(block):
                v, f = value[block == k], fps[block == k]
                number += 1
                pops = np.bitwise_count(f)
                yield int(k), 0, number, 0, int(pops.min()), int(pops.max()), f.tobytes()
                for x in {int(v[0]), int(v[-1])}:
                    g, p = f[v == x], pops[v == x]
                    yield int(k), x, number, 1, int(p.min()), int(p.max()), g.tobytes()

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            whole = len(held[0]) // tile * tile
            for i in range(0, whole, tile):
                yield packed(list(made(*(x[i : i + tile] for x in held))))
            held = [x[whole:] for x in held]
        if len(held[0]):
            yield packed(list(made(*held)))

    tiles = cut(rows.mapInArrow(tiles_of, schema))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = stars(*_ordered(*(np.frombuffer(x, np.uint64) for x in row)), radius)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    parts = tiles.where("part = 1").select("block", "value", "tile", "pop_min", "pop_max", "fps")
    x, y = parts.alias("x"), parts.alias("y")
    meet = F.expr(f"x.block = y.block and x.value = y.value and x.tile < y.tile and x.pop_min <= y.pop_max + {radius} and y.pop_min <= x.pop_max + {radius}")
    inside = tiles.where("part = 0").select("fps").mapInArrow(linked, "a long, b long")
    across = x.join(y.hint("merge"), meet).select(F.col("x.fps").alias("x_fps"), F.col("y.fps").alias("y_fps")).mapInArrow(linked, "a long, b long")
    return inside.unionAll(across)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, root) for each row; component_id is the smallest doc_id of the rows linked to it, root
    one of their fingerprints.

    Rows link if their fingerprints differ in at most ``radius`` bits; links carry on. Equal fingerprints are one node, so copies
    cost one row each. Null or empty text: fingerprint 0, linked like any other. Null doc_id: the row gets a component, and counts for no smallest doc_id
    (null only if no member has one). Repeated rows: rows of their own in one component. Empty table: empty result.
    """
    fps = cut(fingerprints(docs, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(distinct.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    nodes = cut(distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    firsts = cut(nodes.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = nodes.join(firsts, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each group (doc_id, text_hash, root): the one with the smallest doc_id (then text hash).

    The chosen rows are written as keys, so that no text is shuffled where they are few; else texts are shuffled once. Only rows that repeat are brought together once more.
    """
    best = groups.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    best = best.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "rows")).alias("row"))
    best = table(best.select(F.col("row.doc_id").alias("k_id"), F.col("row.text_hash").alias("k_hash"), F.col("row.rows").alias("k_rows")))
    named = docs.select(*(F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns)).withColumn("hash", F.xxhash64("d_text"))
    rows = named.join(best, F.expr("d_doc_id <=> k_id and hash = k_hash")).drop("k_id", "k_hash")
    once = rows.where("k_rows = 1").unionByName(rows.where("k_rows > 1").dropDuplicates(["d_doc_id", "hash"]))
    return once.select(*(F.col(f"`d_{c}`").alias(c) for c in docs.columns))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates."""
    return one_of_each(docs, near_duplicates(docs, **settings))
