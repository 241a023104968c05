"""Line dedup that can be taken back: exact reference counts of lines in shards, with a cuckoo filter over each shard's common lines.

A line's key is its text without white space at the ends and with A-Z in lower case, as a 128-bit hash. A key is common if enough
documents hold it; common lines stay only in the largest doc_id that holds them. The filters settle most lines without a look at the counts; what they let
through is checked against the exact counts, so a filter's false hits change nothing. Inserting or removing documents moves counts, and keys that become
common, or cease to be, are put into or deleted from their shard's filter. A filter that is full is made anew, larger, from the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import table

#: Code points from which a key counts; documents from which it is common.
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Distinct keys for a shard, on average, when an index is laid out; bytes of keys that make a chunk of documents.
SHARD_KEYS, CHUNK_BYTES = 20_000, 1_000_000

_BLANKS = b" \t\n\x0b\x0c\r"
_HELD = "chunk long, doc_id long, text_hash long, keys array<binary>"


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, each in one of two buckets, found from the other by the fingerprint alone. Works on arrays of 64-bit hashes."""

    SLOTS, FILL, ROUNDS = 4, 0.8, 500

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        return cls(np.zeros((1 << max(2, int(np.ceil(np.log2(n / cls.SLOTS / cls.FILL + 1)))), cls.SLOTS), np.uint16))

    @classmethod
    def of_bytes(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy())

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (print_.astype(np.int64) * 0x5BD1E995 >> 8) & len(self.table) - 1

    def _placed(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        print_ = np.maximum(hashes >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return (hashes & np.uint64(len(self.table) - 1)).astype(np.int64), print_

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        at, print_ = self._placed(hashes)
        return ((self.table[at] == print_[:, None]) | (self.table[self._other(at, print_)] == print_[:, None])).any(axis=1)

    def _take(self, at: np.ndarray, print_: np.ndarray, sought: np.ndarray, put: np.ndarray) -> np.ndarray:
        """Put ``put`` where a bucket holds ``sought``, in either bucket, once a bucket; says which found a place."""
        done = np.zeros(len(at), bool)
        for bucket in (at, self._other(at, print_)):
            fits = self.table[bucket] == sought[:, None]
            may = np.flatnonzero(fits.any(axis=1) & ~done)
            may = may[np.unique(bucket[may], return_index=True)[1]]
            self.table[bucket[may], fits[may].argmax(axis=1)] = put[may]
            done[may] = True
        return done

    def insert(self, hashes: np.ndarray) -> bool:
        """Whether all found a place; if not, the filter is to be made anew."""
        at, print_ = self._placed(hashes)
        for turn in range(self.ROUNDS):
            left = ~self._take(at, print_, np.zeros_like(print_), print_)
            at, print_ = at[left], print_[left]
            if not len(at):
                return True
            full = np.flatnonzero((self.table[at] != 0).all(axis=1) & (self.table[self._other(at, print_)] != 0).all(axis=1))
            full = full[np.unique(at[full], return_index=True)[1]]
            slot = (print_[full].astype(np.int64) + turn) % self.SLOTS
            out = self.table[at[full], slot]
            self.table[at[full], slot] = print_[full]
            print_[full] = out
            at[full] = self._other(at[full], out)
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Each hash must have been inserted."""
        at, print_ = self._placed(hashes)
        while len(at):
            done = self._take(at, print_, print_, np.zeros_like(print_))
            if not done.any():
                raise ValueError("deleted what the filter doesn't hold")
            at, print_ = at[~done], print_[~done]


def _hashes(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The first halves of the keys."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64)[::2] if len(keys) else np.zeros(0, np.uint64)


def line_key(line: bytes, least_chars: int = LEAST_CHARS) -> bytes | None:
    """The hash of a line's key; none for keys that are too short to count."""
    key = line.strip(_BLANKS).lower()  # of bytes: A-Z only
    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode()) < least_chars:
        return None
    return xxhash.xxh3_128_digest(key)


@dataclass
class Index:
    """``holdings``: (chunk, doc_id, text_hash, keys by line) of the documents; ``counts``: (shard, key, n, largest), exact; ``filters``: (shard, n, raw) of the shards with common keys."""

    holdings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int
    least_chars: int


def _held(docs: DataFrame, least_chars: int) -> DataFrame:
    """Keys of each document by line, in chunks of documents that lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            chunks, keys = [], []
            for text in batch.column(2):
                keys.append([line_key(x, least_chars) for x in (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")])
                chunks.append(chunk)
                size += 16 * len(keys[-1])
                if size >= CHUNK_BYTES:
                    chunk, size = chunk + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.binary()))], names=["chunk", "doc_id", "text_hash", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, _HELD)


def _references(holdings: DataFrame) -> DataFrame:
    """(key, n, largest): how many documents hold each key, and the largest of their doc_ids."""
    rows = holdings.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("largest"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _made(keys: pa.Table) -> pa.Table:
    """A shard's filter, from all its common keys."""
    hashes, n = _hashes(keys.column("key")), keys.num_rows
    made, room = Cuckoo.sized(n), n
    while not made.insert(hashes):
        room = 2 * room + 4
        made = Cuckoo.sized(room)
    return pa.table({"shard": keys.column("shard")[:1], "n": pa.array([n], pa.int64()), "raw": pa.array([made.table.tobytes()])})


def _filters(counts: DataFrame, least_docs: int) -> DataFrame:
    return counts.where(F.col("n") >= least_docs).select("shard", "key").groupBy("shard").applyInArrow(_made, "shard int, n long, raw binary")


def _laid_out(holdings: DataFrame, references: DataFrame, least_docs: int, least_chars: int) -> Index:
    shards = max(1, -(-references.count() // SHARD_KEYS))
    counts = table(references.select(_shard(shards).alias("shard"), "key", "n", "largest"))
    return Index(holdings, counts, table(_filters(counts, least_docs)), shards, least_docs, least_chars)


def build(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> Index:
    """An index of documents. Keys are counted with partial sums before the shuffle, so a line that all documents share is a row a task."""
    holdings = table(_held(docs, least_chars))
    return _laid_out(holdings, table(_references(holdings)), least_docs, least_chars)


def empty(spark: SparkSession, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> Index:
    return build(spark.createDataFrame([], "doc_id long, text string"), least_docs, least_chars)


def _moved(index: Index, counts: DataFrame) -> Index:
    """``index`` with new counts: (shard, key, n, largest, before). Shards' filters follow the keys that became common or ceased to be."""
    least = index.least_docs
    turned = counts.where((F.col("n") >= least) != (F.col("before") >= least)).select("shard", "key", (F.col("n") >= least).alias("add"))

    def follow(filters: pa.Table, keys: pa.Table) -> pa.Table:
        """No bytes: to be made anew."""
        shard = (filters if filters.num_rows else keys).column("shard" if filters.num_rows else "of_shard")[:1]
        made = Cuckoo.of_bytes(filters.column("raw")[0].as_py()) if filters.num_rows else Cuckoo.sized(0)
        add = keys.column("add").to_numpy(zero_copy_only=False).astype(bool)
        hashes = _hashes(keys.column("key"))
        n = (filters.column("n")[0].as_py() if filters.num_rows else 0) + int(add.sum()) - int((~add).sum())
        made.delete(hashes[~add])
        fits = n <= made.table.size * Cuckoo.FILL and made.insert(hashes[add])
        return pa.table({"shard": shard, "n": pa.array([n], pa.int64()), "raw": pa.array([made.table.tobytes() if fits else None], pa.binary())})

    keys = turned.withColumnRenamed("shard", "of_shard")
    followed = table(index.filters.groupBy("shard").cogroup(keys.groupBy("of_shard")).applyInArrow(follow, "shard int, n long, raw binary"))
    full = followed.where("raw is null").select("shard")
    kept = counts.where("n > 0").select("shard", "key", "n", "largest")
    filters = table(followed.where("raw is not null and n > 0").unionByName(_filters(kept.join(full, "shard", "left_semi"), least)))
    return Index(index.holdings, kept, filters, index.shards, least, index.least_chars)


def insert(index: Index, docs: DataFrame) -> Index:
    """The index with more documents. Ids that it knows already are documents of their own. An index whose shards have grown to twice their size is laid out anew."""
    new = table(_held(docs, index.least_chars))
    more = _references(new).select(_shard(index.shards).alias("shard"), "key", F.col("n").alias("more"), F.col("largest").alias("later"))
    moved = index.counts.join(more, ["shard", "key"], "full_outer")
    before = F.coalesce("n", F.lit(0))
    counts = table(moved.select("shard", "key", (before + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("largest", "later").alias("largest"), before.alias("before")))
    shift = index.holdings.agg(F.coalesce(F.max("chunk") + 1, F.lit(0)).alias("shift"))  # one row
    holdings = index.holdings.unionByName(new.join(F.broadcast(shift)).withColumn("chunk", F.col("chunk") + F.col("shift")).drop("shift"))
    grown = Index(holdings, index.counts, index.filters, index.shards, index.least_docs, index.least_chars)
    if counts.count() > 2 * SHARD_KEYS * index.shards:
        return _laid_out(grown.holdings, counts.select("key", "n", "largest"), index.least_docs, index.least_chars)
    return _moved(grown, counts)


def remove(index: Index, ids: DataFrame) -> Index:
    """The index without the documents whose doc_id is in ``ids`` (doc_id; a null id removes documents without one). Unknown ids do nothing.
    The largest holder is looked up again only for keys that have lost theirs."""
    ids = ids.select(F.col("doc_id").cast("long").alias("gone_id")).distinct()
    gone = F.col("doc_id").eqNullSafe(F.col("gone_id"))
    left, less = table(index.holdings.join(ids, gone, "left_anti")), _references(index.holdings.join(ids, gone, "left_semi"))
    less = less.select("key", F.col("n").alias("less"), F.col("largest").alias("lost"))
    moved = table(index.counts.join(less, "key", "left"))
    orphans = moved.where("n > less and lost <=> largest").select("key")
    heirs = _references(left).join(orphans, "key", "left_semi").select("key", F.col("largest").alias("heir"), F.lit(True).alias("orphan"))
    counts = moved.join(heirs, "key", "left").select("shard", "key", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), F.when(F.col("orphan"), F.col("heir")).otherwise(F.col("largest")).alias("largest"), F.col("n").alias("before"))
    return _moved(Index(left, index.counts, index.filters, index.shards, index.least_docs, index.least_chars), table(counts))


def _asked(holdings: DataFrame, shards: int) -> DataFrame:
    """(shard, chunk, key): each chunk asks once for a key in a batch, so a line that all documents share isn't a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_chunk: dict[int, set[bytes]] = {}
            for chunk, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of_chunk.setdefault(chunk, set()).update(k for k in keys if k is not None)
            rows = [(c, k) for c, keys in of_chunk.items() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.binary())], names=["chunk", "key"])

    return holdings.select("chunk", "keys").mapInArrow(run, "chunk long, key binary").select(_shard(shards).alias("shard"), "chunk", "key")


def drops(index: Index) -> DataFrame:
    """(doc_id, text_hash, dropped by line) of the index's documents that lose a line, one row for equal documents."""

    def let_through(asked: pa.Table, filters: pa.Table) -> pa.Table:
        hit = Cuckoo.of_bytes(filters.column("raw")[0].as_py()).contains(_hashes(asked.column("key"))) if filters.num_rows else np.zeros(asked.num_rows, bool)
        return asked.select(["chunk", "key"]).filter(pa.array(hit))

    filters = index.filters.select(F.col("shard").alias("of_shard"), "raw")
    maybe = _asked(index.holdings, index.shards).groupBy("shard").cogroup(filters.groupBy("of_shard")).applyInArrow(let_through, "chunk long, key binary")
    common = index.counts.where(F.col("n") >= index.least_docs).select("key", "largest")
    answers = maybe.distinct().join(common, "key").select(F.col("chunk").alias("of_chunk"), "key", "largest")

    def decide(held: pa.Table, found: pa.Table) -> pa.Table:
        largest = dict(zip(found.column("key").to_pylist(), found.column("largest").to_pylist(), strict=True))
        rows = {}
        if largest:
            for i, text_hash, keys in zip(*(held.column(c).to_pylist() for c in ("doc_id", "text_hash", "keys")), strict=True):
                dropped = [k in largest and largest[k] is not None and largest[k] != i for k in keys]
                if any(dropped):
                    rows[i, text_hash] = dropped
        return pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text_hash": pa.array([h for _, h in rows], pa.int64()), "dropped": pa.array(list(rows.values()), pa.list_(pa.bool_()))})

    rows = index.holdings.select("chunk", "doc_id", "text_hash", "keys").groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(decide, "doc_id long, text_hash long, dropped array<boolean>")
    return rows.groupBy("doc_id", "text_hash").agg(F.first("dropped").alias("dropped"))  # equal rows drop the same lines


def deduped(index: Index, docs: DataFrame) -> DataFrame:
    """(doc_id, kept_text, n_lines, n_dropped) of ``docs`` by an index that holds them; documents that it doesn't hold lose nothing.

    Lines end at line feeds; the other lines stay as they are, joined by line feeds. A document with the largest doc_id keeps all lines of the key, repeated
    ones too; so do all rows with that doc_id. Null text: one empty line. Null doc_id: counts as a document and is smaller than any id; if no holder has an id, all
    keep the line. Repeated rows count as documents. Other columns are left out. Empty table: empty result.
    """
    found = table(drops(index)).select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), "dropped")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
    rows = rows.select("doc_id", F.split("text", "\n", -1).alias("lines"), "dropped")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda _, i: ~F.get("dropped", i)))
    n_dropped = F.coalesce(F.size(F.filter("dropped", lambda x: x)), F.lit(0))
    return rows.select("doc_id", F.array_join(kept, "\n").alias("kept_text"), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(n_dropped).cast("long").alias("n_dropped"))
