"""Stupid-backoff scores: counts of n-grams summed in slices of their hashes, joined back to the corpus's own n-grams piece by piece, summed by document."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import table
from storyloom.sources.checkpoints import table_alone

ORDER = 3
ALPHA = 0.4
LEAST_COUNT = 2  # an n-gram counts as seen from here on; each text is in the corpus itself, so a count of one says nothing
CHUNK_TOKENS = 250_000
ROWS_SENT = 20_000
SLICE_GRAMS = 2_000_000
ROUNDS = 4
_FIRST = np.uint64(1)  # stands before the first word


def word_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each white-space separated word of the lower-cased text."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def longer(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of all but its last word and of all but its first."""
    x = (context ^ (context >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + suffix
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pieces_of(docs: DataFrame) -> DataFrame:
    """(piece, tokens, doc_ids, lengths, words, at): rows of some ``CHUNK_TOKENS`` words, or ``ROWS_SENT`` texts. Words are the piece's distinct hashes, ``at`` is the place among them of each word of its texts."""
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    kind = T.StructType().add("tokens", T.IntegerType()).add("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)).add("lengths", ints).add("words", longs).add("at", ints)

    def packed(ids: list[pa.Scalar], held: list[np.ndarray]) -> pa.RecordBatch:
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        lengths = np.array([len(x) for x in held], np.int32)
        columns = [pa.array([x.as_py() for x in ids], ids[0].type), pa.array(lengths), pa.array(words.view(np.int64)), pa.array(at.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns)], names=kind.names)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, tokens = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id)
                held.append(word_hashes(text.as_py()))
                tokens += len(held[-1])
                if tokens >= CHUNK_TOKENS or len(held) >= ROWS_SENT:
                    yield packed(ids, held)
                    ids, held, tokens = [], [], 0
        if held:
            yield packed(ids, held)

    rows = docs.select("doc_id", "text").mapInArrow(laid, kind)
    return rows.select(F.monotonically_increasing_id().alias("piece"), "*")


def values(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def grams_of(lengths: np.ndarray, words: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Lays texts out one after the other, each behind its start signs. For each word its place and its text; for n from 1 to ``order`` the hash of the n-gram that ends at each place, and
    the places whose n-gram is counted: those of words, and of the last start sign where its n-gram is the context of a first word."""
    filled = np.flatnonzero(lengths)
    sizes = lengths[filled]
    nth = np.repeat(np.arange(len(filled)), sizes)
    places = np.arange(len(words)) + (order - 1) * (nth + 1)
    padded = np.full(len(words) + (order - 1) * len(filled), _FIRST)
    padded[places] = words
    starts = np.cumsum(sizes, dtype=np.int64) - sizes + (order - 1) * np.arange(len(filled))
    grams, counted = [padded], []
    for _ in range(order - 1):
        suffix = grams[-1]
        grams.append(longer(np.concatenate((np.zeros(min(1, len(suffix)), np.uint64), suffix[:-1])), suffix))
    for size in range(1, order + 1):
        here = np.ones(len(padded), bool)
        for k in range(order - 1 if size == order else order - 2):
            here[starts + k] = False
        counted.append(np.flatnonzero(here))
    return places, filled[nth], grams, counted


def slice_ends(slices: int) -> np.ndarray:
    """The first hash of each slice but slice 0, where the hashes are cut into equal ranges."""
    return np.array([-(-(k << 64) // slices) for k in range(1, slices)], np.uint64)


def grams_sent(pieces: DataFrame, order: int, slices: int, mine: range) -> DataFrame:
    """(slice, piece, grams, n): each piece's different n-grams up to ``order`` words in the slices ``mine``, ascending, and how often the piece holds them."""
    names = ["slice", "piece", "grams", "n"]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = slice_ends(slices)
        inner = ends[mine.start : mine.stop - 1]
        for batch in batches:
            for row, piece in enumerate(batch.column(0).to_pylist()):
                lengths, words, at = (values(batch.column(k), row) for k in (1, 2, 3))
                _, _, grams, counted = grams_of(lengths, words.view(np.uint64)[at], order)
                all_grams = np.concatenate([gram[places] for gram, places in zip(grams, counted, strict=True)])
                if mine.start > 0:
                    all_grams = all_grams[all_grams >= ends[mine.start - 1]]
                if mine.stop < slices:
                    all_grams = all_grams[all_grams < ends[mine.stop - 1]]
                found, n = np.unique(all_grams, return_counts=True)
                sizes = np.diff(np.searchsorted(found, inner), prepend=0, append=len(found))
                some = np.flatnonzero(sizes)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[some]))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (found.view(np.int64), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array((some + mine.start).astype(np.int32)), pa.array(np.full(len(some), piece)), *lists], names=names)

    return pieces.select("piece", "lengths", "words", "at").mapInArrow(sent, "slice int, piece long, grams array<long>, n array<int>")


def summed(sent: DataFrame) -> DataFrame:
    """(piece, slice, n): for each piece's n-grams in a slice, in the order in which they were sent, how often all pieces hold them."""

    def counts(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        grams, n = rows.column("grams").combine_chunks(), rows.column("n").combine_chunks()
        found, which = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        every = np.bincount(which, n.flatten().to_numpy(), len(found)).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(grams).to_numpy()))).astype(np.int32)
        return pa.table([rows.column("piece"), rows.column("slice"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(every[which]))], names=["piece", "slice", "n"])

    return sent.groupBy("slice").applyInArrow(counts, "piece long, slice int, n array<long>")


def scored(pieces: DataFrame, counts: DataFrame, dealt: int, total: int, order: int, alpha: float, least: int) -> DataFrame:
    """(doc_id, n_tokens, log_score) of each text of the pieces, which meet the counts of their own n-grams in ``dealt`` partitions."""
    names = ["doc_id", "n_tokens", "log_score"]

    def log_scores(lengths: np.ndarray, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        places, texts, grams, counted = grams_of(lengths, words, order)
        found, which = np.unique(np.concatenate([gram[here] for gram, here in zip(grams, counted, strict=True)]), return_inverse=True)
        if len(found) != len(n):
            raise ValueError(f"{len(found)} n-grams have {len(n)} counts")
        counts, at = [], 0
        for gram, here in zip(grams, counted, strict=True):
            counts.append(np.zeros(len(gram), np.int64))
            counts[-1][here] = n[which[at : at + len(here)]]
            at += len(here)
        score = np.log(counts[0][places] / max(1, total)) + (order - 1) * math.log(alpha)
        for size in range(2, order + 1):
            seen = np.flatnonzero(counts[size - 1][places] >= least)
            ends = places[seen]
            score[seen] = np.log(counts[size - 1][ends] / counts[size - 2][ends - 1]) + (order - size) * math.log(alpha)
        return np.bincount(texts, score, len(lengths)).astype(np.float64)  # of no words at all it makes integers

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, words, at = (values(batch.column(k), row) for k in (1, 2, 3))
                n = np.zeros(0, np.int64)
                if batch.column(4)[row].is_valid:  # else none of the piece's texts has a word
                    got = batch.column(4)[row].values
                    n = got.field(1).take(pa.array(np.argsort(got.field(0).to_numpy()))).flatten().to_numpy()
                scores = log_scores(lengths, words.view(np.uint64)[at], n)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, pa.array(lengths.astype(np.int64)), pa.array(scores)], names=names)

    kind = T.StructType().add("doc_id", pieces.schema["doc_ids"].dataType.elementType).add("n_tokens", T.LongType()).add("log_score", T.DoubleType())
    answers = counts.repartition(dealt, "piece").groupBy("piece").agg(F.collect_list(F.struct("slice", "n")).alias("answers"))
    met = pieces.repartition(dealt, "piece").join(answers, "piece", "left")
    return met.select("doc_ids", "lengths", "words", "at", "answers").mapInArrow(each, kind)


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST_COUNT) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) for each row, under the model of all rows' n-grams up to ``order`` words.

    S(w | u v) = n(u v w) / n(u v) if n(u v w) >= least, else alpha * S(w | v); S(w | v) = n(v w) / n(v) if n(v w) >= least, else alpha * n(w) / N. Logarithms are natural;
    start signs stand before the first word. Words are lower-cased and white-space separated, a word and an n-gram are their 64-bit hashes. Counts cover all rows and are exact.

    Texts are hashed once, into a table of pieces. A piece sends each of its different n-grams once, to the slice of its hash; slices hold some ``SLICE_GRAMS`` n-grams, and a frequent
    n-gram comes once from each piece that has it. Counts go back to the pieces in the order in which they were asked for, without the hashes. A context or a suffix of a piece's n-gram is in the
    piece itself, so this is all that its scores need. The slices are counted in up to ``ROUNDS`` queries, and the pieces are scored in as many, the last when the result is read; what one of them
    shuffled is deleted before the next, so the disk holds a part of it at a time.

    Null and empty texts: n_tokens 0, log_score 0, mean null. Null doc_id: kept. Repeated rows: rows of their own with equal scores, and counted as
    often as they occur. Empty table: empty result.
    """
    pieces = table(pieces_of(docs), maxRecordsPerFile=8)
    total, n_pieces = pieces.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    slices = 1 + order * total // SLICE_GRAMS
    rounds = min(ROUNDS, slices)
    ends = [k * slices // rounds for k in range(rounds + 1)]
    counts = reduce(DataFrame.unionByName, [table_alone(summed(grams_sent(pieces, order, slices, range(a, b)))) for a, b in zip(ends, ends[1:], strict=False)])
    dealt = 1 + n_pieces // (4 * rounds)  # a few pieces a task, whatever their compressed size
    mine = F.pmod(F.xxhash64("piece"), F.lit(rounds))
    shares = [scored(pieces.where(mine == k), counts.where(mine == k), dealt, total, order, alpha, least) for k in range(rounds)]
    each = reduce(DataFrame.unionByName, [*map(table_alone, shares[1:]), shares[0]])
    return each.select("doc_id", "n_tokens", "log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log_score"))
