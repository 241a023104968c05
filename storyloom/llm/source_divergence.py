"""Source divergence audit: how far the word shares of a language's sources lie apart, and which words each source has more of than its language.

Run-length columns: a language's vocabulary is dealt over slices. In a slice the terms are put in an order that brings equal counts together, each
source's counts are encoded as runs, and two sources are compared run by run: the runs' boundaries are merged, and each
stretch between two of them adds its term of the sum times its length. Terms that few sources use cost next to nothing that way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import table

#: A term is kept from so many documents of its language on; shares are whole numbers of this unit; terms that are reported of a source.
LEAST_DOCS, UNIT, TOP = 10, 1_000_000_000, 10
#: Terms of a slice; terms that a task counts before it hands its counts on.
SLICE_TERMS, HELD_TERMS = 4096, 400_000

#: Every byte outside a term becomes a space, A-Z become a-z. Bytes of characters beyond ASCII stay.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII, with A-Z in lower case, in UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def counted(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed up within a task, so that what is shuffled grows with the distinct terms."""

    def batch_of(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in counts.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array([t.decode() for t in n]), pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())], schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                n, d = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                found = terms(text.as_py())
                n.update(found)
                d.update(set(found))
            if sum(len(n) for n, _ in counts.values()) > held:
                yield from batch_of(counts)
                counts = {}
        yield from batch_of(counts)

    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exactly."""
    wide = "decimal(20,0)"
    return F.lit(1) + F.call_function("div", (n + 2).cast(wide) * F.lit(UNIT).cast("decimal(10,0)"), (total + 2 * terms).cast(wide))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); the square of a difference of two shares fits into a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def runs(counts: np.ndarray) -> np.ndarray:
    """Where runs of equal counts start."""
    return np.concatenate([[0], np.flatnonzero(np.diff(counts)) + 1])


def compared(counts: np.ndarray, below: list[int]) -> Iterator[tuple[int, int, int]]:
    """(i, j, sum) for i < j: the sum of gaps over all columns of two rows. ``counts``: a row for each source; ``below``: the divisors of their shares."""
    ordered = counts[:, np.lexsort(counts[np.argsort(np.count_nonzero(counts, axis=1))])]  # the row with most terms decides first
    starts = [runs(row) for row in ordered]
    shares = [np.array([1 + UNIT * (n + 2) // under for n in row[at].tolist()], np.int64) for row, at, under in zip(ordered, starts, below, strict=True)]
    width = counts.shape[1]
    for i in range(len(starts)):
        for j in range(i + 1, len(starts)):
            cuts = np.union1d(starts[i], starts[j])
            p = shares[i][np.searchsorted(starts[i], cuts, side="right") - 1]
            q = shares[j][np.searchsorted(starts[j], cuts, side="right") - 1]
            yield i, j, int(((p - q) ** 2 // (p + q) * np.diff(cuts, append=width)).sum())


def _slice_sums(rows: pa.Table, sources: pa.Table) -> pa.Table:
    """Both directions of all pairs of a language's sources, over the terms of one slice."""
    names = sources.column("of_source").to_pylist()
    place = {s: k for k, s in enumerate(names)}
    coded = rows.column("term").combine_chunks().dictionary_encode()
    counts = np.zeros((len(names), len(coded.dictionary)), np.int64)
    counts[[place[s] for s in rows.column("source").to_pylist()], coded.indices.to_numpy()] = rows.column("n").to_numpy()
    found = list(compared(counts, sources.column("under").to_pylist())) if rows.num_rows else []
    a, b, value = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
    one, other = ([names[i] for i in x] for x in (a, b))
    lang = sources.column("of_lang")[0].as_py() if sources.num_rows else None
    return pa.table({"lang": pa.array([lang] * (2 * len(value)), pa.string()), "source": pa.array(one + other, pa.string()), "item": pa.array(other + one, pa.string()), "value": pa.array(value * 2, pa.int64())})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, slice_terms: int = SLICE_TERMS, held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: the gap to each other source of the language over all kept terms. Part ``term``: the
    ``top`` terms of which the source has a larger share than its language. Ranks count from 1 by value, largest first, then by item in UTF-8.

    A language's terms are dealt by hash over slices of about ``slice_terms``, so neither a language nor a source with a third of all rows makes a
    large group. A slice holds a number for each of its terms and each source of the language; the pairs of sources are the result itself.
    All numbers are exact.

    Null text, lang and source: ''. A document is a row, so repeated rows count again. A language without kept terms: pairs of value 0, no terms.
    Sources without terms are compared like others. A language with one source has no pairs. Other columns are left out. Empty table: empty result.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    sums = counted(docs, held).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # at most a row for each source
    wide = sums.select("*", F.sum("docs").over(of_term).alias("term_docs"), F.sum("n").over(of_term).alias("lang_n"), (F.col("source") == F.min("source").over(of_term)).alias("first"))
    kept = table(wide.where(F.col("term_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"))

    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    groups = table(named.distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "lang_total", "terms"]))

    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    most = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    slots = groups.where("terms > 0").select("lang", "source", (F.col("total") + 2 * F.col("terms")).alias("under"), F.ceil(F.col("terms") / slice_terms).cast("int").alias("slots"))
    dealt = kept.join(slots.select("lang", "slots").distinct(), "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), "slots").cast("int").alias("slot"))
    repeated = slots.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "under", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    parts = dealt.groupBy("lang", "slot").cogroup(repeated.groupBy("of_lang", "slot")).applyInArrow(_slice_sums, "lang string, source string, item string, value long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")
    nothing = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = summed.unionByName(nothing).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(most)
