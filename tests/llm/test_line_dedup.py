"""Line dedup, its filters and its reversal against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from storyloom.llm import line_dedup as ld

DDL = "doc_id long, text string, key string, n string, chunk string, shard string, dropped string, lines string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], DDL).repartition(3)


def key_of(line):
    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    return key if len(key) >= 20 else None


def plain(rows, known=None):
    holders = defaultdict(list)
    for n, (i, text) in enumerate(rows if known is None else known):
        for key in {key_of(x) for x in (text or "").split("\n")} - {None}:
            holders[key].append(i)
    largest = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := key_of(x)) not in largest or largest[k] is None or largest[k] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def found(index, df):
    return sorted(map(tuple, ld.deduped(index, df).select("doc_id", "kept_text", "n_lines", "n_dropped").collect()), key=str)


def lines(rng, n):
    pool = [f"{'shared line number ' + str(k):<25}" for k in range(12)] + ["SHORT", "", " \t ", "Ünïcödé " * 3, "Exactly twenty chars", "x" * 19, "日本語" * 7]
    return "\n".join(pool[k].upper() if rng.random() < 0.2 else "\x0b " + pool[k] + "\r" if rng.random() < 0.2 else pool[k] for k in rng.integers(0, len(pool), n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(int(i), lines(rng, rng.integers(0, 7)) + f"\nthis line is of document {i} only") for i in rng.permutation(60)]
    out += [(None, lines(rng, 5)), (None, None), (7, lines(rng, 4)), (7, ""), out[0], out[0], (99, "\n" * 30), (98, ("only here, but many times\n" * 50))]
    return out + [(None, "held by rows without an id"), (None, "held by rows without an id"), (None, "Held by rows without an ID ")]


def test_whole_table(spark, rows):
    df = frame(spark, rows)
    assert found(ld.build(df), df) == plain(rows)
    none = df.where("false")
    assert found(ld.build(none), none) == []
    assert found(ld.build(none), df) == [(i, t or "", len((t or "").split("\n")), 0) for i, t in sorted(rows, key=lambda r: str((r[0], r[1] or "", len((r[1] or "").split("\n")), 0)))]
    hashed = ld.deduped(ld.build(df), df).select(ld.F.sha2("kept_text", 256)).collect()
    assert sorted(r[0] for r in hashed) == sorted(hashlib.sha256(x[1].encode()).hexdigest() for x in plain(rows))


def test_inserting_and_removing(spark, rows, monkeypatch):
    monkeypatch.setattr(ld, "SHARD_KEYS", 8)  # several shards, and a new layout on the way
    first, second, third = rows[:20], rows[20:45], rows[45:]
    a, b, c = (frame(spark, x) for x in (first, second, third))
    one = ld.insert(ld.empty(spark), a)
    assert found(one, a) == plain(first)
    two = ld.insert(one, b)
    assert found(two, a.unionAll(b)) == plain(first + second)
    three = ld.insert(two, c)
    assert found(three, a.unionAll(b).unionAll(c)) == plain(rows)
    assert 1 < one.shards == two.shards  # laid out anew at first, then moved in place

    gone = {i for i, _ in second[::2]} | {None, 12345}
    less = ld.remove(three, spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    left = [r for r in rows if r[0] not in gone]
    assert found(less, frame(spark, left)) == plain(left)
    back = ld.remove(three, spark.createDataFrame([(i,) for i in {i for i, _ in second + third} - {i for i, _ in first}], "doc_id long"))
    again = [r for r in rows if r[0] in {i for i, _ in first}]
    assert found(back, frame(spark, again)) == plain(again)
    counts = {(bytes(r.key), r.n, r.largest) for r in back.counts.collect()}
    assert counts == {(bytes(r.key), r.n, r.largest) for r in ld.build(frame(spark, again)).counts.collect()}
    none = ld.remove(back, spark.createDataFrame(again, "doc_id long, text string"))
    assert none.counts.count() == none.filters.count() == none.holdings.count() == 0


def test_full_filters_are_made_anew(spark):
    text = [(i, "\n".join(f"the line with number {k:06}" for k in range(n))) for i, n in enumerate((3, 3, 3, 900, 900, 900))]
    index = ld.insert(ld.build(frame(spark, text[:3])), frame(spark, text[3:]))
    assert index.filters.agg(ld.F.sum("n")).first()[0] == 900
    assert found(index, frame(spark, text)) == plain(text)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=300), st.integers(0, 7), st.integers(1, 4))
def test_filter(values, same_bits, cut):
    """Hashes that share their fingerprints, or their buckets, too."""
    hashes = np.array(values, np.uint64) & np.uint64([2**64 - 1, 2**20 - 1, 2**64 - 256, 2**50 - 1][same_bits % 4])
    hashes = np.unique(hashes)
    made = ld.Cuckoo.sized(len(hashes))
    if not made.insert(hashes):
        return
    made = ld.Cuckoo.of_bytes(made.table.tobytes())
    assert made.contains(hashes).all() and (made.table != 0).sum() == len(hashes)
    gone, left = hashes[::cut], np.setdiff1d(hashes, hashes[::cut])
    made.delete(gone)
    assert made.contains(left).all() and (made.table != 0).sum() == len(left)
    made.delete(left)
    assert not made.table.any() and made.insert(hashes) and made.contains(hashes).all()


def test_filter_lets_little_through():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 40_000, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    made = ld.Cuckoo.sized(20_000)
    assert made.insert(hashes[:20_000]) and made.contains(hashes[:20_000]).all()
    assert made.contains(hashes[20_000:]).mean() < 0.001
