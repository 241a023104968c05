"""Scans over groups of any size, chapter bodies in linear time, containment by automata, refresh of derived tables, versions of published books."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from storyloom.operators import chapters, json_audit, ledger, lexicon, recall, refresh, rollup, scan
from storyloom.sources import stores


def hot(n=3000, seed=5):
    """Rows (project, at, tie, n, failed); 95 % of them belong to one book, one book has no name."""
    r = random.Random(seed)
    return [("hot" if r.random() < 0.95 else r.choice(["a", "b", None]), r.randint(0, n), i, r.randint(0, 5), r.random() < 0.3) for i in range(n)]


def test_running_sums_of_a_hot_group(spark):
    rows = hot()
    df = spark.createDataFrame(rows, "project string, at int, tie int, n int, failed boolean")
    out = scan.running_sums(df, ["project"], ["at", "tie"], {"total": F.col("n"), "rows": F.lit(1)}, 16)
    got = {(r.project, r.tie): (r.total, r.rows) for r in out.collect()}
    want, sums = {}, {}
    for p, _, tie, n, _ in sorted(rows, key=lambda x: x[1:3]):
        total, k = sums.get(p, (0, 0))
        sums[p] = want[p, tie] = (total + n, k + 1)
    assert got == want
    parts = scan.cut_into_ranges(df, ["project"], ["at", "tie"], 16).groupBy("project", "_range").count()
    assert max(r["count"] for r in parts.collect()) < len(rows) / 6  # no range holds the hot book
    assert scan.running_sums(df.where("false"), ["project"], ["at"], {"total": F.col("n")}).count() == 0


def test_following_rows(spark):
    rows = sorted({(p, at) for p, at, *_ in hot()}, key=str)
    df = spark.createDataFrame(rows, "project string, at int")
    got = {(r.project, r.at): r.next for r in scan.following(df, ["project"], "at", "next", 16).collect()}
    want = {}
    for p in {p for p, _ in rows}:
        of = sorted(at for q, at in rows if q == p)
        want |= {(p, at): nxt for at, nxt in zip(of, [*of[1:], None], strict=True)}
    assert got == want


def test_fuse_and_ranges_of_a_hot_book(spark):
    rows = hot(1500)
    df = spark.createDataFrame([(p, at, tie, failed) for p, at, tie, _, failed in rows], "project string, seq_ts int, seq_id int, failed boolean")
    got = {r.seq_id: (r.prior_failures, r.processed, r.blown) for r in ledger.failure_fuse(df).collect()}
    seen = {}
    for p, _, tie, _, failed in sorted(rows, key=lambda x: x[1:3]):
        bad, n = seen.get(p, (0, 0))
        assert got[tie] == (bad, n + 1, bad * 10 > (n + 1) * 3)
        seen[p] = (bad + failed, n + 1)


def book(n_chapters, n_lines=20):
    return "\n".join(f"{i + 1}、t{i}\n" + "\n".join(f"line {i} {k}" for k in range(n_lines)) for i in range(n_chapters))


def test_bodies_of_many_chapters_in_linear_time(spark):
    def listed(n):
        corpora = spark.createDataFrame([("b", book(n)), ("without a list", "x"), ("short", "one\ntwo")], "project string, text string")
        ranges = [("b", i + 1, f"t{i}", 21 * i + 1, 21 * (i + 1)) for i in range(n)] + [("short", 1, "all", 0, 9), ("short", 2, "beyond", 7, 9), ("short", 3, "turned", 1, 0), ("no text", 1, "x", 0, 1)]
        return chapters.bodies_of_list(corpora, spark.createDataFrame(ranges, "project string, number int, title string, start int, end int"))

    found = {(r.project, r.number): r.body for r in listed(50).collect()}
    assert found == {("b", i + 1): "\n".join(f"line {i} {k}" for k in range(20)) for i in range(50)} | {("short", 1): "one\ntwo", ("short", 2): "", ("short", 3): ""}

    def seconds(n):
        df = listed(n).agg(F.sum("chars"))
        began = time.time()
        df.collect()
        return time.time() - began

    seconds(100)
    few, many = min(seconds(1000) for _ in range(3)), min(seconds(4000) for _ in range(3))
    assert many < 8 * few + 1

    own = chapters.bodies(spark.createDataFrame([("b", book(4000))], "project string, text string")).agg(F.count("body"), F.sum("chars"))
    assert tuple(own.first()) == (4000, sum(len("\n".join(f"line {i} {k}" for k in range(20))) for i in range(4000)))


def test_the_text_is_split_once_a_book(spark):
    corpora = spark.createDataFrame([("b", book(3))], "project string, text string")
    ranges = spark.createDataFrame([("b", 1, "t", 0, 1)], "project string, number int, title string, start int, end int")
    plan = chapters.bodies_of_list(corpora, ranges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", split(") == 1
    assert re.search(r"Generate explode.*?\), \[project#\d+\], false, \[c#", plan, re.DOTALL)  # what is exploded carries nothing but the book's name


def test_containment_in_linear_time(spark):
    r = random.Random(4)
    q = [(i, f"b{i % 3}", "".join(r.choice("abcd") for _ in range(r.randint(0, 9)))) for i in range(200)] + [(900, "b0", "x" * 50_000 + "abca"), (901, None, "ab"), (902, "none", "ab")]
    labels = [(f"b{i % 3}", f"k{i}", "".join(r.choice("abcd") for _ in range(r.randint(0, 5)))) for i in range(200)] + [("b0", "long", "y" * 50_000 + q[0][2]), ("b1", "k1", "abab")]
    queries, named = spark.createDataFrame(q, "query_id int, project string, q string"), spark.createDataFrame(labels, "project string, key string, label string")
    began = time.time()
    got = {tuple(x) for x in recall.containment(queries, named).collect()}
    assert got == {(i, p, k) for i, p, t in q for p2, k, label in labels if p == p2 and len(t) >= 2 and len(label) >= 2 and (t in label or label in t)}
    assert time.time() - began < 60


def test_groups_get_no_more_than_they_hold(spark):
    """The number of groups follows from the rows, and from the size of what each of them gets besides."""
    rows = spark.createDataFrame([("big", str(i)) for i in range(1000)] + [("small", "x")], "project string, key string")
    beside = spark.createDataFrame([("big", 500), ("other", 9)], "project string, entries int")
    assert {r.project: r.slices for r in lexicon.slices(rows, beside, 10).collect()} == {"big": 2, "small": 1}


SHOTS = "project string, chapter int, pos int, shot_id string, type string, funcs array<string>, label string, sentence_ids array<string>"


def store(spark, version):
    """Three books; between versions one chapter changes, one comes and one goes in the first, the second goes, the third stays."""
    r = random.Random(11)
    rows, files = [], []
    for b, n in (("one", 12), ("two", 6), ("three", 6)):
        for ch in range(1, n + 1):
            text = "".join(r.choice("甲乙丙丁戊，") for _ in range(60))
            changed = b == "one" and ch == 3
            if (b == "two" and version == 2) or (b == "one" and ch == (5, 8)[version - 1]):
                continue
            rows += [(b, ch, k, (text[::-1] if changed and version == 2 else text)[20 * k : 20 * k + 20]) for k in range(3)]
            files.append((b, ch, f"{version if changed else 0}", "0"))
    sentences = spark.createDataFrame([(b, ch, k, f"S{k}", t) for b, ch, k, t in rows], "project string, chapter int, pos int, sid string, text string")
    shots = spark.createDataFrame([(b, ch, k, str(k), "x", ["y"], t[:3].strip("，"), [f"S{k}"]) for b, ch, k, t in rows], SHOTS)
    return shots, sentences, spark.createDataFrame(files, "project string, chapter int, shot_mtime string, sent_mtime string")


def test_refresh_equals_a_full_build(spark):
    (old_shots, old, then), (shots, sentences, now) = (store(spark, v) for v in (1, 2))
    stored = refresh.built(old_shots, old)
    changed = refresh.changed_chapters(now, then)
    assert {tuple(r) for r in changed.collect()} == {("one", 3, True, True), ("one", 5, False, True), ("one", 8, True, False)} | {("two", ch, True, False) for ch in range(1, 7)}
    got, want = refresh.refreshed(stored, shots, sentences, old, changed), refresh.built(shots, sentences)
    for a, b in ((got.unigrams, want.unigrams), (got.bigrams, want.bigrams), (got.words, want.words)):
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    same = refresh.refreshed(stored, old_shots, old, old, refresh.changed_chapters(then, then))
    assert sorted(map(tuple, same.words.collect())) == sorted(map(tuple, stored.words.collect()))


def test_refreshed_vectors_embed_only_what_changed(spark):
    inputs = spark.createDataFrame([("b", ch, str(k), f"text {ch if ch < 3 else 0} {k}") for ch in range(1, 5) for k in range(2)], "project string, chapter int, shot_id string, input string")
    stored = spark.createDataFrame([("b", ch, "0", [float(-ch)]) for ch in (1, 2, 9)], "project string, chapter int, shot_id string, embedding array<float>")
    plan = spark.createDataFrame([("b", 1, False), ("b", 2, True), ("b", 3, True), ("b", 4, True)], "project string, chapter int, rebuild boolean")
    made = spark.sparkContext.accumulator(0)

    def embed(batch):
        made.add(len(batch))
        return [[float(len(t))] for t in batch]

    got = sorted((r.chapter, r.shot_id, r.embedding[0]) for r in refresh.refreshed_vectors(stored, plan, inputs, embed).collect())
    assert got == [(1, "0", -1.0), (2, "0", 8.0), (2, "1", 8.0), (3, "0", 8.0), (3, "1", 8.0), (4, "0", 8.0), (4, "1", 8.0)]
    assert made.value == 4  # chapters 3 and 4 share their texts


def test_a_failed_publish_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "books")
    rows = lambda version, books: spark.createDataFrame([(b, ch, version) for b in books for ch in range(4)], "project string, chapter int, v int")
    read = lambda: sorted({(r.project, r.v) for r in stores.read_published(spark, path).collect()})
    stores.publish(rows(1, ["007", "b/c d", "书"]), path)
    assert read() == [("007", 1), ("b/c d", 1), ("书", 1)]
    broken = rows(2, ["007", "书", "z"]).withColumn("v", F.when(F.col("project") == "z", F.raise_error("lost").cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        stores.publish(broken, path)
    # as if the data had been written and the run had ended before the manifest
    rows(2, ["007"]).withColumn("folder", F.lit("v2@007")).write.mode("append").partitionBy("folder").parquet(f"{path}/data")
    assert read() == [("007", 1), ("b/c d", 1), ("书", 1)]
    stores.publish(rows(3, ["007", "new"]), path)
    assert read() == [("007", 3), ("b/c d", 1), ("new", 3), ("书", 1)]
    assert stores.read_published(spark, path).count() == 16


def test_the_json_prefilter_takes_only_valid_objects(spark):
    r = random.Random(6)
    parts = ['{"a":', '"b":', "1", "-0.5e3", "01", "{", "}", "[", "]", ",", ":", '"x"', "true", "null", " ", '"\\u00e9"', "nul", "{}", '{"a":1}', '"\\ud800"', "\t", "\n", '"a\nb"', "NaN", "'", "//", "1.", '"a":2', '{"a":{"b":[1,{}]}}']
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(4000)] + ['{"a":1,"\\u0061":2}', '{"x":1,"x":1}', "{}]x}", "{}}x", "{},", '{},"y":{}', "﻿{}", " {} ", None, '{"a":1} // c', '{"a":"\x7f "}']
    found = json_audit.audited(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("taken", json_audit.is_object(F.col("text")))).collect()
    assert all(row.valid == (json_audit.audit(row.text) is None) for row in found)
    valid = [row for row in found if row.valid]
    assert len(valid) > 50 and sum(row.taken for row in valid) > 0.9 * len(valid)
    assert all((row.kind, row.offset) == json_audit.audit(row.text) for row in found if not row.valid)


def test_batches_are_compared_without_lists(spark):
    fresh = spark.createDataFrame([(p, n) for p in "abcde" for n in (1, 2, 2, 3)], "project string, number int")
    states = spark.createDataFrame([("a", [3, 1, 2], "t1"), ("b", [1, 2], "t2"), ("c", [1, 2, 4], "t3"), ("d", [1, 2, 3, 3], "t4")], "project string, batch array<int>, temp_ts string")
    assert {r.project: r.temp_ts for r in rollup.reentered(fresh, states).collect()} == {"a": "t1", "b": None, "c": None, "d": None, "e": None}
