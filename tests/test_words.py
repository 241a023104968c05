"""Trees of words and what streams past them: sizes, and the same finds as plain Python."""

import hashlib
import pickle
import random
from collections import Counter

import numpy as np

from storyloom.operators import lexicon, recall


def test_size_of_a_tree():
    r = random.Random(1)
    words = {"".join(r.choices("abcdefghij甲乙𠀀", k=8)) for _ in range(5000)}
    assert len(pickle.dumps(lexicon.automaton_of(words))) < 10 * sum(map(len, words))


def test_texts_stream_past_a_tree(spark, monkeypatch):
    """Counts of a key come together, whatever its texts; groups hold more texts than a piece, and a book may be without words."""
    r = random.Random(2)
    words = [(b, "".join(r.choices("甲乙a", k=r.randint(1, 4)))) for b in ("x", "y") for _ in range(20)] + [("x", "甲" * 30)]
    texts = [(r.choice("xyz"), f"k{r.randint(0, 40)}", "".join(r.choices("甲乙ab", k=r.randint(0, 60)))) for _ in range(150)] + [("x", "k1", None), ("x", "k1", "甲" * 70)]
    want = Counter()
    for b, k, t in texts:
        for _, w in {x for x in words if x[0] == b}:
            want[b, k, w] += sum((t or "").startswith(w, i) for i in range(len(t or "")))
    books, held = spark.createDataFrame(texts, "project string, key string, text string"), spark.createDataFrame(words, "project string, word string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = lexicon.contained(books, held, 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({(x.project, x.key, x.token) for x in got})
    assert {(x.project, x.key, x.token): x.n for x in got} == {k: n for k, n in want.items() if n}


def test_queries_stream_past_bounded_groups_of_shots(spark, monkeypatch):
    """Groups that are far smaller than a book's queries give the same counts and hits as one group."""
    r = random.Random(4)
    shots = [("b", i // 5, i, str(i), "".join(r.choices("甲乙丙", k=4))) for i in range(60)]
    s = spark.createDataFrame(shots, "project string, chapter int, pos int, shot_id string, label string")
    t = s.withColumnRenamed("label", "text")
    q = spark.createDataFrame([(f"q{i}", "b", "".join(r.choices("甲乙丙丁", k=3))) for i in range(50)], "query_id string, project string, text string")
    w = spark.createDataFrame([("b", x + y) for x in "甲乙丙" for y in "甲乙丙"], "project string, word string")

    def rows() -> list:
        return [sorted(map(tuple, f(q, s, t, w).collect())) for f in (recall.token_counts, recall.token_hits)]

    want = rows()
    monkeypatch.setattr(recall, "GROUP_WORDS", 1)
    monkeypatch.setattr(recall, "MOST_WORDS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert rows() == want and len(want[0]) > 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sentences_packed_in_rows(spark, monkeypatch):
    """Rows of many sentences give the counts, bonds and words of a row each; no sentence is divided and none runs on into the next."""
    r = random.Random(5)
    wide = [chr(0x4E00 + i) for i in range(400)] + ["𠀀", "a", "的"]
    texts = [(r.choice("xy"), "".join(r.choices(wide if i % 2 else wide[:8], k=r.randint(0, 40)))) for i in range(400)] + [("x", None), (None, "甲乙 甲，乙\n甲乙"), ("x", "甲" * 300), ("x", "， \n")]
    s = spark.createDataFrame(texts, "project string, text string")
    one, many = lexicon.cleaned(s), lexicon.packed(s, 50)
    held = many.collect()
    assert Counter((x.project, t) for x in held for t in x.clean.split("\n") if t) == Counter((x.project, x.clean) for x in one.collect() if x.clean)
    assert len(held) < 250 and 300 <= max(len(x.clean) for x in held) < 350
    plain = Counter((b, t[i : i + n]) for b, t in [(x.project, x.clean) for x in one.collect()] for n in (1, 2) for i in range(len(t) - n + 1))
    assert {(x.project, x.gram): x.n for x in lexicon.gram_counts(many).collect()} == plain == {(x.project, x.gram): x.n for x in lexicon.gram_counts(one).collect()}

    def words(clean) -> list:
        return sorted(map(tuple, lexicon.pmi_words(clean.where("project is not null"), lexicon.pmi_table(clean), 1.0, 500).collect()))

    want = words(one)
    assert words(many) == want and ("x", "甲" * 7, 42) in want
    for name, value in (("SQUARE", 1), ("CHUNK_CHARS", 60)):
        with monkeypatch.context() as m:
            m.setattr(lexicon, name, value)
            assert words(many) == want


def test_runs_of_many_different_numbers():
    """More bits than a key has."""
    numbers = np.array([r % 1_000_000 for r in random.Random(6).choices(range(10**9), k=500)] * 2)
    starts = np.arange(len(numbers) - 7)
    at, n = lexicon._same(numbers, 1_000_000, starts, 7)
    assert {tuple(numbers[i : i + 7].tolist()): k for i, k in zip(at.tolist(), n.tolist(), strict=True)} == Counter(tuple(numbers[i : i + 7].tolist()) for i in starts.tolist())


def test_best_of_rows_is_a_stable_sort():
    r = np.random.default_rng(7)
    for columns in (1, 3, 4, 50):
        scores = r.integers(-3, 4, (20, columns)).astype(float)
        scores[3] = 0
        row, column, _ = recall.best_of_rows(scores, np.eye(columns), 3)
        want = np.argsort(-scores, axis=1, kind="stable")[:, :3]
        assert column.tolist() == want.ravel().tolist() and row.tolist() == np.repeat(np.arange(20), want.shape[1]).tolist()


def test_vectors_meet_queries_in_bounded_groups(spark, monkeypatch):
    """Small runs, blocks and pieces give the same hits, and no piece of scores is larger than it may be."""
    rows = [(f"b{i % 3}", i // 7, str(i), [float(i % 5), float(i * i % 11), 1.0] if i % 9 else [0.0] * 3) for i in range(120)]
    v = spark.createDataFrame(rows, "project string, chapter int, shot_id string, embedding array<float>")
    q = v.where("chapter % 2 = 0").selectExpr("shot_id as query_id", "embedding")

    def hits(block: int) -> list:
        return sorted((x.query_id, x["rank"], *x[4:], round(x.score, 9)) for x in recall.cosine_topk(q, v, 4, block).collect())

    want = hits(4096)
    whole = recall.best_of_rows

    def checked(m, v, k):
        assert len(m) == 1 or len(m) * len(v) <= 40
        return whole(m, v, k)

    monkeypatch.setattr(recall, "RUN", 5)
    monkeypatch.setattr(recall, "SCORES", 40)
    monkeypatch.setattr(recall, "best_of_rows", checked)
    assert hits(3) == want and len(want) == 4 * q.count()


def test_smallest_draws_are_those_of_md5():
    r = random.Random(8)
    for n in (1, 2, 7, 300):
        ends = [f"{'字' * r.randint(0, 3)}|{r.randint(0, 10 ** r.randint(1, 6))}|{r.randint(1, 99)}".encode() for _ in range(n)]
        messages = recall._Messages(ends)
        for start in (b"", b"pick|1-2|", "pick|é|".encode(), b"x" * 36, b"x" * 60):
            which, k = np.sort(np.array(r.sample(range(n), r.randint(1, n)))), r.randint(1, 4)
            assert messages.least(start, which, k) == sorted((hashlib.md5(start + ends[i]).hexdigest(), j) for j, i in enumerate(which.tolist()))[:k]


def test_pairs_of_queries_and_shots_are_not_written(spark, monkeypatch):
    """Every query holds every label and shares words with every text: what is written for it grows with queries plus shots, and containment neither writes nor shuffles what it finds."""
    n = 40
    s = spark.createDataFrame([("b", i, 0, "1", "甲乙") for i in range(n)], "project string, chapter int, pos int, shot_id string, label string")
    t = s.selectExpr("*", "'甲乙丙丁甲乙' as text")
    q = spark.createDataFrame([(f"q{i}", "b", "丙丁甲乙") for i in range(n)], "query_id string, project string, text string")
    w = spark.createDataFrame([("b", "甲乙"), ("b", "丙丁")], "project string, word string")
    written, whole = [], recall.table

    def counted(df, **options):
        written.append(df.count())
        return whole(df, **options)

    monkeypatch.setattr(recall, "table", counted)
    monkeypatch.setattr(recall, "cut", counted, raising=False)
    assert {x.n for x in recall.token_counts(q, s, t, w).collect()} == {4} and recall.token_counts(q, s, t, w).count() == n * n
    named = s.selectExpr("project", "concat('b|', chapter, '|1') as key", "label")
    found = recall.containment(q.selectExpr("query_id", "project", "text as q"), named)
    assert found.count() == n * n and max(written) <= 2 * n
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_keys_with_several_labels_are_found_once(spark, monkeypatch):
    monkeypatch.setattr(recall, "LABEL_KEYS", 2, raising=False)
    q = spark.createDataFrame([(1, "b", "甲乙丙丁"), (2, "b", "甲乙"), (3, "b", "甲乙")], "query_id int, project string, q string")
    labels = [("b", "k1", "甲乙"), ("b", "k1", "丙丁"), ("b", "k1", "丙丁"), ("b", "k3", "甲甲")] + [("b", f"m{i}", "甲乙") for i in range(5)]
    got = sorted(map(tuple, recall.containment(q, spark.createDataFrame(labels, "project string, key string, label string")).collect()))
    assert got == sorted((i, "b", k) for i in (1, 2, 3) for k in ["k1", *(f"m{j}" for j in range(5))])
