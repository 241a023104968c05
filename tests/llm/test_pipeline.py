"""The whole pipeline, each stage against a plain version on that stage's own input, and as a chain on odd tables."""

from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from storyloom.llm import secrets
from storyloom.llm.oracles import ORACLES

from tests.llm.test_pairs import mix_targets, roots, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def plain_quality(rows, bench):
    documents = pd.DataFrame(rows, columns=COLUMNS)
    con = duckdb.connect()
    con.register("documents", documents)
    kept = {i for i, keep in con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op10_quality_rules']})").fetchall() if keep}
    return [r for r in rows if r[0] in kept]


def plain_dedup(rows, bench):
    sets = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)]))
    index = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            index[x].add(i)
    links = []
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in index[x] if j < i)
        links += [(i, j) for j, n in shared.items() if n / (len(s) + len(sets[j]) - n) >= 0.8]
    first = {}
    for i, g in enumerate(roots(len(rows), links)):
        first[g] = min(first.get(g, i), i, key=lambda k: rows[k][0])
    return [rows[i] for i in first.values()]


def plain_clean(rows, bench):
    items = {i: Counter(shingles(t)) for i, t in bench}
    index = defaultdict(set)
    for i, c in items.items():
        for x in c:
            index[x].add(i)

    def leaks(text):
        s = shingles(text)
        for i in {i for x in s for i in index.get(x, ())}:
            n = sum(items[i].values())
            for k in range(max(1, len(s) - n + 1)):
                w = Counter(s[k : k + n])
                shared = sum((w & items[i]).values())
                if shared / (sum(w.values()) + n - shared) >= 0.8:
                    return True
        return False

    return [r for r in rows if not leaks(r[1])]


def plain_redacted(rows, bench):
    tagger = secrets.Tagger(secrets.trained())
    out = []
    for i, text, lang, source, _ in rows:
        clean = secrets.redacted(text, tagger.spans([text])[0][0], "[SECRET]")
        out.append((i, clean, lang, source, len(clean)))
    return out


PLAIN = {"quality_rules": plain_quality, "simhash_dedup": plain_dedup, "decontamination": plain_clean, "secret_scan": plain_redacted}


def test_each_stage_against_a_plain_version(spark, sf_dir, tmp_path):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    rows = [tuple(r) for r in given.collect()]
    rows += [(10_000 + i, t + extra, lang, s, len(t + extra)) for i, (_, t, lang, s, _) in enumerate(rows[:40]) for extra in [f" and then number {i}"]]
    rows += [(20_000 + i, f"{rows[i][1]} {t} {rows[i + 1][1]}", "en", rows[i][3], 1) for i, (_, t) in enumerate(bench[:15])]
    docs = spark.createDataFrame(rows, DDL)
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{step}")
        docs = spark.read.parquet(f"{tmp_path}/{step}")
        after = [tuple(r) for r in docs.select(*COLUMNS).collect()]
        if name in PLAIN:
            assert docs.columns == COLUMNS
            assert sorted(after) == sorted(PLAIN[name](before, bench)), name
            assert name == "secret_scan" or len(after) < len(before)
    sizes, taken = Counter(), Counter()
    for _, text, _, source, _ in before:
        sizes[source] += len(text.split())
    copies = Counter(after)
    assert set(copies) <= set(before) and max(copies.values()) <= 2
    for (_, text, _, source, _), n in copies.items():
        taken[source] += n * len(text.split())
    want = mix_targets(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(len(r[1].split()) for r in before if r[3] == s)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_as_a_chain_on_odd_tables(spark, sf_dir, kind):
    text = " ".join(f"w{i}" for i in range(60))
    odd = [(None, None, None, None, None), (1, None, "en", "a", None), (1, "", "en", "a", 0), (None, text, None, None, 1), (None, text, None, None, 1), (2, text + " x", "en", None, 1), (3, "secret=abcdef0123 " + " ".join(f"v{i}" for i in range(50)), "de", "b", 1), (4, "word " * 50_000, "en", "a", 1)]
    docs = spark.createDataFrame(odd if kind == "odd" else [], DDL).selectExpr("*", "text as _text", "doc_id as rows", "source as hash")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns + ["copy_no"] * (name == "mixing")
    found = docs.collect()
    assert (kind == "empty" and not found) or {r.doc_id for r in found} <= {None, 2, 3}
    assert not any("abcdef0123" in r.text for r in found)
