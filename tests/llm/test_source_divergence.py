"""The divergence audit against plain Python on whole numbers."""

import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from storyloom.llm import source_divergence as sd

DDL = "doc_id long, text string, lang string, source string, n string, term string, rank string"


def plain(rows, least, top):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        groups = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        every = {t: sum(g[t] for g in groups.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 2) // (sum(g.values()) + 2 * len(kept)) for t, n in g.items()} for s, g in [*groups.items(), (None, every)]}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, g in groups.items():
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            more = [(f(p[s][t], p[None][t]), t) for t in kept if g[t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", more)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else top]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def test_against_plain_python(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{'abcdefghij'[i % 10]}{'xyz'[i // 10 % 3]}{'kl'[i // 30]}" for i in range(60)] + ["été", "日本", "É", "🧿"]
    rows = []
    for i in range(300):
        words = rng.choice(vocab, size=rng.integers(0, 40), p=np.arange(1, len(vocab) + 1) / (len(vocab) * (len(vocab) + 1) / 2))
        rows.append((" ".join(w.upper() if rng.random() < 0.1 else w for w in words) + rng.choice(["", "\n", "1x2", "_", "​"]), str(rng.choice(["en", "de", "en"])), f"s{i % 3 if i % 2 else i % 7}"))
    rows += [(None, "en", "s0"), ("", "en", "silent"), ("words here", "xx", "a"), (None, "xx", "b"), ("text", None, None), (None, None, "s"), ("alone", "one", "one")] + [rows[0]] * 4
    df = spark.createDataFrame([(i, t, lang, s, "x", "y", "z") for i, (t, lang, s) in enumerate(rows)], DDL).repartition(5)
    for settings_ in ({}, {"slice_terms": 7, "held": 20}):
        assert sorted(map(tuple, sd.audit(df, **settings_).collect())) == plain(rows, 10, 10)
    assert sorted(map(tuple, sd.audit(df, least_docs=2, top=3).collect())) == plain(rows, 2, 3)
    assert sd.audit(df.where("false")).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=5, max_size=5), min_size=2, max_size=5), st.lists(st.integers(10, 10**12), min_size=5, max_size=5))
def test_runs_of_any_counts(rows, under):
    share = [[1 + sd.UNIT * (n + 2) // d for n in row] for row, d in zip(rows, under, strict=False)]
    expected = {(i, j): sum((p - q) ** 2 // (p + q) for p, q in zip(share[i], share[j], strict=True)) for i in range(len(rows)) for j in range(i + 1, len(rows))}
    assert {(i, j): v for i, j, v in sd.compared(np.array(rows), under[: len(rows)])} == expected


def test_shares_beyond_a_long(spark):
    row = spark.range(1).select(sd.share(sd.F.lit(9 * 10**15).cast("long"), sd.F.lit(9 * 10**15 + 7).cast("long"), sd.F.lit(3).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**15 + 2) // (9 * 10**15 + 13)
