"""Gates, derivations, merging, ledgers, lexicon and recall on small fixtures, and against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from storyloom.functions.enums import CUT_CHARS
from storyloom.operators import derive, draft, gates, json_audit, ledger, lexicon, recall, rollup

SENTENCE = "project string, chapter int, pos int, sid string, seq int, struct string, text string, shot_id string"
SHOT = "project string, chapter int, pos int, shot_id string, type string, funcs array<string>, label string, sentence_ids array<string>"


def sentences(spark, rows):
    return spark.createDataFrame([("b", 1, i, sid, seq, struct, t, None) for i, (sid, seq, struct, t) in enumerate(rows)], SENTENCE)


def shots(spark, rows):
    return spark.createDataFrame([("b", 1, i, str(i + 1), kind, funcs, label, ids) for i, (kind, funcs, label, ids) in enumerate(rows)], SHOT)


def rules(df):
    return Counter(r.rule for r in df.collect())


def test_gates(spark):
    good = sentences(spark, [("S1", 1, "短句", "a"), ("S2", 2, "句从", "b")])
    assert gates.gate_sentences(good).count() == 0
    bad = sentences(spark, [("S1", 1, "短句", "a"), ("S3", 2, "对话", "　")])
    assert rules(gates.gate_sentences(bad)) == {"sequence": 1, "struct": 1, "blank_text": 1}
    assert gates.gate_shots(shots(spark, [("信息", ["推进"], "l", ["S1", "S2"])]), good).count() == 0
    overlap = shots(spark, [("信息", ["推进"], "l", ["S1", "S2"]), ("梦", [], "l", ["S2"])])
    assert set(rules(gates.gate_shots(overlap, good))) == {"overlap", "coverage", "sequence", "type", "funcs"}
    assert set(rules(gates.gate_shots(shots(spark, [("信息", ["推进"], "l", ["S2", "S1"])]), good))) == {"sequence"}


def test_contract_of_what_is_derived_is_clean(spark):
    s = sentences(spark, [(f"S{i + 1}", i + 1, "短句" if i % 2 else "句从", "字" * (i * 3 + 1)) for i in range(9)])
    h = derive.with_ranges(shots(spark, [("信息", ["悬念"], "l", ["S1", "S2", "S3"]), ("对话", ["推进", "悬念"], "m", [f"S{i}" for i in range(4, 10)])]))
    s = derive.with_owners(s, h)
    c = spark.createDataFrame([("b", 1, "t", "推进", "s", [("e", "推进")])], "project string, number int, title string, function string, summary string, mainline array<struct<entity:string,state:string>>")
    stats, held = derive.chapter_stats(s, h), derive.suspense(h)
    assert gates.contract(s, h, c, stats, held).count() == 0
    assert rules(gates.contract(s.withColumn("shot_id", F.lit("9")), h, c, stats, held.limit(1))) == {"shot_id": 9, "suspense": 1}
    again = derive.with_owners(s, h).select(*s.columns)
    assert again.exceptAll(s).count() == 0


def test_owner_is_the_last_shot(spark):
    s = sentences(spark, [("S1", 1, "短句", "a"), ("S2", 2, "短句", "b")])
    h = shots(spark, [("信息", ["推进"], "l", ["S1"]), ("信息", ["推进"], "l", ["S1"])])
    assert {r.sid: r.shot_id for r in derive.with_owners(s, h).collect()} == {"S1": "2", "S2": None}
    assert [r.sid for r in derive.orphans(s, h).collect()] == ["S2"]


def test_rates(spark):
    s = sentences(spark, [(f"S{i + 1}", i + 1, "短句", "x" if i < 3 else "x" * 20) for i in range(200)])
    assert derive.chapter_stats(s, shots(spark, [("信息", ["推进"], "l", ["S1"])])).first().short_sentence_rate == 0.01


def test_struct_repair(spark):
    s = sentences(spark, [("S1", 1, "对话", "“走。”"), ("S2", 2, "对话", "走")])
    assert [r.struct for r in gates.repaired_structs(s).orderBy("pos").collect()] == ["短句", "对话"]
    assert [r.sid for r in gates.bad_structs(s).collect()] == ["S2"]


EVENT = "project string, idx int, entity string, start_ch int, chapters array<int>, end_ch int, has_end boolean, state string, note string"


def test_events(spark):
    e = spark.createDataFrame([("b", 0, "x", 5, [], None, True, "已回收", "n"), ("b", 1, "y", 3, [3, 4], 9, True, "已回收", "n"), ("b", 2, "z", 1, [1], None, False, "悬置", "n")], EVENT)
    got = {r.idx: (r.chapters, r.end_ch) for r in rollup.repaired_events(e).collect()}
    assert got == {0: ([5], 5), 1: ([3, 4, 9], 9), 2: ([1], None)}
    assert {(r.idx, r.rule) for r in gates.gate_events(e).collect()} == {(0, "closed_without_end"), (1, "end_outside"), (2, "open_with_end"), (2, "end_outside")}
    t = spark.createDataFrame([("b", i, f"t{i}", "推进", ev, "n", i == 2) for i, ev in enumerate([[1, 2], [1, 2, 3], [4, 5, 6]])], "project string, idx int, target string, state string, evidence array<int>, note string, is_main boolean")
    assert {r.idx for r in rollup.with_main_target(t).where("is_main").collect()} == {1} and gates.gate_targets(t).count() == 0


def test_instructions(spark):
    e = spark.createDataFrame([("b", "event", 0, "x", [1], "悬置", None), ("b", "event", 1, "y", [2], "已回收", 2)], "project string, layer string, idx int, name string, chapters array<int>, state string, end_ch int")
    i = spark.createDataFrame(
        [
            ("b", "event", 1, "merge", 0, None, [7], "已回收", 7, None),
            ("b", "event", 2, "merge", 0, "x", [3], "悬置", 8, None),
            ("b", "event", 3, "merge", 1, "other", [9], None, None, None),
            ("b", "event", 4, "merge", 2, None, [4], None, None, None),
            ("b", "event", 5, "insert", None, None, [6], "悬置", None, "z"),
            ("b", "event", 6, "merge", 2, None, [5], None, None, None),
            ("b", "event", 7, "merge", 99, None, [5], None, None, None),
            ("b", "event", 8, "move", 0, None, [5], None, None, None),
        ],
        "project string, layer string, seq int, action string, idx int, entity string, chapters array<int>, state string, end_ch int, name string",
    )
    got = {r.idx: (r.chapters, r.state, r.end_ch) for r in rollup.applied_instructions(e, i).collect()}
    assert got == {0: ([1, 3, 7], "已回收", 7), 1: ([2], "已回收", 2), 2: ([5, 6], "悬置", None)}
    r = rollup.rejected_instructions(e, i).first()
    assert (r.given, r.applied, r.rejected) == (8, 4, 4)


def test_fuse_and_ledger(spark):
    rows = [("p", i, i, 1, f) for i, f in enumerate([False, True, False, False])]
    o = spark.createDataFrame(rows, "project string, seq_ts int, seq_id int, chapter int, failed boolean")
    assert [(r.prior_failures, r.processed, r.blown) for r in ledger.failure_fuse(o).orderBy("seq_id").collect()] == [(0, 1, False), (0, 2, False), (1, 3, True), (1, 4, False)]
    assert ledger.pending_ledger(o).count() == 0
    assert [r.attempts for r in ledger.pending_ledger(o.unionByName(o.limit(1).withColumns({"seq_ts": F.lit(9), "failed": F.lit(True)}))).collect()] == [1]
    listed = spark.createDataFrame([("b", n) for n in range(1, 6)], "project string, number int")
    pending = spark.createDataFrame([("b", 3, False), ("b", 4, True)], "project string, chapter int, fixed boolean")
    assert [r.number for r in ledger.selected_work(listed, pending).collect()] == [3]
    assert ledger.selected_work(listed, pending, everything=True, chapters=[1]).count() == 5
    assert [r.number for r in ledger.selected_work(listed, pending, start=4).orderBy("number").collect()] == [4, 5]


FAULTS = {'{"a":1,"a":2}': "duplicate_key", '{"a":1,}': "trailing_comma", "[1]": "root_not_object", '{"a":"x\ny"}': "raw_newline", "{} x": "trailing_content", '{"a":01}': "bad_number", '{"a":"\\q"}': "bad_escape", '{"a" 1}': "missing_colon", '{"a":[1,]}': "trailing_comma", '{"a":1 "b":2}': "missing_comma", '{"a":': "unclosed", '{"a":"x': "unclosed_string", "": "unclosed", "{a:1}": "unexpected_character", "{1:1}": "key_not_string"}


@pytest.mark.parametrize(("text", "kind"), FAULTS.items())
def test_json_faults(text, kind):
    assert json_audit.audit(text)[0] == kind


def _reject(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError
    return dict(pairs)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(['{"a":', '"b":', "1", "-0.5e3", "01", "{", "}", "[", "]", ",", ":", '"x"', "true", "null", " ", '"\\u00e9"', "nul"]), max_size=9))
def test_json_audit_agrees_with_a_parser(parts):
    import json

    text = "".join(parts)

    def no(x):
        raise ValueError(x)

    try:
        good = isinstance(json.loads(text, object_pairs_hook=_reject, parse_constant=no), dict)
    except ValueError:
        good = False
    assert (json_audit.audit(text) is None) == good


def test_json_places_and_salvage(spark):
    df = spark.createDataFrame([('{"a":1,\n "b":2,}',), ('{"a":1}',)], "text string")
    rows = json_audit.audited(df).collect()
    assert [(r.valid, r.kind, r.line, r.col) for r in rows] == [(False, "trailing_comma", 2, 8), (True, None, None, None)]
    for raw, want in {'```json\n{"a":1}\n```': '{"a": 1}', 'so: {"a":"x\ny"} ok': '{"a": "x\\ny"}', "[1]": None, "no": None}.items():
        assert json_audit.salvaged(raw) == want
    broken = spark.createDataFrame([("b", 1, '{"sentences":[{"text":"a\\"b","struct":"句从"},{"text":"c","struct":"?"},{"text":"d"')], "project string, chapter int, text string")
    assert [(r.sid, r.struct, r.text) for r in json_audit.rebuilt_sentences(broken).orderBy("pos").collect()] == [("S1", "句从", 'a\\"b'), ("S2", "短句", "c"), ("S3", "短句", "d")]
    assert json_audit.patched('{"a":[{"b":1}],"c":2}', [("a[0].b", "5"), ("c", "__DELETE__"), ("x.y", "1"), ("a[4]", "1")]) == ('{"a": [{"b": 5}]}', 2)
    assert json_audit.patched('{"a":[1,2,3]}', [("a[0]", "__DELETE__"), ("a[2]", "9")]) == ('{"a": [null, 2, 9]}', 0)  # a place that goes leaves the others' numbers


def test_dialogue():
    assert draft.repaired_dialogue("“走吧，”他笑了笑“快走。”") == ("他笑了笑：“走吧。快走。”", 2)
    assert draft.repaired_dialogue("“走吧 ”笑道“快走。”") == ("笑道：“走吧 。快走。”", 2)  # the blank stays
    assert draft.repaired_dialogue("他说，“走”") == ("他说：“走”", 1)
    assert draft.repaired_dialogue("他走来“走”") == ("他走来：“走”", 1)
    assert draft.repaired_dialogue("嗤笑：他放下") == ("嗤笑，他放下", 1)
    assert draft.repaired_dialogue("价格：五十") == ("价格：五十", 0)


def plain_pieces(text, bonded, longest=7):
    """Runs of bonded neighbours, one character at a time."""
    words, run = [], ""
    for c in text:
        if c in CUT_CHARS:
            words, run = [*words, run], ""
        elif run and len(run) < longest and run[-1] + c in bonded:
            run += c
        else:
            words, run = [*words, run], c
    return [w for w in [*words, run] if w]


def plain_tokens(text, words):
    out, i = [], 0
    while i < len(text):
        word = max((w for w in words if w and text.startswith(w, i)), key=len, default=None)
        out += [word] if word else []
        i += len(word) if word else 1
    return out


def codes(bonded):
    return np.sort(np.array([ord(a) << 32 | ord(b) for a, b in bonded], np.uint64))


def test_pieces():
    bonded = {"甲乙", "乙丙", "丙丁", "丁戊", "戊壬", "壬庚", "庚辛"}
    assert lexicon.cut_at_bonds(["甲乙丙丁戊壬庚辛"], codes(bonded)) == {"甲乙丙丁戊壬庚": 1, "辛": 1}
    assert lexicon.cut_at_bonds(["甲的乙丙x", "", "丙"], codes(bonded)) == {"甲": 1, "乙丙": 1, "x": 1, "丙": 1}
    tokens = lambda words, texts: lexicon.longest_words(lexicon.automaton_of(words), texts)
    assert tokens(["庙会", "庙会傍晚"], ["庙会傍晚人多", "", "去庙会"]) == [(0, "庙会傍晚"), (2, "庙会")]
    assert tokens(["abcd", "bc", "b"], ["abce abcd"]) == [(0, "bc"), (0, "abcd")]
    assert lexicon.cut_at_bonds([], codes(bonded)) == {} and tokens([], ["x"]) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("甲乙丙的a𠀀", max_size=30), max_size=5), st.sets(st.text("甲乙丙的a𠀀", min_size=2, max_size=2)), st.sets(st.text("甲乙丙a𠀀", max_size=5)))
def test_pieces_and_tokens_against_plain(texts, bonded, words):
    assert lexicon.cut_at_bonds(texts, codes(bonded)) == Counter(w for t in texts for w in plain_pieces(t, bonded))
    assert lexicon.longest_words(lexicon.automaton_of(words - {""}), texts) == [(i, w) for i, t in enumerate(texts) for w in plain_tokens(t, words)]


def test_lexicon_counts(spark):
    s = sentences(spark, [(f"S{i}", i, "短句", t) for i, t in enumerate(["黛玉哭，黛玉笑", "黛玉 黛玉", "x"])])
    clean = lexicon.cleaned(s)
    grams = Counter()
    for t in ["黛玉哭黛玉笑", "黛玉黛玉", "x"]:
        grams.update(a + b for a, b in zip(t, t[1:], strict=False))
    assert {r.gram: r.n for r in lexicon.bigrams(clean).collect()} == grams
    pmi = {r.gram: r.pmi for r in lexicon.pmi_table(clean).collect()}
    assert pmi == {"黛玉": pytest.approx(math.log2((4 / 11) / (4 / 11 * 4 / 11)))}
    assert {r.word: r.n for r in lexicon.pmi_words(clean, lexicon.pmi_table(clean), 1.0).collect()} == {"黛玉": 4, "哭": 1, "x": 1}


def library(spark, seed=3, n=60):
    r = random.Random(seed)
    types, funcs = ["信息", "对话", "心理"], ["推进", "铺垫", "反转", "悬念"]
    rows = [(f"b{r.randint(0, 2)}", r.randint(1, 5), i, str(i), r.choice(types), r.sample(funcs, r.randint(1, 3)), "".join(r.choice("甲乙丙丁") for _ in range(r.randint(0, 5))), [f"S{i}"]) for i in range(n)]
    return rows, spark.createDataFrame(rows, SHOT)


def fnv(text):
    h = 2166136261
    for c in text:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


def test_label_recall(spark):
    rows, s = library(spark)
    asked = [("信息", ["推进"]), ("对话", ["推进", "悬念"]), (None, ["反转"]), ("心理", []), ("事件", ["转场"]), (None, [])]
    q = spark.createDataFrame([(str(i), t, f) for i, (t, f) in enumerate(asked)], "query_id string, type string, funcs array<string>")
    got = {}
    for x in recall.label_hits(s, q, 3).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.project, x.chapter, x.shot_id))
    scan = sorted(rows, key=lambda x: (x[0], x[1], x[2]))
    for i, (kind, funcs) in enumerate(asked):
        pool = [x for x in scan if funcs and set(funcs) <= set(x[5]) and kind in (None, x[4])]
        want = []
        if pool:
            p = pool[fnv(f"{kind or ''}|{','.join(sorted(funcs))}|{len(pool)}") % len(pool)]
            want.append((2.0, p[0], p[1], p[3]))
        rest = [(2.0 * sum(f in x[5] for f in funcs) + (0.5 if kind == x[4] else 0), x) for x in scan if not pool or x is not p]
        rest = sorted((x for x in rest if x[0] > 0), key=lambda x: -x[0])[: 3 - len(want)]
        assert got.get(str(i), []) == want + [(sc, x[0], x[1], x[3]) for sc, x in rest]


def test_token_counts(spark):
    rows, s = library(spark)
    words = [(b, w) for b in ("b0", "b1", "b2") for w in ["甲乙", "丙丁", "甲乙丙", "乙", "丁丁"] if not (b == "b2" and w == "甲乙丙")]
    texts = [(x[0], x[1], x[2], x[3], x[6] + "乙丙" + x[6][::-1]) for x in rows]
    q = [("1", "b0", "甲乙，丙"), ("2", "b1", "丙丁"), ("3", "b2", "甲"), ("5", "b0", "丁丁丁"), ("6", "b1", "丁丁x"), ("4", "b2", "丁丙乙甲甲乙丙")]
    t = spark.createDataFrame(texts, "project string, chapter int, pos int, shot_id string, text string")
    got = {(r.query_id, r.key): r.n for r in recall.token_counts(spark.createDataFrame(q, "query_id string, project string, text string"), s, t, spark.createDataFrame(words, "project string, word string")).collect()}
    want = {}
    for i, b, raw in q:
        clean = raw.replace("，", "")
        if len(clean) < 2:
            continue
        first = [w for p, w in words if p == b]
        qt = set(plain_tokens(clean, first))
        for x, y in zip(rows, texts, strict=True):
            if x[0] != b:
                continue
            n = 0
            if len(x[6]) >= 2:
                n = sum(w in qt for w in plain_tokens(x[6], first))
                if clean in x[6] or x[6] in clean:
                    n = max(n, 1)
            if len(y[4]) >= len(clean) and sum(c in y[4] for c in set(clean)) >= 2:
                n += sum(w in qt for w in plain_tokens(y[4], first))
            if n:
                want[i, f"{x[0]}|{x[1]}|{x[3]}"] = n
    assert got == want


def test_cosine(spark):
    r = random.Random(5)
    v = [(f"b{i % 3}", i // 7, str(i % 7), [r.gauss(0, 1) for _ in range(8)]) for i in range(90)] + [("z", 1, "1", [0.0] * 8)]
    q = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(11)]
    vectors = spark.createDataFrame(v, "project string, chapter int, shot_id string, embedding array<float>")
    queries = spark.createDataFrame(q, "query_id int, embedding array<float>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / max(1e-9, math.dist(a, [0] * 8) * math.dist(b, [0] * 8))

    for block in (4, 4096):
        got = {}
        for x in recall.cosine_topk(queries, vectors, 3, block).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.project, x.chapter, x.shot_id))
        for i, e in q:
            assert got[i] == [x[:3] for x in sorted(v, key=lambda x: -cos(e, x[3]))[:3]]


def test_merge_and_blocks(spark):
    ddl = "query_id string, channel string, rank int, score double, project string, chapter int, shot_id string"
    a = spark.createDataFrame([("q", "label", 1, 2.0, "b", 1, "1")], ddl)
    b = spark.createDataFrame([("q", "token", 1, None, "b", 1, "1"), ("q", "token", 2, None, "b", 1, "2")], ddl)
    m = recall.merged(a, b)
    assert [(r.place, r.channel, r.shot_id) for r in m.orderBy("place").collect()] == [(1, "label", "1"), (2, "token", "2")]
    s = spark.createDataFrame([("b", 1, 0, "1", "信息", ["推进"], "l", []), ("b", 1, 1, "2", "对话", ["推进"], "m", [])], SHOT)
    t = spark.createDataFrame([("b", 1, "1", "文"), ("b", 1, "2", "")], "project string, chapter int, shot_id string, text string")
    refs = recall.described(m, s, t)
    assert [r.block for r in recall.context_blocks(refs).collect()] == ["[RAG-1] (信息|推进) b·第0001章:镜1「l」\n文"]
    both = spark.createDataFrame([("q",), ("none",)], "query_id string")
    assert {r.query_id: r.refs for r in draft.reference_lists(refs, both).collect()} == {"q": "1. [label] 第1章 分镜1（信息/推进「l」）：文", "none": "（无参考）"}


def test_manifest(spark):
    ddl = "project string, chapter int, shot_mtime string, sent_mtime string"
    now = spark.createDataFrame([("a", 1, "1", "1"), ("b", 1, "1", "missing"), ("c", 1, "1", "1")], ddl)
    then = spark.createDataFrame([("a", 1, "1", "1"), ("b", 1, "1", "2"), ("d", 1, "1", "1")], ddl)
    assert {r.project: r.rebuild for r in lexicon.needs_rebuild(now, then).collect()} == {"a": False, "b": True, "c": True}


def test_ranges_against_plain(spark):
    r = random.Random(4)
    listed = {(f"b{r.randint(0, 3)}", r.randint(1, 300)) for _ in range(400)}
    done = set(r.sample(sorted(listed), 250))
    tasks = [(i, f"b{i % 5}", a := r.randint(0, 300), a + r.randint(-2, 90)) for i in range(60)]
    chapters = spark.createDataFrame(sorted(listed), "project string, number int")
    have = spark.createDataFrame(sorted(done), "project string, number int")
    asked = spark.createDataFrame(tasks, "id int, project string, from_ch int, to_ch int")
    want, lists = {}, []
    for i, b, lo, hi in tasks:
        inside = [x for x in listed if x[0] == b and lo <= x[1] <= hi]
        lacking = sorted(n for x, n in inside if (x, n) not in done)
        want[i] = len(inside), len(lacking), "empty_range" if not inside else "open" if lacking else "complete"
        lists += [(i, b, k + 1, n) for k, n in enumerate(lacking)]
    assert {x.id: (x.todo, x.missing, x.reason) for x in ledger.range_state(chapters, have, asked).collect()} == want
    assert sorted(map(tuple, ledger.range_missing(chapters, have, asked).collect())) == sorted(lists)


def test_containment_of_long_labels(spark):
    q = spark.createDataFrame([("1", "b", "甲乙丙丁戊"), ("2", "b", "乙丙"), ("3", "c", "甲")], "query_id string, project string, q string")
    labels = [("b", "k1", "丙丁"), ("b", "k2", "子" * 3000 + "甲乙丙丁戊"), ("b", "k3", "乙"), ("b", "k4", "丁丙"), ("c", "k5", "丙丁")]
    got = recall.containment(q, spark.createDataFrame(labels, "project string, key string, label string"))
    assert sorted(map(tuple, got.collect())) == [("1", "b", "k1"), ("1", "b", "k2"), ("2", "b", "k2")]


def test_some_queries_run(spark, sf_dir):
    from storyloom.plans.oracles import ORACLES
    from storyloom.plans.queries import QUERIES

    assert set(ORACLES) <= set(QUERIES)
    for name in ("layer_sentences", "layer_shots", "layer_rejects", "manuscript_files", "split_chapters", "published", "missing_chapters", "suspense_list", "chapter_sizes", "dialogue_repair", "vector_plan"):
        assert QUERIES[name](spark, sf_dir).count() > 0
