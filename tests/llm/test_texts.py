"""Operators that read one text at a time: rules, secrets, surrogates, extraction, scores."""

import math
import pathlib
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from storyloom.llm import html_text, licenses, lm_score, pii, quality_model, quality_rules

from tests.llm.test_pairs import docs

EDGES = [(1, None, "a"), (2, "", "a"), (3, "one", None), (4, "one", None), (4, "one", None), (None, "x " * 30, "b"), (5, "long word " * 40_000, "b"), (6, "\t \n", "a")]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "#", "\n", "　x", "é|", "\x1f"]), max_size=60))
def test_rule_counts(parts):
    text = " ".join(parts)
    assert quality_rules.counts(text)[:5] == plain_counts(text)


def test_rules(spark, sf_dir):
    rows = EDGES + [(r.doc_id + 100, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    d = docs(spark, rows)
    got = quality_rules.judged(d).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((i, *plain_counts(t)) for i, t, _ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = quality_rules.keep_good(d)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judged(docs(spark, [])).count() == 0


def plain_verdicts(hosts):
    """Host verdicts from {host: (documents, failed)}, with the beta prior written out."""
    every, failed = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values())
    mean = failed / every
    squares = sum(n * (f / n - mean) ** 2 for n, f in hosts.values())
    room = sum((1 - n / every) * (n - 1) for n, _ in hosts.values())
    rho = min(1, max(0, (squares - mean * (1 - mean) * (len(hosts) - 1)) / (mean * (1 - mean) * room)))
    rates = {}
    for h, (n, f) in hosts.items():
        a, b = (mean * (1 / rho - 1), (1 - mean) * (1 / rho - 1)) if rho else (mean * 1e15, (1 - mean) * 1e15)
        rates[h] = (f + a) / (n + a + b)
    return {h: "reject" if r > 0.9 else "watch" if r > 2 * mean else "trust" if r < 0.5 * mean else "ordinary" for h, r in rates.items()}


@pytest.mark.parametrize("differ", [True, False])
def test_host_verdicts(spark, differ):
    words = " ".join(f"w{i}" for i in range(40))
    loud = words + " # # # # #"  # over the limit of symbols
    near = words + " # # #"  # over half of it
    shares = {"clean": 0, "usual": 30, "odd": 80, "bad": 100, "small": 100} if differ else {"a": 30, "b": 30, "c": 30}
    sizes = {"clean": 300, "usual": 900, "odd": 120, "bad": 200, "small": 2}
    rows, hosts = [], {}
    for h, share in shares.items():
        n = sizes.get(h, 300)
        bad = n * share // 100
        texts = [loud if i < bad else near if i < bad + 5 else words for i in range(n)]
        rows += [(len(rows) + i, t + f" n{i}", h) for i, t in enumerate(texts)]
        hosts[h] = n, bad
    d = docs(spark, rows)
    got = quality_rules.judged(d).collect()
    want = plain_verdicts(hosts)
    assert {r.host: r.host_verdict for r in got} == want
    assert set(want.values()) == ({"trust", "ordinary", "watch", "reject"} if differ else {"ordinary"})
    text = {i: t for i, t, _ in rows}
    for r in got:
        v = want[r.host]
        assert r.kept == (v == "trust" or (v == "ordinary" and "# # # # #" not in text[r.doc_id]) or (v == "watch" and "#" not in text[r.doc_id]))
    assert Counter(r.doc_id for r in quality_rules.keep_good(d).collect()) == Counter(r.doc_id for r in got if r.kept)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.data())
def test_permutation(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = pii.moved(x, size, b"k", b"t")
    assert 0 <= y < size and (y != x or size == 1)
    assert pii.permuted(pii.permuted(x, size, b"k", b"t"), size, b"k", b"t", back=True) == x


def test_surrogates_keep_entities_apart():
    key = b"k"
    for kind, values in {"email": [f"{a}{i}@mail{i % 7}.example.com" for a in "abc" for i in range(300)], "phone": [f"({200 + i}) 555-{1000 + i}" for i in range(700)], "card": [f"4111{i:012d}" for i in range(500)], "ip": [f"10.0.{i}.7" for i in range(256)], "name": [f"Mr {n} Ab{c}" for n in pii.GIVEN["m"] for c in "bcdfg"]}.items():
        made = [pii.surrogate(kind, v, key) for v in values]
        assert len(set(made)) == len(set(values)) and not {pii.canonical(kind, v) for v in values} & {pii.canonical(kind, m) for v, m in zip(values, made, strict=True) if v == m}
        assert all([k for k, _, _ in pii.entities(f"x {m} y")] == [kind] for m in made[:50])
    assert pii._luhn(pii.surrogate("card", "4111111111111111", key)[:-1]) == int(pii.surrogate("card", "4111111111111111", key)[-1])
    a, b = pii.surrogate("phone", "+1 (784) 555-8120", key), pii.surrogate("phone", "784-555-8120", key)
    assert re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b) and a.startswith("+1 (")
    assert pii.surrogate("name", "Frau Anna Müller", key).split()[1] in pii.GIVEN["f"]
    assert pii.surrogate("email", "Anna.B@X.example.com", key).lower() == pii.surrogate("email", "anna.b@x.example.com", key)
    iban = pii.surrogate("iban", "DE89 3704 0044 0532 0130 00", key).replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.surrogate("phone", "+33 1 23 45 67 89", key).startswith("+33 ") and pii.surrogate("phone", "030 1234567", key)[0] == "0"


@pytest.mark.parametrize(("script", "of"), [("plain", "abcyz"), ("accented", "aéßþ"), ("Cyrillic", "аяё"), ("Greek", "αως")])
def test_made_up_names_are_distinct(script, of):
    import itertools

    names = ["".join(x) for n in range(1, 6) for x in itertools.product(of, repeat=n)]
    made = {pii.made_up(n, b"k") for n in names if script == "plain" or not n.isascii()}
    assert len(made) == len([n for n in names if script == "plain" or not n.isascii()])


def test_every_capital_and_script():
    key = b"k"
    for c in pii._UP:
        text = f"Mr {c}{c.lower()}x was here, {c}{c.lower()}x left"
        made, kinds = pii.replaced(text, key)
        assert kinds == ["name", "name"] and f" {c}{c.lower()}x" not in made
    made, _ = pii.replaced("Mr Þð and Герр; Елена Ласкова, Ласкова. Δημήτρης Ράλλης. 王伟先生 met Łukasz; Dr. O'Brien, Anna von Trapp-Lang", key)
    for gone in ("Þð", "Елена", "Ласкова", "Δημήτρης", "Ράλλης", "王伟", "Brien", "Anna", "Trapp", "Lang"):
        assert gone not in made
    assert "先生" in made and "von" in made and "Dr. O'" in made


def test_names_agree_within_and_across_texts():
    made = pii.replaced("Mr Smith met John Smith. Smith left; John stayed. Grace under fire.", b"k")[0]
    m = re.fullmatch(r"Mr (\w+) met (\w+) (\w+)\. (\w+) left; (\w+) stayed\. Grace under fire\.", made)
    assert m[1] == m[3] == m[4] != "Smith" and m[2] == m[5] != "John" and m[2] in pii.GIVEN["m"]
    assert pii.replaced("Ask Mrs Smith", b"k")[0] == f"Ask Mrs {m[1]}"


def test_more_formats():
    text = "+33 1 23 45 67 89, +49 30 12345678, +44 20 7946 0958, 030 1234567, 01 23 45 67 89, 3782 822463 10005, 2001:db8::ff00:42:8329, fe80::1ff:fe23:4567:890a; at 10:30, 2024-05-17, 1.5 or 12:30:45"
    assert [k for k, _, _ in pii.entities(text)] == ["phone"] * 5 + ["card", "ip", "ip"]


def test_pii(spark, sf_dir):
    mail = "write to ab.cd9@mail1.example.com or AB.cd9@mail1.example.com, card 4111 1111 1111 1111"
    rows = [*EDGES, (50, mail, "a"), (51, mail, "b"), (52, "Mr Þð, Frau Ÿy and Anna Иванова", "a")] + [(r.doc_id + 100, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    d = docs(spark, rows)
    out = pii.surrogates(d, "k").collect()
    made = {r.doc_id: r.text for r in out}
    assert len(out) == len(rows) and made[50] == made[51] and "ab.cd9" not in made[50] and made[1] is None and made[2] == ""
    mails = re.findall(r"\S+@\S+com", made[50])
    assert mails[0].lower() == mails[1].lower()
    for i, t, _ in rows:
        found = list(pii.entities(t))
        assert found or i is None or made[i] == t
        for _, a, b in found:
            assert t[a:b] not in made[i]
    assert pii.collisions(pii.inventory(d, "k")).count() == 0
    assert pii.surrogates(docs(spark, []), "k").count() == 0


PAGE = '<html><head><title>T</title><style>p{}</style><script>var a="</p>"</script></head><body><header><h1>Site</h1><nav><a href="/x">Home</a></nav></header><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>First<br>part.<p>Second&nbsp;one\n  here &lt;ok&gt;<ul><li>a</li><li>b<li>c</ul><div class="ad">Buy now</div><p>End&am</article><aside><p>See also</p></aside><section class="comments"><div class="comment"><p>Nice!</p></div></section><form><label>Mail</label><input></form><footer>&copy; x'


def test_extraction(spark):
    rows = [(1, "u1", PAGE), (2, None, None), (3, "u3", ""), (None, "u", "<p>just text"), (4, "u", "plain"), (4, "u", "plain"), (5, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>"), (6, "u", "<<>><a><//p><div class='")]
    p = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(p).collect()}
    assert got[1].text == "Title & more First part. Second one here <ok> a b c End&am"
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[3].text == "" and got[5].text == " ".join(["word"] * 20_000)
    assert html_text.extract(p).count() == len(rows) and html_text.extract(p.limit(0)).count() == 0


def test_extraction_on_pages_not_trained_on():
    model, r, wrong = html_text.trained(), random.Random(4321), 0
    for _ in range(100):
        page = html_text.sample_page(r)
        nodes = html_text.flat(html_text.parse(page.replace(html_text.MARK, "")))
        keep = html_text.chosen(nodes, model.margins(html_text.node_features(nodes)))
        marks = html_text.marked(page)
        wrong += any(a != b for a, b, n in zip(keep[1:], marks[1:], nodes[1:], strict=True) if n.length)
        assert all(keep[n.up.number] for n in nodes[1:] if keep[n.number])
    assert wrong <= 3


LONG = "The river ran past the old mill, and nobody in the village could say who had built it first."
NAV, FOOT = '<nav><a href="/">Home</a> <a href="/b">News</a></nav>', "<footer>&copy; 2024 Press</footer>"
#: Written by hand: (page, its main text).
PAGES = [
    (f"<body>{NAV}<h1>Title</h1>{LONG}<br>{LONG}{FOOT}</body>", f"Title {LONG} {LONG}"),
    (f"<html><body>{NAV}<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>{FOOT}</body></html>", f"{LONG} {LONG} {LONG}"),
    (f"<body>{NAV}<div><span>{LONG}</span><br><span>{LONG}</span></div>{FOOT}", f"{LONG} {LONG}"),
    (f"<body>{LONG}", LONG),
    (f"<body>{NAV}<article><p>{LONG}</p></article></article>{LONG} {LONG}", f"{LONG} {LONG} {LONG}"),
    (f"<body>{NAV}<story-text>{LONG}<br>{LONG}</story-text>{FOOT}", f"{LONG} {LONG}"),
    (f'<body><header><h1>Site</h1>{NAV}</header><div id="content"><h2>Head</h2>{LONG}<p>{LONG}</p></div><div class="sidebar"><p>See also this</p></div><div id="comments"><div class="comment"><p>{LONG}</p></div></div>{FOOT}', f"Head {LONG} {LONG}"),
    (f'<table><tr><td>{NAV}</td><td class="content"><p>{LONG}<p>{LONG}</td></tr></table>', f"{LONG} {LONG}"),
]


@pytest.mark.parametrize("i", range(len(PAGES)))
def test_pages_written_by_hand(i):
    page, text = PAGES[i]
    assert html_text.main_texts([page], html_text.trained()) == [text]


BOOKS = "".join(f"<li><a href='/b{i}'>The book number {i}</a></li>" for i in range(10))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>Of quotes</h1><p data-a=o'brien>{LONG}</p><p class=x don't>{LONG}</p></article>", f"Of quotes {LONG} {LONG}"),
        (f"""<article><p title="a > b" data-x='1 > 0' y = "<p>">{LONG}</p><p a=b"c d>{LONG}</p></article>""", f"{LONG} {LONG}"),
        (f'<article><p>{LONG}</p><a title="never closed>on it goes</a><p>{LONG}</p></article>', f"{LONG} on it goes {LONG}"),
        (f"<article><h1>Ten books</h1><ol>{BOOKS}</ol></article>", "Ten books " + " ".join(f"The book number {i}" for i in range(10))),
        (f"<nav><ul>{BOOKS}</ul></nav><article><p>{LONG}</p></article><div class=related><ul>{BOOKS}</ul></div>", LONG),
        (f"<article><p title='class=nav id=footer'>{LONG}</p></article>", LONG),
    ],
)
def test_attributes_and_lists_of_links(page, text):
    assert html_text.main_texts([page], html_text.trained()) == [text]


def test_unclosed_quotes_take_linear_time():
    began = time.time()
    html_text.parse("<a b='c>" * 50_000 + '<i j="')
    html_text.parse("<a =" * 100_000)
    assert time.time() - began < 10


def test_deep_pages_are_quick():
    import time

    html_text.trained()
    began = time.time()
    for page in ("<div>" * 8000 + "</p>" * 8000 + "x", "<center>" * 8000 + "<p>x" + "</div>" * 8000, "<ul><li>" * 4000 + "</dd>" * 8000, "<p><b>" * 8000, "<a-b>" * 8000):
        html_text.main_texts([page], html_text.trained())
    assert time.time() - began < 10


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages(spark, sf):
    import html

    sf_dir = f"/root/testdata/{sf}"

    for r in html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", b.replace("<br>", " ")))).strip() for b in re.split("</?(?:p|h1)>", inner))
        assert r.text == " ".join(b for b in blocks if b)


def test_quality_model(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_model.scored(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    pairs = [(a.score, b.score) for a in rows if a.quality == 1 for b in rows if b.quality == 0]
    assert sum(a > b for a, b in pairs) >= 0.95 * len(pairs)


def test_quality_model_edges(spark):
    d = docs(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality_model.scored(d, none).collect()} == {1}
    odd = spark.createDataFrame([(1, None, 0), (2, 1, 0), (2, 0, 1), (3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.scored(d, odd).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert quality_model.scored(docs(spark, []), none).count() == 0
    import zlib

    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in out)


def plain_scores(rows, order):
    texts = [(t or "").lower().encode().split() for _, t, _ in rows]
    padded = [["\x01"] * (order - 1) + t for t in texts]
    n = Counter(tuple(p[i - k : i]) for p, t in zip(padded, texts, strict=True) if t for k in range(1, order + 1) for i in range(order, len(p) + 1))
    for t in texts:  # the opening contexts
        if t:
            n.update(("\x01",) * k for k in range(1, order))
    total = sum(map(len, texts))

    def log_score(context, word):
        if not context:
            return math.log(n[word,] / total)
        gram = (*context, word)
        return math.log(n[gram] / n[context]) if n[gram] >= 2 else math.log(0.4) + log_score(context[1:], word)

    return Counter((r[0], len(t), round(sum(log_score(tuple(p[i : i + order - 1]), w) for i, w in enumerate(t)), 4)) for r, t, p in zip(rows, texts, padded, strict=True))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(spark, sf_dir, order):
    rows = EDGES + [(r.doc_id + 100, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    got = lm_score.score(docs(spark, rows), order=order).collect()
    assert Counter((r.doc_id, r.n_tokens, round(r.log_score, 4)) for r in got) == plain_scores(rows, order)


def test_lm_scores_in_pieces(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_TOKENS", 700)
    monkeypatch.setattr(lm_score, "ROWS_SENT", 300)
    rows = EDGES * 3 + [(r.doc_id % 7, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    got = lm_score.score(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_tokens, round(r.log_score, 4)) for r in got) == plain_scores(rows, 3)


def shuffle_bytes(spark):
    """What the session's shuffles hold on disk."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(f.stat().st_size for d in folders for f in pathlib.Path(d).rglob("shuffle_*.data"))


def test_lm_scores_drop_what_was_shuffled(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SLICE_GRAMS", 50_000)
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(1000)), "a") for i in range(200)] + EDGES
    before = shuffle_bytes(spark)
    got = lm_score.score(docs(spark, rows))
    for _ in range(50):  # files go a little later
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_bytes(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert Counter((r.doc_id, r.n_tokens, round(r.log_score, 4)) for r in got.collect()) == plain_scores(rows, 3)


def test_lm_scores_lay_out_texts_once(spark):
    plan = lm_score.score(docs(spark, EDGES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_lm_scores_of_nothing(spark):
    assert lm_score.score(docs(spark, [])).count() == 0
    assert [(r.n_tokens, r.mean_log_score) for r in lm_score.score(docs(spark, [(1, None, None)])).collect()] == [(0, None)]


def test_licenses(spark):
    mit = licenses.NOTICES["MIT"][-1]
    rows = [(1, "a/b/LICENSE", mit), (2, "a/b/c/x", "hello"), (3, "a/y", "hello\nReleased under the MIT License. And so on"), (4, "LICENSE", "Licensed under the Apache License, Version 2.0."), (5, None, None), (6, "a/b/c/d/e", None), (7, "a/z", "the licensee talked about permission and other things at length"), (7, "a/z", "the licensee talked about permission and other things at length"), (8, "q", "")]
    f = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, license string")
    got = Counter((r.doc_id, r.own_license, r.inherited_license, r.license) for r in licenses.scan(f).collect())
    want = [(1, "MIT", "MIT", "MIT"), (2, None, "MIT", "MIT"), (3, "MIT", "Apache-2.0", "MIT"), (4, "Apache-2.0", "Apache-2.0", "Apache-2.0"), (5, None, None, None), (6, None, "MIT", "MIT"), (7, None, "Apache-2.0", "Apache-2.0"), (7, None, "Apache-2.0", "Apache-2.0"), (8, None, "Apache-2.0", "Apache-2.0")]
    assert got == Counter(want)
    assert licenses.scan(f.limit(0)).count() == 0


BSD = licenses.TEXTS["BSD-3-Clause"]
APACHE = licenses.NOTICES["Apache-2.0"][-1]


def wrapped(text, sign, width=60):
    import textwrap

    return "\n".join(sign + line for line in textwrap.wrap(text, width))


def test_whole_licence_files_and_wrapped_headers(spark):
    mit = "MIT License\n\nCopyright (c) 2024 Jane Roe\n\n" + "\n\n".join(wrapped(t, "") for t in licenses.TEXTS["MIT"][28:].split(" THE SOFTWARE IS"))
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n\n" + "Preamble text about freedom. " * 400
    header = "/*\n" + " * Copyright 2020 Some Company\n *\n" + wrapped(APACHE, " * ") + "\n */\n\n" + "\n".join(f"int field{i} = other{i};" for i in range(90))
    rows = [("m/LICENSE", mit), ("m/src/a.c", "int x;"), ("b/LICENSE", "Copyright (c) 2001, The Authors\nAll rights reserved.\n\n" + wrapped(BSD, "")), ("b/deep/er/x", None), ("g/COPYING", gpl), ("g/x/y.c", ""), ("m/h.c", header), ("m/py/t.py", wrapped(APACHE, "# ") + "\n\n" + " ".join(f"name{i} = {i}" for i in range(90))), ("z/readme", "A story.\n\n" + "It went on without a licence, free of charge and of warranty. " * 40), ("m/h2/f", "x")]
    f = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: (r.own_license, r.inherited_license, r.license) for r in licenses.scan(f).collect()}
    assert got == {
        "m/LICENSE": ("MIT", "MIT", "MIT"), "m/src/a.c": (None, "MIT", "MIT"), "b/LICENSE": ("BSD-3-Clause", "BSD-3-Clause", "BSD-3-Clause"), "b/deep/er/x": (None, "BSD-3-Clause", "BSD-3-Clause"), "g/COPYING": ("GPL-3.0", "GPL-3.0", "GPL-3.0"), "g/x/y.c": (None, "GPL-3.0", "GPL-3.0"),
        "m/h.c": ("Apache-2.0", "MIT", "Apache-2.0"), "m/py/t.py": ("Apache-2.0", "MIT", "Apache-2.0"), "z/readme": (None, None, None), "m/h2/f": (None, "MIT", "MIT"),
    }


def plain_cosines(text):
    weights, idf, unknown = licenses.template_terms()
    v = {w: (1 + math.log(n)) * idf.get(w, unknown) for w, n in Counter(re.findall("[a-z0-9]+", text.lower())).items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return [sum(x * weights[w][i] for w, x in v.items() if w in weights) / norm if norm else 0.0 for i in range(len(licenses.TEMPLATES))]


def test_cosine_against_plain(spark):
    texts = ["Released under the MIT License.", "this file is under the Apache License version 2.0 of old", "permission to copy permission"]
    got = {r.k: (r.license, r.similarity) for r in licenses.similar(spark.createDataFrame(list(enumerate(texts)), "k int, line string"), ["k"], "line").collect()}
    for k, t in enumerate(texts):
        sims = plain_cosines(t)
        assert got[k] == (licenses.TEMPLATES[max(range(len(sims)), key=lambda i: round(sims[i], 6))][0], round(max(sims), 6))


def test_bounds_lose_nothing(spark):
    """Parts of templates, mixed with other words: what reaches the limit has a cue and passes the bound."""
    r = random.Random(8)
    texts = [""]
    for _ in range(400):
        words = r.choice(licenses.TEMPLATES)[2].split()
        part = [w for w in words if r.random() < r.choice([0.5, 0.8, 1.0])] + [f"x{r.randint(0, 99)}" for _ in range(r.randint(0, len(words) // 2))]
        texts.append(" ".join(part))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", licenses.reachable(F.col("t"), 0.75).alias("may"))
    may, cues = {r.k: r.may for r in d.collect()}, set(licenses.cues(0.75))
    reached = [k for k, t in enumerate(texts) if max(plain_cosines(t)) >= 0.75]
    assert len(reached) > 100 and all(may[k] and cues & set(re.findall("[a-z0-9]+", texts[k].lower())) for k in reached)
    assert not may[0]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in d.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf_dir)
        assert name == "mixing" or out.columns == d.columns
        assert {r.doc_id for r in out.collect()} <= ids
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert len(corpus_pipeline.STAGES) == 5


def test_queries_keep_rows(spark, sf_dir):
    from storyloom.llm.queries import QUERIES

    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_mixing", "op4_simhash_dedup", "op5_secrets", "op10_quality_rules"):
        assert QUERIES[name](spark, sf_dir).select(F.count_distinct("doc_id")).first()[0] == n


def test_quality_model_sample_is_bounded(spark):
    """Rows that share a doc_id count once in the sample, whatever their number; ties at the threshold are predicted 1."""
    words = " ".join(f"w{i}" for i in range(60))
    d = docs(spark, [(1, words, "a")] * 300 + [(2, "# | # | " * 30, "a")] * 300 + [(i, words + f" {i}", "a") for i in range(3, 40)])
    labels = spark.createDataFrame([(i, int(i != 2), 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(d, labels, sample_rows=10)
    assert model.score(model.mean[None]).shape == (1,)
    out = quality_model.scored(d, labels).collect()
    assert len(out) == d.count() and all(r.predicted == (r.score >= 0.3) for r in out)


def test_many_licences_by_name_and_text(spark):
    """Each licence by its identifier and its notices, in a comment before code; whole texts and openings as files of a folder of their own."""
    rows, want = [], {}
    for i, (name, notices) in enumerate(licenses.NOTICES.items()):
        for k, notice in enumerate(notices):
            rows.append((f"src/{i}/{k}.c", f"// {notice}\n\nint f{i}(void) {{ return {k}; }}\n" + "".join(f"value{j} = {j};\n" for j in range(60))))
            want[rows[-1][0]] = (name, None)
    for i, (name, text) in enumerate([*licenses.TEXTS.items(), *((n, f"{t}\n\nPreamble\n\n" + "The rest of it is left out of this test, which has other words. " * 30) for n, t in licenses.OPENINGS.items())]):
        rows += [(f"all/{i}/LICENSE", wrapped(text, "") if "Preamble" not in text else text), (f"all/{i}/deep/down/file", "nothing of the kind")]
        want |= {rows[-2][0]: (name, name), rows[-1][0]: (None, name)}
    rows += [("q/a", "SPDX-License-Identifier: Foo-9.9"), ("q/b", "We were licensed to sell, and the version was free of charge.")]
    want |= {"q/a": (None, None), "q/b": (None, None)}
    found = {r.path: (r.own_license, r.inherited_license) for r in licenses.scan(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")).collect()}
    assert {k: (v, found[k]) for k, v in want.items() if found[k] != v} == {}
    assert len({n for n, _, _ in licenses.TEMPLATES}) >= 20


def test_inheritance_against_a_walk(spark):
    r = random.Random(12)
    names = ["MIT", "ISC", "Zlib", "0BSD"]
    rows = []
    for i in range(250):
        path = "/".join([r.choice("abc") for _ in range(r.randint(0, 5))] + [f"f{i}"])
        rows.append((i, path, licenses.TEXTS[r.choice(names)] if r.random() < 0.06 else r.choice(["plain", "", None])))
    covers = {}
    for _, path, text in rows:
        if text and len(text) > 100:
            name = next(n for n, t in licenses.TEXTS.items() if t == text)
            at = path.rpartition("/")[0]
            covers[at] = min(covers.get(at, "~"), name)
    found = {x.doc_id: (x.inherited_license, x.inherited_from) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for i, path, _ in rows:
        at, want = path, (None, None)
        while at:
            at = at.rpartition("/")[0]
            if at in covers:
                want = (covers[at], at)
                break
        assert found[i] == want
    assert len({x for x in found.values()}) > 4
