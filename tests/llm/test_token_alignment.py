"""Token alignment against whole texts, byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from storyloom.llm import token_alignment as ta

DDL = "doc_id long, text string, n_a string, chunk string, pair string, best string, words string"


@pytest.fixture(scope="module")
def files():
    with open(f"{ta.FOLDER}/byte_bpe_50k.json", encoding="utf-8") as f, open(f"{ta.FOLDER}/piece_bpe_32k.model", "rb") as g:
        return f.read(), g.read()


def plain(made, text):
    """Groups of ids and links of one text: encoded whole, owners looked up for each byte."""
    if not text:
        return None
    a = made.a.encode(f" {text}", add_special_tokens=False).ids
    b = made.b.encode(text)
    whole = f" {text}".encode()
    if b"".join(made.a_bytes[i] for i in a) != whole or b"".join(made.b_bytes[i] for i in b) != whole:
        return None
    owner_a = [k for k, i in enumerate(a) for _ in made.a_bytes[i]]
    owner_b = [k for k, i in enumerate(b) for _ in made.b_bytes[i]]
    links = sorted(set(zip(owner_a, owner_b, strict=True)))
    groups, ids_a, ids_b = [], [], []
    for at in range(len(whole)):
        last = at + 1 == len(whole)
        end_a, end_b = last or owner_a[at + 1] != owner_a[at], last or owner_b[at + 1] != owner_b[at]
        if end_a:
            ids_a.append(a[owner_a[at]])
        if end_b:
            ids_b.append(b[owner_b[at]])
        if end_a and end_b:
            groups.append((ids_a, ids_b))
            ids_a, ids_b = [], []
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def expected(made, rows):
    found = [(i, plain(made, t)) for i, t in rows]
    count = Counter(p for _, x in found if x for p in x[3])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = [
    "Anat with by of nteres atre are.\nThnt eringing onheed.",
    "",
    None,
    " leading and trailing  ",
    "a\n b \n  c\t d　 e  f",
    "naïve café 日本語のテキスト 龠🧿👩‍👩‍👧 x",
    "<|endoftext|> <s> <unk> </s> <0x0A> a<0x41>b",
    "▁ word▁ next ▁▁x",
    "don't we'll 1234567 12a -- ___ ''' '",
    "\x00\x01\x1c \x1f x\x85 y",
    "é Ａ ﬁ ½ İ ǅ",
    "word " * 300,
    "龠" * 700,
    "same words same words",
    "same words same words",
    "﻿bom ​ zero‍ width \U0010ffff ",
]


def test_against_whole_texts(spark, files):
    made = ta.models(*files)
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (3, "id again"), (3, "id again")]
    df = spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], DDL).repartition(3)
    for chars, remembered in ((ta.CHUNK_CHARS, ta.REMEMBERED), (50, 40)):
        assert sorted(map(tuple, ta.alignment(df, chunk_chars=chars, remembered=remembered).collect()), key=str) == expected(made, rows)
    assert ta.alignment(df.where("false")).collect() == []
    none = ta.alignment(df.where("text is null or text = ''")).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_given_documents(spark, sf_dir, files):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ta.alignment(docs).collect()), key=str) == expected(ta.models(*files), rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\tab'1é▁龠🧿. "), st.characters(exclude_categories=["Cs"])), max_size=25), min_size=1, max_size=4))
@example(["x ", " x", "  ", "\n"])
def test_any_text(files, texts):
    known = ta.Aligned(ta.models(*files))
    batch = ta.chunk_rows(known, 0, list(range(len(texts))), texts).to_pylist()
    links, sizes, words = (ta.unpacked(batch[-1][c]) for c in ("links", "sizes", "words"))
    ends = np.cumsum(sizes).tolist()
    for row, text in zip(batch, texts, strict=False):
        found = plain(known.models, text)
        if found is None:
            assert row["n_a"] == row["n_links"] == 0 and row["n_words"] == 0 and row["groups_sha256"] == ""
            continue
        a, b, groups, pairs = found
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"], row["groups_sha256"]) == (len(a), len(b), len(groups), len(pairs), hashlib.sha256(shown.encode()).hexdigest())
        own = [batch[-1]["pairs"][k] for w in words[row["first"] : row["first"] + row["n_words"]] for k in links[([0, *ends])[w] : ends[w]]]
        assert own == [(x << 32) | y for x, y in pairs]


def test_ends_of_ragged_tokens():
    # a sign of four bytes as 3 + 1 bytes, each said to cover all of it; then as four byte pieces of which only the last covers it
    assert ta.token_ends(np.array([[0, 1], [1, 5], [1, 5], [5, 7]]), np.array([1, 3, 1, 2])).tolist() == [1, 4, 5, 7]
    assert ta.token_ends(np.array([[0, 1], [1, 1], [1, 1], [1, 1], [1, 5], [5, 6]]), np.array([1, 1, 1, 1, 1, 1])).tolist() == [1, 2, 3, 4, 5, 6]
    assert ta.token_ends(np.array([[0, 3], [0, 3], [3, 4]]), np.array([1, 2, 1])).tolist() == [1, 3, 4]
