"""Text functions and chapter splitting on small fixtures worked out by hand."""

from pyspark.sql import functions as F
from storyloom.functions import text
from storyloom.operators import chapters
from storyloom.plans import queries
from storyloom.sources import stores


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numerals(spark):
    assert column(spark, ["十", "二十三", "一百零五", "两百", "一二三", "〇", "零"], text.numeral_value) == [10, 23, 105, 200, 3, None, None]
    want = ["零", "七", "十", "十一", "二十", "二十三", "一百零五", "一百十", "一千"]
    assert column(spark, [0, 7, 10, 11, 20, 23, 105, 110, 1000], text.numeral, "int") == want


def test_numbers_without_numeral(spark):
    assert column(spark, [9999, 10_000, 51_282, None], text.numeral, "int") == ["九千九百九十九", None, None, None]


def test_chapter_numerals_beyond_9999(spark, tmp_path):
    rows = [(n - 1, "x", "s") for n in (7, 9999, 10_000, 45_123)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.number: (r.numeral, r.value) for r in queries.chapter_numerals(spark, str(tmp_path)).collect()}
    assert got == {7: ("七", 7), 9999: ("九千九百九十九", 9999), 10_000: (None, 10_000), 45_123: (None, 45_123)}


def test_trimmed_leaves_other_marks(spark):
    """A next-line mark is no blank, so what stands before it stays, at the end of a text too."""
    texts = ["a \x85", " \x85 a\u3000\n", "\ufeff\t\u2028a b\xa0\r\n", "\u2003 \n", "", None]
    assert column(spark, texts, text.trimmed) == ["a \x85", "\x85 a", "a b", "", "", None]
    assert column(spark, texts, text.without_blanks) == ["a\x85", "\x85a", "ab", "", "", None]


def test_headings(spark):
    lines = ["第一章 甄士隐", "第四章中既将", "　第二章 x", "1、庙会", "2、", "第一千章 x", "第二章　 b "]
    assert column(spark, lines, text.is_heading) == [True, False, False, True, True, False, True]
    assert column(spark, lines, text.heading_title)[3:5] == ["庙会", "第2章"] and column(spark, lines, text.heading_title)[6] == "b"


def test_blanks(spark):
    assert column(spark, ["　﻿a b ", "\x0b", None], text.trimmed) == ["a b", "", None]
    assert column(spark, ["一二三四五六七八九十一　二", "一二三四五六七八九十一二三"], text.is_short) == [True, False]
    assert column(spark, ["“走。”他说，《a》 b"], text.sentence_clean) == ["走他说ab"]
    assert column(spark, ["（走）a"], text.query_clean) == ["走a"] and column(spark, ["（走）a"], text.token_clean) == [" 走 a"]


def test_fnv_and_rounding(spark):
    assert column(spark, ["AB", "", "庙"], text.fnv1a)[:2] == [752165258, 2166136261]
    df = spark.createDataFrame([(3 / 200, 2), (1 / 8, 2), (1.005, 2), (None, 2)], "x double, p int")
    assert [r.y for r in df.select(text.fixed("x", "p").alias("y")).collect()] == [0.01, 0.13, 1.0, None]
    assert all(0.6 <= t < 1.3 for t in column(spark, ["a", "b", "第"], text.temperature))


def test_markdown_blocks_names(spark):
    assert column(spark, ["# T\n- **a** `x`\n---\n> [l](u)\n```\ncode\n```\n1. b"], text.markdown_length) == [4]
    assert column(spark, ["　# 题", "\u00a0- 甲", "　---　\n乙", "a # b", "x\u0085# y"], text.markdown_length) == [1, 1, 1, 3, 4]
    assert column(spark, ["a\n \nb", "x\n### y", "3. a", "plain"], text.has_user_blocks) == [True, True, True, False]
    assert column(spark, ["a/b，c d", "？", "x" * 20], text.safe_name) == ["abcd", "未命名", "x" * 12]
    assert column(spark, ["红楼梦", "a/b"], text.is_corpus_name) == [True, False]
    assert column(spark, [7, 12345], text.padded, "int") == ["0007", "12345"]


def test_chapters(spark):
    corpora = spark.createDataFrame([("b", "intro\r\n第一章 a\r\nx\ny\n第二章 b\nz")], "project string, text string")
    lines = stores.corpus_lines(corpora)
    assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()][:2] == [(0, "intro"), (1, "第一章 a")]
    found = chapters.headings(lines)
    assert [(r.number, r.start, r.end) for r in chapters.ranges(lines, found).orderBy("start").collect()] == [(1, 2, 4), (2, 5, 6)]
    bodies = chapters.bodies(corpora).orderBy("start").collect()
    assert [(r.body, r.chars) for r in bodies] == [("x\ny", 3), ("z", 1)]
    listed = chapters.ranges(lines, found)
    assert [(r.body, r.chars) for r in chapters.bodies_of_list(corpora, listed).orderBy("start").collect()] == [("x\ny", 3), ("z", 1)]


def test_number_repair(spark):
    rows = [("b", 0, 1, "a"), ("b", 3, 1, "b"), ("b", 5, None, "c"), ("b", 9, 2, "d")]
    found = spark.createDataFrame(rows, "project string, line_no int, number int, title string")
    assert [r.number for r in chapters.repaired_numbers(found).orderBy("line_no").collect()] == [1, 2, 3, 4]


def test_chapter_list(spark):
    rows = spark.createDataFrame([("b", x) for x in ["1,a,b,c,3,9,20", "2,t,5-9", "junk", "章号,标题"]], "project string, line string")
    got = [(r.number, r.title, r.start, r.end, r.chars) for r in stores.parse_chapter_list(rows).orderBy("number").collect()]
    assert got == [(1, "a,b,c", 3, 9, 20), (2, "t", 5, 9, None)]


def test_synthetic_corpus(spark):
    m = spark.createDataFrame([("b", 1, "﻿# One\na b\nc"), ("b", 2, "x"), ("b", 12, "# T")], "project string, number int, content string")
    got = [(r.heading, r.title, r.start, r.end, r.chars) for r in chapters.synthetic_corpus(m).orderBy("number").collect()]
    assert got == [("第一章 One", "One", 1, 3, 3), ("第二章 ", "第2章", 4, 5, 1), ("第十二章 T", "T", 6, 6, 0)]


def test_files(spark, tmp_path):
    book = tmp_path / "store" / "甲project" / "分镜标注" / "json"
    book.mkdir(parents=True)
    (book / "第0001章.json").write_text('{"shots":[{"id":"1","type":"信息","funcs":["推进"],"label":"a","sentenceIds":["S1"]}]}', encoding="utf-8")
    (book / "第0002章.json").write_text('{"shots":[', encoding="utf-8")
    good, bad = stores.read_layer(spark, str(tmp_path / "store"), stores.SHOT_DOCUMENT)
    assert [(r.project, r.chapter, r.shot_id) for r in stores.flat_shots(good).collect()] == [("甲", 1, "1")]
    assert [r.chapter for r in bad.collect()] == [2]
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "甲-语料.txt").write_text("a\nb", encoding="utf-8")
    assert [(r.project, r.text) for r in stores.read_corpora(spark, str(tmp_path / "corpus")).collect()] == [("甲", "a\nb")]
    (tmp_path / "my" / "乙").mkdir(parents=True)
    (tmp_path / "my" / "乙" / "第0003章.md").write_text("# 题\n文", encoding="utf-8")
    assert [(r.project, r.number, r.title) for r in stores.read_manuscripts(spark, str(tmp_path / "my")).collect()] == [("乙", 3, "题")]
    rows = spark.createDataFrame([("p", 2, "b", 3, 4, 5), ("p", 1, "a", 1, 2, 5), ("q", 1, "c", 0, 1, 5)], "project string, number int, title string, start int, end int, chars int")
    stores.write_chapter_lists(rows, str(tmp_path / "lists"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lists" / "project=p")).collect())[:2] == ["1,a,1,2,5", "2,b,3,4,5"]
    stores.publish(rows, str(tmp_path / "out"))
    stores.publish(rows.where("project = 'q'").withColumn("title", F.lit("new")), str(tmp_path / "out"))
    assert {(r.project, r.title) for r in stores.read_published(spark, str(tmp_path / "out")).collect()} == {("p", "a"), ("p", "b"), ("q", "new")}
    stores.write_split_chapters(rows, str(tmp_path / "split"))
    assert {r.file_name for r in spark.read.parquet(str(tmp_path / "split")).collect()} == {"第0001章_a.txt", "第0002章_b.txt", "第0001章_c.txt"}
    (tmp_path / "tasks").mkdir()
    (tmp_path / "tasks" / "1.json").write_text('{"id":\n "7"}', encoding="utf-8")
    got = stores.read_documents(spark, str(tmp_path / "tasks"), "id string, status string").collect()
    assert [(r.id, r.status) for r in got] == [("7", None)]


def test_stream(spark, tmp_path):
    from storyloom.streaming import incremental

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    step = incremental.into_batches(out, lambda df: df.withColumn("y", F.col("x") * 2))
    schema = spark.createDataFrame([], "x int").schema
    for part in ([1, 2], [3]):
        spark.createDataFrame([(x,) for x in part], "x int").coalesce(1).write.mode("append").parquet(source)
        incremental.run_available(spark, source, schema, step, str(tmp_path / "state"))
    assert sorted(r.y for r in spark.read.parquet(out).collect()) == [2, 4, 6]
