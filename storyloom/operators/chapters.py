"""Raw books to chapters: headings, numbers, ranges, bodies, and corpora made from manuscripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import heading_number, heading_title, is_heading, numeral, trimmed, without_blanks
from storyloom.operators.scan import following, running_sums


def headings(lines: DataFrame) -> DataFrame:
    """(project, line_no, number, title) of the lines that open a chapter."""
    line = F.col("line")
    return lines.where(is_heading(line)).select("project", "line_no", heading_number(line).alias("number"), heading_title(line).alias("title"))


def repaired_numbers(found: DataFrame) -> DataFrame:
    """T4: numbers in line order; a missing, non-positive or repeated one becomes the next unused count. One book's headings are one group."""

    def repair(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("line_no")
        used: set[int] = set()
        count, out = 0, []
        for n in book["number"]:
            if pd.isna(n) or n <= 0 or int(n) in used:
                count += 1
                while count in used:
                    count += 1
                n = count
            used.add(int(n))
            out.append(int(n))
        return book.assign(number=out)

    return found.groupBy("project").applyInPandas(repair, "project string, line_no int, number int, title string")


def ranges(lines: DataFrame, found: DataFrame) -> DataFrame:
    """T5: (project, line_no, number, title, start, end): from the line after the heading up to the next heading, or the book's end."""
    ends = lines.groupBy("project").agg((F.max("line_no") + 1).alias("n_lines"))
    rows = following(found, ["project"], "line_no", "next").join(ends, "project")
    return rows.select("project", "line_no", "number", "title", (F.col("line_no") + 1).alias("start"), F.coalesce("next", "n_lines").alias("end"))


def book_lines(text: str) -> Column:
    return F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)


def between(lines: str, start: Column, end: Column) -> Column:
    """The lines [start, end) of a book, as far as it has them. Cut within the book's row, so what is made is as long as the lines asked for."""
    n = F.size(lines)
    start, end = F.least(start, n), F.least(end, n)
    return F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n")


def bodies(corpora: DataFrame) -> DataFrame:
    """(project, start, body, chars): the text of each chapter and its size with line breaks. A book is one row, so its lines are cut in place, without a shuffle."""
    rows = corpora.select("project", book_lines("text").alias("lines"))
    opens = F.filter(F.transform("lines", lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())
    rows = rows.select("project", "lines", opens.alias("opens"))

    def chapter(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("opens", k + 1), F.size("lines"))
        return F.struct((i + 1).alias("start"), end.alias("end"), between("lines", i + 1, end).alias("body"))

    return rows.select("project", F.explode(F.transform("opens", chapter)).alias("c")).select("project", "c.start", "c.end", "c.body").withColumn("chars", F.length("body"))


def bodies_of_list(corpora: DataFrame, chapter_list: DataFrame) -> DataFrame:
    """T6 for a list from outside: each row's lines [start, end) of its book's text. A book's ranges are gathered beside its text, which is split once, and its bodies are cut
    in that row: no row repeats the text, and the work grows with the lines. Ranges beyond the text are empty; books without a text have no rows."""
    range_ = F.struct("number", "title", "start", "end")
    listed = chapter_list.groupBy("project").agg(F.collect_list(range_).alias("ranges"))  # of numbers and titles: less than the book's text
    rows = corpora.join(listed, "project").select("project", "ranges", book_lines("text").alias("lines"))
    body = F.transform("ranges", lambda r: F.struct(r["number"].alias("number"), r["title"].alias("title"), r["start"].alias("start"), r["end"].alias("end"), between("lines", r["start"], r["end"]).alias("body")))
    return rows.select("project", F.explode(body).alias("c")).select("project", "c.*").withColumn("chars", F.length("body"))


def synthetic_corpus(manuscripts: DataFrame) -> DataFrame:
    """Rows (project, number, title, heading, body, start, end, chars) of the corpus made from a book's manuscripts; chars leave blanks out."""
    text = F.regexp_replace(F.regexp_replace("content", "\r\n", "\n"), "^﻿", "")
    m = manuscripts.withColumn("text", text)
    title = trimmed(F.regexp_extract("text", r"^#\s+([^\n]+)", 1))
    has = F.col("text").rlike(r"^#\s+[^\n]+")
    body = F.when(has, F.when(F.col("text").contains("\n"), F.regexp_replace("text", r"^[^\n]*\n", "")).otherwise(None)).otherwise(F.col("text"))
    m = m.select("project", "number", F.when(has, title).otherwise("").alias("found"), body.alias("body"))
    n_lines = F.when(F.col("body").isNull(), 0).otherwise(F.size(F.split("body", "\n", -1)))
    m = m.withColumn("n_lines", n_lines)
    # only numbers are scanned; the texts are met again by chapter
    ends = running_sums(m.select("project", "number", "n_lines"), ["project"], ["number"], {"end": F.col("n_lines") + 1}).select("project", "number", "end")
    m = m.join(ends, ["project", "number"])
    heading = F.concat(F.lit("第"), F.coalesce(numeral(F.col("number")), F.col("number").cast("string")), F.lit("章 "), F.col("found"))
    shown = F.when(F.col("found") == "", F.concat(F.lit("第"), F.col("number").cast("string"), F.lit("章"))).otherwise(F.col("found"))
    return m.select("project", "number", shown.alias("title"), heading.alias("heading"), F.coalesce("body", F.lit("")).alias("body"), (F.col("end") - F.col("n_lines")).alias("start"), "end", F.length(without_blanks(F.coalesce("body", F.lit("")))).alias("chars"))


def restored_list(chapters: DataFrame) -> DataFrame:
    """A chapter list whose sizes are estimated from its line ranges."""
    return chapters.select("project", "number", "title", "start", "end", ((F.col("end") - F.col("start") + 1) * 50).alias("chars"))


def missing(listed: DataFrame, done: DataFrame) -> DataFrame:
    """Listed chapters that aren't annotated."""
    return listed.join(done, ["project", "number"], "left_anti")


def in_list(c: Column, values: list[str]) -> Column:
    return F.coalesce(c.isin(values), F.lit(False))
