"""Text functions with the semantics that the annotation tools rely on, as column expressions.

White space here is wider than Java's ``\\s``: it covers the ideographic space, the no-break spaces and the byte-order mark.
Lengths and positions count code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANKS = [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
BLANK = r"[\t\n\x0B\f\r" + "".join(map(chr, _BLANKS)) + "]"
BLANKS = "\t\n\x0b\f\r" + "".join(map(chr, _BLANKS))
_INDENT = BLANK.replace("\\n", "")  # blanks within a line
#: The marks that are left out, the heading forms, and the Markdown forms in ``markdown_length``.
SENTENCE_MARKS = "，。！？…、；：\"'“”‘’—–·《》「」『』【】〈〉"
QUERY_MARKS = "，。！？…、；：\"“”‘’「」『』—–·〈〉（）《》"
TOKEN_MARKS = "[]（）()【】「」『』、，。！？：；“”‘’\"'—–·〈〉《》"
_DIGITS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_UNITS = {"十": 10, "百": 100, "千": 1000}
_HEADING = f"^第([一二三四五六七八九十百零〇两]+)章{BLANK}+(.+)$"
_LISTED = "^([0-9]+)、(.*)$"


def _any_of(marks: str) -> str:
    """A pattern for one of the marks or a blank. ASCII text never meets the long class of other characters, which is tried one by one."""
    plain = "".join("\\" + c if c in "[]" else c for c in marks if c.isascii())
    other = "".join(c for c in marks if not c.isascii()) + "".join(chr(b) for b in _BLANKS if b > 0x7F)
    return f"[{plain}\\t\\n\\x0B\\f\\r ]|(?![\\x00-\\x7F])[{other}]"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return trimmed(F.coalesce(c, F.lit(""))) == ""


def without_blanks(c: Column) -> Column:
    return F.regexp_replace(c, _any_of(""), "")


def sentence_clean(c: Column) -> Column:
    """Marks, quotes and blanks out, for character statistics."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _any_of(SENTENCE_MARKS), "")


def query_clean(c: Column) -> Column:
    """A query for the token channel."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _any_of(QUERY_MARKS), "")


def token_clean(c: Column) -> Column:
    """A text for the tokenizer; marks become spaces."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _any_of(TOKEN_MARKS), " ")


def is_short(c: Column, most: int = 12) -> Column:
    """T11."""
    return F.length(without_blanks(F.coalesce(c, F.lit("")))) <= most


def numeral_value(c: Column) -> Column:
    """Value of a Chinese numeral; a unit alone counts once, of digits in a row the last one counts, 0 and unknown characters give null."""
    digit, unit = (F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in (_DIGITS, _UNITS))
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"), F.lit(True).alias("good"))

    def step(s: Column, x: Column) -> Column:
        d, u = digit[x], unit[x]
        total = F.when(u.isNotNull(), s["total"] + F.when(s["now"] == 0, 1).otherwise(s["now"]) * u).otherwise(s["total"])
        now = F.when(d.isNotNull(), d).otherwise(F.when(u.isNotNull(), 0).otherwise(s["now"]))
        return F.struct(total.cast("int").alias("total"), now.cast("int").alias("now"), (s["good"] & (d.isNotNull() | u.isNotNull())).alias("good"))

    return F.aggregate(chars, start, step, lambda s: F.when(s["good"] & (s["total"] + s["now"] > 0), s["total"] + s["now"]))


def numeral(n: Column) -> Column:
    """A number up to 9999 as a Chinese numeral; larger ones have none (null)."""
    names = F.array(*[F.lit(x) for x in "零一二三四五六七八九"])

    def name(d: Column) -> Column:
        return F.get(names, d.cast("int"))

    k, h, t, o = (F.floor(n / 1000), F.floor(n / 100) % 10, F.floor(n / 10) % 10, n % 10)
    ones = F.when(o == 0, "").otherwise(name(o))
    tens = F.concat(F.when(t == 0, F.when(o == 0, "").otherwise("零")).when((t == 1) & (n % 100 == n), "十").otherwise(F.concat(name(t), F.lit("十"))), ones)
    tens_in = F.when(t == 0, F.when(o == 0, "").otherwise(F.concat(F.lit("零"), ones))).when(t == 1, F.concat(F.lit("十"), ones)).otherwise(F.concat(name(t), F.lit("十"), ones))
    hundreds = F.concat(name(h), F.lit("百"), tens_in)
    rest = F.when(n % 1000 == 0, "").when(n % 1000 < 100, F.concat(F.lit("零"), F.when((t == 0) & (o > 0), name(o)).otherwise(tens_in))).otherwise(hundreds)
    return F.when(n <= 0, "零").when(n < 10, name(n)).when(n < 100, tens).when(n < 1000, hundreds).when(n < 10_000, F.concat(name(k), F.lit("千"), rest))


def is_heading(line: Column) -> Column:
    """A line that opens a chapter, with a Chinese numeral or as ``N、``."""
    return line.rlike(_HEADING) | line.rlike(_LISTED)


def heading_number(line: Column) -> Column:
    return F.when(line.rlike(_HEADING), numeral_value(F.regexp_extract(line, _HEADING, 1))).otherwise(F.regexp_extract(line, _LISTED, 1).try_cast("int"))


def heading_title(line: Column) -> Column:
    listed = trimmed(F.regexp_extract(line, _LISTED, 2))
    fallback = F.concat(F.lit("第"), F.regexp_extract(line, _LISTED, 1).try_cast("int").cast("string"), F.lit("章"))
    return F.when(line.rlike(_HEADING), trimmed(F.regexp_extract(line, _HEADING, 2))).when(listed == "", fallback).otherwise(listed)


def markdown_length(c: Column) -> Column:
    """Characters of a Markdown text without its marks and blanks."""
    chain = [
        (r"(?s)```.*?```", ""),
        (r"`[^`]*`", ""),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (f"(?md)^{_INDENT}*(#{{1,6}}{_INDENT}+|>{_INDENT}?|[-*+]{_INDENT}+|[0-9]+\\.{_INDENT}+)", ""),
        (f"(?:^|(?<=[\n\r\u2028\u2029])){BLANK}*([-*_]){{3,}}{BLANK}*(?=[\n\r\u2028\u2029]|\\z)", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"__([^_]+)__", "$1"),
        (r"_([^_]+)_", "$1"),
        (r"~~([^~]+)~~", "$1"),
    ]
    out = F.coalesce(c, F.lit(""))
    for pattern, into in chain:
        out = F.regexp_replace(out, pattern, into)
    return F.length(without_blanks(out))


def fnv1a(c: Column) -> Column:
    """FNV-1a over the code points of a text, 32 bits."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    codes = F.transform(chars, lambda x: F.ascii(x).cast("long"))  # the whole code point
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


@F.pandas_udf(T.DoubleType())
def fixed(values: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A number rounded from its exact binary value to so many decimals, halves up."""
    for numbers, places in values:
        yield pd.Series([None if pd.isna(x) else float(Decimal(float(x)).quantize(Decimal(1).scaleb(-int(p)), ROUND_HALF_UP)) for x, p in zip(numbers, places, strict=True)], dtype="float64")


def temperature(c: Column, low: float = 0.6, high: float = 1.3) -> Column:
    """A sampling temperature that depends on the text alone, to 8 decimals."""
    return fixed(F.lit(low) + fnv1a(c) / F.lit(4294967296.0) * F.lit(high - low), F.lit(8))


def has_user_blocks(c: Column) -> Column:
    """Blank lines, or marks that open a block."""
    b = BLANK
    return c.rlike(f"\\n{b}*\\n") | c.rlike(f"(?m)(^|\\n){b}*(---|###|【|\\[[0-9]+\\]|[0-9]+[.、])")


def safe_name(c: Column, most: int = 12) -> Column:
    """T13."""
    clean = F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|，。！？、]|' + BLANK, ""), 1, most)
    return F.when(clean == "", "未命名").otherwise(clean)


#: Fixed value: what a book's name is made of.
BOOK_NAME, LONGEST_NAME = r"^[一-龥A-Za-z0-9_·《》（）()]+$", 50


def is_corpus_name(c: Column) -> Column:
    """T14."""
    return c.rlike(BOOK_NAME) & (F.length(c) <= LONGEST_NAME)


def book_name_problem(c: Column) -> Column:
    """Why a new book can't have this name, blanks at the ends aside: ``length``, ``characters`` or null. Names that are taken are the caller's to look up."""
    name = trimmed(F.coalesce(c, F.lit("")))
    return F.when((name == "") | (F.length(name) > LONGEST_NAME), "length").when(~name.rlike(BOOK_NAME), "characters")


def padded(n: Column, width: int = 4) -> Column:
    """Zero-padded, and never cut."""
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)
