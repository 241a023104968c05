"""Strict checks of stored JSON, and what can be saved from broken documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.enums import STRUCTS

_LEXEME = re.compile(r'(?P<blank>[ \t\r\n]+)|(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(?P<word>true|false|null)|(?P<mark>[\[\]{}:,])')
#: What may follow in each state: lexeme classes to the next state. States: value, first value of an array, first key, key, colon, and after a value.
_VALUE, _FIRST, _KEY1, _KEY, _COLON, _AFTER = range(6)


def audit(text: str | None) -> tuple[str, int] | None:
    """(kind, offset) of the first fault of a JSON document, or None: a pushdown automaton over lexemes."""
    text = text or ""
    keys: list[set[str] | None] = []  # of the open objects; None for an open array
    state, at, shape = _VALUE, 0, ""
    while at < len(text):
        m = _LEXEME.match(text, at)
        if m and m.lastgroup == "blank":
            at = m.end()
            continue
        if state == _AFTER and not keys:
            return "trailing_content", at
        if not m:
            return _lexical_fault(text, at)
        mark = m[0] if m.lastgroup == "mark" else ""
        if m.lastgroup == "number" and re.match(r"[0-9.eE+-]", text[m.end() : m.end() + 1] or " "):
            return "bad_number", m.end()
        if state in (_KEY1, _KEY):
            if mark == "}":
                if state == _KEY:
                    return "trailing_comma", at
                keys.pop()
                state = _AFTER
            elif m.lastgroup == "text":
                key = json.loads(m[0])
                if key in keys[-1]:
                    return "duplicate_key", m.end()
                keys[-1].add(key)
                state = _COLON
            else:
                return "key_not_string", at
        elif state == _COLON:
            if mark != ":":
                return "missing_colon", at
            state = _VALUE
        elif state == _AFTER:
            if mark == ",":
                state = _KEY if keys[-1] is not None else _VALUE
            elif mark == ("]" if keys[-1] is None else "}"):
                keys.pop()
            else:
                return "missing_comma", at
        elif mark in ("{", "["):
            shape = shape or mark
            keys.append(set() if mark == "{" else None)
            state = _KEY1 if mark == "{" else _FIRST
        elif mark == "]" and keys and keys[-1] is None:
            if state != _FIRST:
                return "trailing_comma", at
            keys.pop()
            state = _AFTER
        elif mark:
            return "unexpected_character", at
        else:
            shape = shape or m.lastgroup
            state = _AFTER
        at = m.end()
    if keys or state != _AFTER:
        return "unclosed", len(text)
    return None if shape == "{" else ("root_not_object", 0)


def _lexical_fault(text: str, at: int) -> tuple[str, int]:
    """What is wrong where no lexeme fits."""
    if text[at] == '"':
        i = at + 1
        while i < len(text):
            c = text[i]
            if c == "\\":
                good = re.match(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})', text[i : i + 6])
                if not good:
                    return "bad_escape", i + 1
                i += good.end()
            elif c < " ":
                return {"\n": "raw_newline", "\r": "raw_return"}.get(c, "raw_control"), i
            else:
                i += 1
        return "unclosed_string", len(text)
    return ("bad_number" if text[at] == "-" else "unexpected_character"), at


def is_object(text: Column) -> Column:
    """Whether a text is surely a JSON object and nothing else, by the JVM's parser, which refuses repeated keys.

    The parser stops after the first value, so the text is parsed as the only entry of a list and as a value of an object: what follows a first value could
    close one of them, but not both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    held = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    # a null here leaves the text to the scan
    return F.coalesce((F.size(listed) == 1) & F.schema_of_variant(F.get(listed, 0)).startswith("OBJECT") & held.isNotNull(), F.lit(False))


def audited(documents: DataFrame, text: str = "text") -> DataFrame:
    """V1: ``documents`` with valid, kind, offset, line, col. What the JVM's parser takes is valid; only the texts that it refuses are sent to the scan, which finds their first fault."""
    fields = "valid boolean, kind string, offset int, line int, col int"

    def row(t: str | None) -> tuple:
        found = audit(t)
        if found is None:
            return True, None, None, None, None
        kind, at = found
        before = (t or "")[:at]
        return False, kind, at, before.count("\n") + 1, at - before.rfind("\n")

    @F.pandas_udf(fields)
    def check(texts: pd.Series, taken: pd.Series) -> pd.DataFrame:
        rows = [(True, None, None, None, None) if ok else row(t) for t, ok in zip(texts, taken, strict=True)]
        return pd.DataFrame(rows, columns=["valid", "kind", "offset", "line", "col"]).astype({"offset": "Int32", "line": "Int32", "col": "Int32"})

    taken = documents.withColumn("_ok", is_object(F.col(text)))
    return taken.withColumn("_a", check(F.when(~F.col("_ok"), F.col(text)), F.col("_ok"))).select(*documents.columns, "_a.*")


def escaped_inside(text: str) -> str:
    """Line breaks and tabs inside strings written as escapes."""
    parts = re.split(r'((?:[^"\\]|\\.)*?")', text, flags=re.DOTALL)
    out, inside = [], False
    for part in parts:
        if inside:
            part = part.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        if part.endswith('"'):
            inside = not inside
        out.append(part)
    return "".join(out)


def salvaged(raw: str | None) -> str | None:
    """V2: the JSON object in a model's answer: without its fence, as it is or with escapes set, whole or from the first brace to the last."""
    text = re.sub(r"\s*```\s*$", "", re.sub(r"^```(?:json)?\s*", "", (raw or "").strip(), flags=re.IGNORECASE))
    for part in dict.fromkeys([text, text[text.find("{") : text.rfind("}") + 1]]):
        for attempt in (part, escaped_inside(part)):
            try:
                found = json.loads(attempt)
            except ValueError:
                continue
            return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
    return None


@F.pandas_udf(T.StringType())
def salvage(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(salvaged)


def rebuilt_sentences(documents: DataFrame) -> DataFrame:
    """V3: (project, chapter, pos, sid, seq, struct, text) from broken sentence documents: their texts in order, each with the struct of the same place, if it is a known one."""
    value = '"{}"\\s*:\\s*"([^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+)'
    texts, structs = (F.regexp_extract_all("text", F.lit(value.replace('{}', key)), F.lit(1)) for key in ("text", "struct"))
    rows = documents.select("project", "chapter", texts.alias("texts"), structs.alias("structs")).select("project", "chapter", "structs", F.posexplode("texts").alias("pos", "text"))
    struct = F.get("structs", F.col("pos"))
    return rows.select("project", "chapter", "pos", F.concat(F.lit("S"), F.col("pos") + 1).alias("sid"), (F.col("pos") + 1).alias("seq"), F.when(struct.isin(STRUCTS), struct).otherwise("短句").alias("struct"), "text")


def patched(document: str | None, patches: list[tuple[str, str]]) -> tuple[str | None, int]:
    """The document with the patches (path, new JSON value or __DELETE__) applied in order, and how many paths led nowhere."""
    try:
        root = json.loads(document or "")
    except ValueError:
        return document, len(patches)
    bad = 0
    for path, value in patches:
        steps = [int(i) if i else name for name, i in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path)]
        here = root
        try:
            for step in steps[:-1]:
                here = here[step]
            if value == "__DELETE__" and isinstance(here, list):
                here[steps[-1]] = None  # the place stays, so that later patches meet the same numbers
            elif value == "__DELETE__":
                del here[steps[-1]]
            elif isinstance(here, list) and not 0 <= steps[-1] < len(here):
                raise IndexError(path)
            else:
                here[steps[-1]] = json.loads(value)
        except (LookupError, TypeError, ValueError):
            bad += 1
    return json.dumps(root, ensure_ascii=False), bad


def apply_patches(documents: DataFrame, patches: DataFrame) -> DataFrame:
    """(project, chapter, layer, text, rejected, valid) of documents after their patches (project, chapter, layer, seq, path, value); results are audited again."""
    key = ["project", "chapter", "layer"]
    lists = patches.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "path", "value"))).alias("patches"))

    @F.pandas_udf("text string, rejected int, valid boolean")
    def run(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = [patched(t, [(p["path"], p["value"]) for p in (ps if ps is not None else [])]) for t, ps in zip(texts, lists, strict=True)]
        return pd.DataFrame([(t, bad, audit(t) is None) for t, bad in out], columns=["text", "rejected", "valid"])

    rows = documents.join(lists, key, "left").withColumn("_r", run(F.col("text"), F.col("patches")))
    return rows.select(*key, "_r.text", "_r.rejected", "_r.valid")
