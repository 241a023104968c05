"""Checks of annotation tables. Each yields issues (project, chapter, layer, rule, detail); no row means that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import enums
from storyloom.functions.text import is_blank
from storyloom.operators import derive
from storyloom.operators.chapters import in_list

KEY = derive.KEY


def issue(layer: str, rule: str, detail: Column | None = None) -> list[Column]:
    return [F.lit(layer).alias("layer"), F.lit(rule).alias("rule"), (F.lit("") if detail is None else detail).cast("string").alias("detail")]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def flagged(df: DataFrame, layer: str, rules: dict[str, Column]) -> DataFrame:
    """One pass over ``df`` for all rules of one row: each rule that holds gives an issue."""
    found = F.filter(F.array(*[F.struct(cond.alias("bad"), F.lit(rule).alias("rule")) for rule, cond in rules.items()]), lambda x: x["bad"])
    return df.select(*KEY, F.explode(found).alias("x")).select(*KEY, *issue(layer, "")[:1], F.col("x.rule").alias("rule"), F.lit("").alias("detail"))


def gate_sentences(sentences: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """V4: sentence ids and numbers run from 1 without a gap, structs are known, texts aren't blank; with ``listed`` chapters, none is empty."""
    seq = F.col("pos") + 1
    wrong = (F.col("sid") != F.concat(F.lit("S"), seq)) | (F.col("seq") != seq) | F.col("sid").isNull() | F.col("seq").isNull()
    per = sentences.groupBy(*KEY).agg(F.bool_or(wrong).alias("order"), F.bool_or(~in_list(F.col("struct"), enums.STRUCTS)).alias("struct"), F.bool_or(is_blank(F.col("text"))).alias("blank"))
    found = flagged(per, "sentences", {"sequence": F.col("order"), "struct": F.col("struct"), "blank_text": F.col("blank")})
    if listed is None:
        return found
    empty = listed.join(sentences.select(*KEY).distinct(), KEY, "left_anti")
    return found.unionByName(empty.select(*KEY, *issue("sentences", "empty")))


def gate_shots(shots: DataFrame, sentences: DataFrame) -> DataFrame:
    """V5: the shots' sentences are S1..Sn in order, each once and all of them; types and functions are known."""
    ids = shots.select(*KEY, F.col("pos").alias("shot_pos"), F.posexplode("sentence_ids").alias("k", "sid"))
    # in order S1..Sn: so many ids, that many different ones, and none stands before a smaller number
    per = ids.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sid").alias("n_distinct"), F.array_sort(F.collect_list(F.struct("shot_pos", "k", "sid"))).alias("flat"))
    right = F.transform("flat", lambda x, i: x["sid"] == F.concat(F.lit("S"), i + 1))
    per = per.select(*KEY, "n", "n_distinct", F.exists(right, lambda x: ~x).alias("broken"))
    known = shots.groupBy(*KEY).agg(F.bool_or(~in_list(F.col("type"), enums.SHOT_TYPES)).alias("type"), F.bool_or((F.size("funcs") < 1) | F.exists("funcs", lambda f: ~in_list(f, enums.SHOT_FUNCS))).alias("funcs"))
    counts = sentences.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sentences"))
    rows = known.join(per, KEY, "full_outer").join(counts, KEY, "full_outer").na.fill(0, ["n", "n_distinct", "sentences"]).na.fill(False, ["type", "funcs", "broken"])
    return flagged(rows, "shots", {"overlap": F.col("n") != F.col("n_distinct"), "coverage": F.col("n") != F.col("sentences"), "sequence": F.col("broken"), "type": F.col("type"), "funcs": F.col("funcs")})


def gate_chapters(chapters: DataFrame) -> DataFrame:
    """V6: function and mainline states are known, the summary isn't blank."""
    rows = chapters.withColumnRenamed("number", "chapter")
    states = F.exists(F.coalesce("mainline", F.array().cast("array<struct<entity:string,state:string>>")), lambda m: ~in_list(m["state"], enums.MAINLINE_STATES))
    return flagged(rows, "chapter", {"function": ~in_list(F.col("function"), enums.CHAPTER_FUNCS), "summary": is_blank(F.col("summary")), "mainline_state": states})


def completeness(texts: DataFrame, sentences: DataFrame, shots: DataFrame, chapters: DataFrame) -> DataFrame:
    """V7: chapters that lack a layer. Keys are reduced to one row a chapter and layer before they meet."""
    names = ["text", "sentences", "shots", "chapter"]
    parts = [df.select(F.col("project"), F.col("number" if "number" in df.columns else "chapter").alias("chapter"), F.lit(i).alias("layer")).distinct() for i, df in enumerate((texts, sentences, shots, chapters))]
    per = union(parts).groupBy(*KEY).agg(F.sum(F.pow(F.lit(2), F.col("layer"))).cast("int").alias("have"))
    absent = F.filter(F.array(*[F.struct((F.col("have").bitwiseAND(F.lit(1 << i)) == 0).alias("bad"), F.lit(n).alias("name")) for i, n in enumerate(names)]), lambda x: x["bad"])
    return per.select(*KEY, F.explode(absent).alias("x")).select(*KEY, F.lit("chapter").alias("layer"), F.lit("missing_layer").alias("rule"), F.col("x.name").alias("detail"))


def contract(sentences: DataFrame, shots: DataFrame, chapters: DataFrame, stats: DataFrame, suspense: DataFrame) -> DataFrame:
    """V8: V4 to V6, and what is stored equals what follows: ranges, owners, statistics, suspense."""
    ranged = derive.with_ranges(shots.drop("sentence_range")).select(*KEY, "pos", F.col("sentence_range").alias("want"))
    ranges = shots.join(ranged, [*KEY, "pos"]).where(~F.col("sentence_range").eqNullSafe(F.col("want")))
    owned = derive.with_owners(sentences.withColumn("stored", F.col("shot_id")).withColumn("shot_id", F.lit(None).cast("string")), shots).where(~F.col("stored").eqNullSafe(F.col("shot_id")))
    fresh = derive.chapter_stats(sentences, shots)
    names = ["sentence_count", "shot_count", "shot_type_dist", "func_dist", "short_sentence_rate", "sentence_cluster_rate"]

    def plain(df: DataFrame, name: str) -> DataFrame:
        cols = [F.array_sort(F.map_entries(c)).alias(c) if c.endswith("dist") else F.col(c) for c in names]
        return df.select(*KEY, F.struct(*cols).alias(name))

    stale = plain(fresh, "a").join(plain(stats, "b"), KEY, "left").where(~F.col("a").eqNullSafe(F.col("b")))
    listed = derive.suspense(shots).select(*KEY, "shot_id", "label", "sentence_range")
    held = suspense.select(*KEY, "shot_id", "label", "sentence_range")
    other = listed.exceptAll(held).unionByName(held.exceptAll(listed)).select(*KEY).distinct()
    return union(
        [
            gate_sentences(sentences),
            gate_shots(shots, sentences),
            gate_chapters(chapters),
            ranges.select(*KEY, *issue("shots", "sentence_range", F.col("shot_id"))),
            owned.select(*KEY, *issue("sentences", "shot_id", F.col("sid"))),
            stale.select(*KEY, *issue("chapter", "stats")),
            other.select(*KEY, *issue("chapter", "suspense")),
        ]
    )


def gate_events(events: DataFrame) -> DataFrame:
    """V9: (project, idx, rule) for lifecycle rows that break the contract; a missing end isn't a null one."""
    null_end = F.col("has_end") & F.col("end_ch").isNull()
    rules = {
        "incomplete": is_blank(F.col("entity")) | F.col("chapters").isNull() | ~in_list(F.col("state"), enums.LIFECYCLE_STATES) | is_blank(F.col("note")),
        "closed_without_end": (F.col("state") == "已回收") & null_end,
        "open_with_end": (F.col("state") == "悬置") & ~null_end,
        "end_outside": ~null_end & ~F.coalesce(F.array_contains("chapters", F.col("end_ch")), F.lit(False)),
    }
    found = F.filter(F.array(*[F.struct(F.coalesce(c, F.lit(False)).alias("bad"), F.lit(r).alias("rule")) for r, c in rules.items()]), lambda x: x["bad"])
    return events.select("project", "idx", F.explode(found).alias("x")).select("project", "idx", "x.rule")


def gate_targets(targets: DataFrame) -> DataFrame:
    """(project, rule): incomplete targets; not just one main target; a main target with fewer chapters than another."""
    bad = is_blank(F.col("target")) | ~in_list(F.col("state"), enums.TARGET_STATES) | F.col("evidence").isNull() | is_blank(F.col("note"))
    size = F.coalesce(F.array_size("evidence"), F.lit(0))
    per = targets.groupBy("project").agg(F.bool_or(bad).alias("incomplete"), F.count_if("is_main").alias("mains"), F.max(size).alias("most"), F.max(F.when(F.col("is_main"), size)).alias("main_size"))
    rules = {"incomplete": F.col("incomplete"), "main_not_unique": F.col("mains") != 1, "main_not_largest": (F.col("mains") == 1) & (F.col("main_size") != F.col("most"))}
    found = F.filter(F.array(*[F.struct(c.alias("bad"), F.lit(r).alias("rule")) for r, c in rules.items()]), lambda x: x["bad"])
    return per.select("project", F.explode(found).alias("x")).select("project", "x.rule")


def gate_documents(documents: DataFrame) -> DataFrame:
    """(project, layer, rule) of aggregate documents (project, layer, schema, derived_from, temp_for, is_temp)."""
    want = F.create_map(*[F.lit(x) for kv in enums.SCHEMAS.items() for x in kv])
    rules = {
        "schema": ~F.coalesce(F.col("schema") == want[F.col("layer")], F.lit(False)),
        "derived_from": ~F.col("is_temp") & F.col("derived_from").isNull(),
        "temp_for": F.col("is_temp") & (F.coalesce(F.array_size("temp_for"), F.lit(0)) == 0),
    }
    found = F.filter(F.array(*[F.struct(c.alias("bad"), F.lit(r).alias("rule")) for r, c in rules.items()]), lambda x: x["bad"])
    return documents.select("project", "layer", F.explode(found).alias("x")).select("project", "layer", "x.rule")


#: Keys that documents no longer have (fixed values).
DEPRECATED_KEYS = {"event": ["mainline", "chapterIndex"], "volume": ["eventStructure", "mainline"]}


def gate_aggregate_texts(documents: DataFrame) -> DataFrame:
    """V9, V10 on JSON texts (project, layer, text) of the layers event and volume: (project, layer, rule).

    Deprecated keys, also with a null; of events also a missing or empty list of aggregated chapters, and ends that are neither number nor null nor left out. Texts that don't parse have no
    rows here; those are rejects of the reader.
    """
    doc = documents.select("project", "layer", F.expr("try_parse_json(text)").alias("doc")).where("doc is not null")
    event = F.col("layer") == "event"
    old = F.lit(False)
    for layer, keys in DEPRECATED_KEYS.items():
        for key in keys:
            old = old | ((F.col("layer") == layer) & F.expr(f"variant_get(doc, '$.{key}', 'variant')").isNotNull())
    listed = F.expr("size(try_variant_get(doc, '$.derivedFrom.aggregatedChapters', 'array<variant>'))")
    kinds = F.expr("transform(try_variant_get(doc, '$.lifecycle', 'array<variant>'), x -> schema_of_variant(variant_get(x, '$[\"结束章\"]', 'variant')))")
    odd = F.exists(kinds, lambda k: k.isNotNull() & ~k.rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    rules = {"deprecated_key": old, "no_snapshot": event & (F.coalesce(listed, F.lit(0)) < 1), "end_not_number": event & F.coalesce(odd, F.lit(False))}
    found = F.filter(F.array(*[F.struct(c.alias("bad"), F.lit(r).alias("rule")) for r, c in rules.items()]), lambda x: x["bad"])
    return doc.select("project", "layer", F.explode(found).alias("x")).select("project", "layer", "x.rule")


def issue_totals(chapter_issues: DataFrame, aggregate_issues: DataFrame, books: DataFrame) -> DataFrame:
    """(project, issues, passed): chapters with an issue plus issues of the aggregate layer."""
    a = chapter_issues.groupBy("project").agg(F.count_distinct("chapter").alias("a"))
    b = aggregate_issues.groupBy("project").agg(F.count(F.lit(1)).alias("b"))
    n = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return books.join(a, "project", "left").join(b, "project", "left").select("project", n.alias("issues"), (n == 0).alias("passed"))


def repair_list(sentences: DataFrame, shots: DataFrame, chapters: DataFrame, limit: int = 5) -> DataFrame:
    """(project, chapter, layer, loc, problem, current) field by field; of bad structs a chapter lists the first ``limit``."""
    funcs = F.col("funcs")
    rules = {
        "type": (~in_list(F.col("type"), enums.SHOT_TYPES), F.col("type")),
        "funcs_unknown": (F.exists(funcs, lambda f: ~in_list(f, enums.SHOT_FUNCS)), F.array_join(funcs, ",")),
        "funcs_empty": (F.size(funcs) < 1, F.lit("")),
        "funcs_many": (F.size(funcs) > 3, F.array_join(funcs, ",")),
        "label_blank": (is_blank(F.col("label")), F.col("label")),
    }
    found = F.filter(F.array(*[F.struct(c.alias("bad"), F.lit(r).alias("problem"), v.cast("string").alias("current")) for r, (c, v) in rules.items()]), lambda x: x["bad"])
    field = F.when(F.col("x.problem") == "type", "type").when(F.col("x.problem") == "label_blank", "label").otherwise("funcs")
    a = shots.select(*KEY, "pos", F.explode(found).alias("x")).select(*KEY, F.lit("shots").alias("layer"), F.concat(F.lit("shots["), "pos", F.lit("]."), field).alias("loc"), "x.problem", "x.current")
    c = chapters.withColumnRenamed("number", "chapter")
    b = c.where(~in_list(F.col("function"), enums.CHAPTER_FUNCS)).select(*KEY, F.lit("chapter").alias("layer"), F.lit("function").alias("loc"), F.lit("function").alias("problem"), F.col("function").alias("current"))
    d = c.where(is_blank(F.col("summary"))).select(*KEY, F.lit("chapter").alias("layer"), F.lit("summary").alias("loc"), F.lit("summary_blank").alias("problem"), F.lit("").alias("current"))
    e = c.select(*KEY, F.posexplode("mainline").alias("i", "m")).where(~in_list(F.col("m.state"), enums.MAINLINE_STATES)).select(*KEY, F.lit("chapter").alias("layer"), F.concat(F.lit("mainlineProgress["), "i", F.lit("].state")).alias("loc"), F.lit("state").alias("problem"), F.col("m.state").alias("current"))
    first = bad_structs(sentences).groupBy(*KEY).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "struct"))), 1, limit).alias("first"), F.count(F.lit(1)).alias("n"))
    f = first.select(*KEY, F.explode("first").alias("s")).select(*KEY, F.lit("sentences").alias("layer"), F.concat(F.lit("sentences["), F.col("s.pos"), F.lit("].struct")).alias("loc"), F.lit("struct").alias("problem"), F.col("s.struct").alias("current"))
    return union([a, b, d, e, f])


def problem_classes(problems: DataFrame, limit: int = 5) -> DataFrame:
    """(project, chapter, class, n, too_many)."""
    kind = F.when(F.col("problem").contains("funcs"), "funcs").when(F.col("problem").contains("type"), "type").when(F.col("problem").contains("struct"), "struct").otherwise("other")
    return problems.groupBy(*KEY, kind.alias("class")).agg(F.count(F.lit(1)).alias("n")).withColumn("too_many", F.col("n") > limit)


def quoted(text: Column) -> Column:
    return F.coalesce(text.contains("“") & text.contains("”"), F.lit(False))


def repaired_structs(sentences: DataFrame) -> DataFrame:
    """An unknown struct of a quoted sentence becomes 短句."""
    fix = ~in_list(F.col("struct"), enums.STRUCTS) & quoted(F.col("text"))
    return sentences.withColumn("struct", F.when(fix, "短句").otherwise(F.col("struct")))


def bad_structs(sentences: DataFrame) -> DataFrame:
    """What the repair leaves."""
    return sentences.where(~in_list(F.col("struct"), enums.STRUCTS) & ~quoted(F.col("text")))


def audit_requests(requests: DataFrame) -> DataFrame:
    """(session_id, n_shots, bad_types, bad_funcs)."""
    bad = (F.coalesce(F.array_size("funcs"), F.lit(0)) < 1) | F.exists(F.coalesce("funcs", F.array().cast("array<string>")), lambda f: ~in_list(f, enums.SHOT_FUNCS))
    return requests.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_shots"), F.count_if(~in_list(F.col("type"), enums.SHOT_TYPES)).alias("bad_types"), F.count_if(bad).alias("bad_funcs"))
