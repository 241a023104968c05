"""Registered queries of the library: each applies an operator to the driver's tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions import enums, text
from storyloom.operators import chapters, derive, draft, gates, json_audit, ledger, lexicon, recall, refresh, rollup
from storyloom.sources import adapter, stores
from storyloom.sources.checkpoints import cut, fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# --- books to chapters


@query
def sentences(spark, sf):
    return adapter.sentences(spark, sf).drop("shot_id")


@query
def shots(spark, sf):
    return adapter.shots(spark, sf).withColumns({"funcs": joined("funcs"), "sentence_ids": joined("sentence_ids")})


@query
def corpus_lines(spark, sf):
    return stores.corpus_lines(adapter.corpus(spark, sf))


@query
def chapter_headings(spark, sf):
    return chapters.headings(stores.corpus_lines(adapter.corpus(spark, sf)))


@query
def chapter_ranges(spark, sf):
    lines = stores.corpus_lines(adapter.corpus(spark, sf))
    return chapters.ranges(lines, chapters.headings(lines))


@query
def chapter_sizes(spark, sf):
    return chapters.bodies(adapter.corpus(spark, sf)).select("project", "start", "end", "chars", F.md5("body").alias("body_md5"))


@query
def chapter_list_rows(spark, sf):
    """A chapter list written as lines and read again; every third line has the short form."""
    lines = stores.corpus_lines(adapter.corpus(spark, sf))
    listed = chapters.ranges(lines, chapters.headings(lines)).withColumn("chars", F.lit(7))
    long = stores.chapter_list_lines(listed.select("project", "number", F.concat("title", F.lit(",x")).alias("title"), "start", "end", "chars"))
    short = listed.select("project", "number", F.concat("number", F.lit(","), "title", F.lit(","), "start", F.lit("-"), "end").alias("value"))
    rows = long.where("number % 3 <> 0").unionByName(short.where("number % 3 = 0"))
    return stores.parse_chapter_list(rows.select("project", F.col("value").alias("line")))


@query
def listed_bodies(spark, sf):
    """T6 with a list from outside."""
    corpora = adapter.corpus(spark, sf)
    lines = stores.corpus_lines(corpora)
    return chapters.bodies_of_list(corpora, chapters.ranges(lines, chapters.headings(lines))).select("project", "number", "chars", F.md5("body").alias("body_md5"))


@query
def number_repair(spark, sf):
    found = chapters.headings(stores.corpus_lines(adapter.corpus(spark, sf)))
    broken = F.when(F.col("number") % 11 == 0, None).when(F.col("number") % 13 == 0, F.col("number") - 1).otherwise(F.col("number"))
    return chapters.repaired_numbers(found.withColumn("number", broken.cast("int"))).withColumnRenamed("number", "repaired")


@query
def chapter_numerals(spark, sf):
    """T2, T3; numbers beyond 9999 have no numeral and count as they are."""
    rows = adapter.chapter_text(spark, sf).select("number").distinct()
    value = F.when(F.col("numeral").isNull(), F.col("number")).otherwise(text.numeral_value(F.col("numeral")))
    return rows.withColumn("numeral", text.numeral(F.col("number"))).withColumn("value", value)


def manuscripts(spark, sf):
    t = adapter.chapter_text(spark, sf)
    titled = F.when(F.col("number") % 2 == 0, F.concat(F.lit("# t"), "number", F.lit("\n"), "text")).otherwise(F.col("text"))
    return t.select("project", "number", titled.alias("content"), F.timestamp_seconds(F.col("number") * 60).alias("mtime"))


@query
def synthetic_corpus(spark, sf):
    return chapters.synthetic_corpus(manuscripts(spark, sf)).select("project", "number", "title", "start", "end", "chars")


@query
def markdown_words(spark, sf):
    return manuscripts(spark, sf).select("project", "number", text.markdown_length(F.col("content")).alias("chars"))


# --- files: the tables written as the documents of a layer, and read again


def layer_files(spark, sf, documents):
    """(path, text, mtime) of documents (project, chapter, doc); every ninth is cut off."""
    path = F.concat(F.lit("data/"), "project", F.lit("project/layer/第"), text.padded(F.col("chapter")), F.lit("章.json"))
    json = F.to_json("doc")
    return documents.select(path.alias("path"), F.when(F.col("chapter") % 9 == 0, F.substring(json, 1, 40)).otherwise(json).alias("text"), F.current_timestamp().alias("mtime"))


def sentence_files(spark, sf):
    s = adapter.sentences(spark, sf)
    item = F.struct("seq", F.col("sid").alias("id"), "struct", "text", F.col("shot_id").alias("shotId"))
    doc = F.struct(F.lit("x").alias("source"), F.array_sort(F.collect_list(item)).alias("sentences"))
    return layer_files(spark, sf, s.groupBy("project", "chapter").agg(doc.alias("doc")))


@query
def layer_sentences(spark, sf):
    """Sentence documents as flat rows."""
    return stores.flat_sentences(stores.parsed_layer(sentence_files(spark, sf), stores.SENTENCE_DOCUMENT)[0]).drop("shot_id")


@query
def layer_rejects(spark, sf):
    """What doesn't parse."""
    return stores.parsed_layer(sentence_files(spark, sf), stores.SENTENCE_DOCUMENT)[1].select("project", "chapter")


@query
def layer_shots(spark, sf):
    """Shot documents as flat rows."""
    s = adapter.shots(spark, sf)
    item = F.struct("pos", F.col("shot_id").alias("id"), "type", "funcs", "label", F.col("sentence_ids").alias("sentenceIds"))
    docs = s.groupBy("project", "chapter").agg(F.struct(F.array_sort(F.collect_list(item)).alias("shots")).alias("doc"))
    rows = stores.flat_shots(stores.parsed_layer(layer_files(spark, sf, docs), stores.SHOT_DOCUMENT)[0])
    return rows.select("project", "chapter", "pos", "shot_id", "type", joined("funcs").alias("funcs"), "label", joined("sentence_ids").alias("sentence_ids"))


@query
def manuscript_files(spark, sf):
    """Manuscripts as files; the title is a first line with a mark."""
    m = manuscripts(spark, sf)
    path = F.concat(F.lit("books/"), "project", F.lit("/第"), text.padded(F.col("number")), F.lit("章.md"))
    rows = stores.parsed_manuscripts(m.select(path.alias("path"), F.col("content").alias("text"), "mtime"))
    return rows.select("project", "number", "title", F.md5("content").alias("content_md5"), F.unix_timestamp("mtime").alias("mtime"))


@query
def split_chapters(spark, sf):
    """Written by book, with the name that each chapter's file would have, and read again."""
    path = fresh_path(spark)
    stores.write_split_chapters(adapter.chapter_text(spark, sf).withColumn("title", F.concat(F.lit("t"), "number")), path)
    return spark.read.parquet(path).select("project", "number", "file_name", F.md5("text").alias("text_md5"))


@query
def published(spark, sf):
    """Chapters published by book; then some books once more, which replaces these books and no other."""
    path = fresh_path(spark)
    t = adapter.chapter_text(spark, sf).select("project", "number", F.lit(1).alias("version"))
    stores.publish(t, path)
    stores.publish(t.where("project in ('src1', 'src2') and number % 40 < 20").withColumn("version", F.lit(2)), path)
    return stores.read_published(spark, path).select("project", "number", "version")


# --- gates


def broken_sentences(spark, sf):
    s = adapter.sentences(spark, sf)
    n = F.col("chapter") * 31 + F.col("seq")
    return s.withColumns({"struct": F.when(n % 97 == 0, "对话").otherwise(F.col("struct")), "text": F.when(n % 89 == 0, "　 ").when(n % 194 == 0, F.concat(F.lit("“"), "text", F.lit("”"))).otherwise(F.col("text")), "sid": F.when(n % 83 == 0, "S0").otherwise(F.col("sid"))})


def broken_shots(spark, sf):
    s = adapter.shots(spark, sf)
    n = F.col("chapter") * 17 + F.col("pos")
    ids = F.when(n % 61 == 0, F.array_union(F.array(F.lit("S1")), "sentence_ids")).when(n % 67 == 0, F.slice("sentence_ids", 2, 9)).otherwise(F.col("sentence_ids"))
    funcs = F.when(n % 71 == 0, F.array().cast("array<string>")).when(n % 73 == 0, F.array(F.lit("推进"), F.lit("不明"), F.lit("铺垫"), F.lit("反转"))).otherwise(F.col("funcs"))
    return s.withColumns({"sentence_ids": ids, "funcs": funcs, "type": F.when(n % 79 == 0, "梦").otherwise(F.col("type")), "label": F.when(n % 53 == 0, " ").otherwise(F.col("label"))})


def broken_chapters(spark, sf):
    c = adapter.chapters(spark, sf)
    n = F.col("number")
    state = F.when(n % 23 == 0, F.array(F.struct(F.lit("e").alias("entity"), F.lit("?").alias("state")))).otherwise(F.col("mainline"))
    return c.withColumns({"function": F.when(n % 29 == 0, "无").otherwise(F.col("function")), "summary": F.when(n % 31 == 0, " ").otherwise(F.col("summary")), "mainline": state})


@query
def sentence_gate(spark, sf):
    listed = adapter.chapter_text(spark, sf).select("project", F.col("number").alias("chapter"))
    return gates.gate_sentences(broken_sentences(spark, sf), listed)


@query
def shot_gate(spark, sf):
    return gates.gate_shots(broken_shots(spark, sf), adapter.sentences(spark, sf))


@query
def chapter_gate(spark, sf):
    return gates.gate_chapters(broken_chapters(spark, sf))


@query
def layer_completeness(spark, sf):
    t = adapter.chapter_text(spark, sf)
    return gates.completeness(t.where("number % 19 <> 0"), adapter.sentences(spark, sf).where("chapter % 17 <> 0"), adapter.shots(spark, sf).where("chapter % 13 <> 0"), adapter.chapters(spark, sf).where("number % 11 <> 0"))


def stored_stats(spark, sf):
    return derive.chapter_stats(adapter.sentences(spark, sf), adapter.shots(spark, sf))


@query
def contract_check(spark, sf):
    """V8 over stored values of which some are off."""
    s, h = adapter.sentences(spark, sf), derive.with_ranges(adapter.shots(spark, sf))
    kept = derive.with_owners(s, h).withColumn("shot_id", F.when((F.col("chapter") + F.col("seq")) % 101 == 0, "x").otherwise(F.col("shot_id")))
    stats = stored_stats(spark, sf).withColumn("shot_count", F.col("shot_count") + F.when(F.col("chapter") % 37 == 0, 1).otherwise(0))
    held = derive.suspense(h).where("chapter % 41 <> 0")
    ranged = h.withColumn("sentence_range", F.when((F.col("chapter") + F.col("pos")) % 103 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.col("sentence_range")))
    return gates.contract(kept, ranged, adapter.chapters(spark, sf), stats, held)


def lifecycle(spark, sf):
    """A book's types of shots as lifecycle entries."""
    e = adapter.events_layer(spark, sf)
    per = e.groupBy("project", "type").agg(F.array_sort(F.collect_set("chapter")).alias("chapters"))
    order = F.create_map(*[F.lit(x) for i, t in enumerate(enums.SHOT_TYPES) for x in (t, i)])
    n = F.size("chapters")
    closed = n % 3 == 0
    end = F.when(closed, F.when(n % 2 == 0, F.element_at("chapters", -1)).when(n % 5 == 0, F.element_at("chapters", -1) + 1))
    return per.select("project", order[F.col("type")].alias("idx"), F.col("type").alias("entity"), F.element_at("chapters", 1).alias("start_ch"), F.when(n % 7 == 0, F.array().cast("array<int>")).otherwise(F.col("chapters")).alias("chapters"), end.alias("end_ch"), (n % 11 != 0).alias("has_end"), F.when(closed, "已回收").when(n % 13 == 0, "?").otherwise("悬置").alias("state"), F.when(n % 4 == 0, " ").otherwise("n").alias("note"))


@query
def event_contract(spark, sf):
    return gates.gate_events(lifecycle(spark, sf))


@query
def event_repair(spark, sf):
    return rollup.repaired_events(lifecycle(spark, sf)).withColumn("chapters", joined("chapters"))


def target_rows(spark, sf):
    c = adapter.chapters(spark, sf).select("project", "number", F.col("mainline")[0].alias("m"))
    per = c.groupBy("project", F.col("m.entity").alias("target")).agg(F.array_sort(F.collect_set("number")).alias("evidence"))
    idx = F.substring("target", 2, 1).cast("int")
    n = F.size("evidence")
    return per.select("project", idx.alias("idx"), "target", F.when(n % 9 == 0, "?").otherwise(F.lit("推进")).alias("state"), "evidence", F.lit("n").alias("note"), (idx == n % 5).alias("is_main"))


@query
def target_contract(spark, sf):
    return gates.gate_targets(target_rows(spark, sf))


@query
def main_target(spark, sf):
    return rollup.with_main_target(target_rows(spark, sf)).select("project", "idx", "target", F.size("evidence").alias("n_evidence"), "is_main")


def aggregate_documents(spark, sf):
    """JSON texts of the event and volume layers: some with old keys, without a snapshot, or with an end in quotes."""
    n = F.substring("project", 4, 9).cast("int")
    end = F.when(F.col("end_ch").isNull(), "null").when(F.col("start_ch") % 5 == 0, F.concat(F.lit('"'), "end_ch", F.lit('"'))).otherwise(F.col("end_ch").cast("string"))
    entry = F.concat(F.lit('{"entity":"'), "entity", F.lit('","结束章":'), end, F.lit("}"))
    events = lifecycle(spark, sf).groupBy("project").agg(F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("entries"))  # a row for each type of shot
    agg = F.when(n % 4 == 1, "").when(n % 4 == 2, ',"derivedFrom":{"aggregatedChapters":[]}').otherwise(',"derivedFrom":{"aggregatedChapters":[1]}')
    events = events.select("project", F.lit("event").alias("layer"), F.concat(F.lit('{"lifecycle":['), "entries", F.lit("]"), agg, F.when(n % 3 == 0, ',"mainline":null').otherwise(""), F.lit("}")).alias("text"))
    volumes = target_rows(spark, sf).select("project").distinct()
    return events.unionByName(volumes.select("project", F.lit("volume").alias("layer"), F.concat(F.lit('{"targets":[],"chapterIndex":1'), F.when(n % 5 == 0, ',"eventStructure":{}').otherwise(""), F.lit("}")).alias("text")))


@query
def aggregate_texts(spark, sf):
    return gates.gate_aggregate_texts(aggregate_documents(spark, sf))


@query
def document_contract(spark, sf):
    b = adapter.chapter_text(spark, sf).groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    layers = F.explode(F.array(F.lit("chapter_table"), F.lit("event"), F.lit("volume"))).alias("layer")
    d = b.select("project", "n", layers)
    tag = F.when((F.col("layer") == "event") & (F.col("n") % 2 == 0), "dsh/event-card/v1").when(F.col("layer") == "volume", "dsh/volume-card/v1").when((F.col("layer") == "chapter_table") & (F.col("n") % 5 != 0), "dsh/chapter-table/v1")
    return gates.gate_documents(d.select("project", "layer", tag.alias("schema"), F.when(F.col("n") % 3 != 0, "x").alias("derived_from"), F.when(F.col("n") % 4 != 0, F.array(F.lit(1))).alias("temp_for"), (F.col("layer") == "volume").alias("is_temp")))


@query
def issue_totals(spark, sf):
    found = gates.gate_sentences(broken_sentences(spark, sf)).unionByName(gates.gate_chapters(broken_chapters(spark, sf)))
    books = adapter.chapter_text(spark, sf).select("project").distinct()
    return gates.issue_totals(found, gates.gate_targets(target_rows(spark, sf)), books)


@query
def repair_list(spark, sf):
    return gates.repair_list(broken_sentences(spark, sf), broken_shots(spark, sf), broken_chapters(spark, sf))


@query
def problem_classes(spark, sf):
    return gates.problem_classes(repair_list(spark, sf), 2)


@query
def struct_repair(spark, sf):
    s = broken_sentences(spark, sf)
    left = gates.bad_structs(s).groupBy("project").agg(F.count(F.lit(1)).alias("unresolved"))
    n = gates.repaired_structs(s).groupBy("project").agg(F.count_if(F.col("struct") == "短句").alias("short"), F.count_if(F.col("struct") == "对话").alias("odd"))
    return n.join(left, "project", "left").na.fill(0, ["unresolved"])


@query
def request_audit(spark, sf):
    r = adapter.requests(spark, sf)
    n = F.col("session_id") + F.col("seq")
    return gates.audit_requests(r.withColumns({"type": F.when(n % 7 == 0, "?").otherwise(F.col("type")), "funcs": F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("funcs"))}))


def broken_properties(spark, sf):
    """Event properties as texts, some of them broken."""
    e = adapter.load(spark, sf, "events")
    n = F.col("event_id") % 12
    t = F.when(n == 1, F.lit('{"a":1,"a":2}')).when(n == 2, F.lit('{"a":1,}')).when(n == 3, F.lit("[1]")).when(n == 4, F.lit('{"a":"x\ny"}')).when(n == 5, F.concat("props", F.lit(" x"))).when(n == 6, F.lit('{"a":01}')).when(n == 7, F.lit('{"a":"\\q"}')).when(n == 8, F.lit('{"a" 1}')).otherwise(F.col("props"))
    return e.select("event_id", t.alias("text"))


@query
def json_validity(spark, sf):
    """V1 over event properties."""
    return json_audit.audited(broken_properties(spark, sf)).select("event_id", "valid", "kind", "offset", "line", "col")


@query
def json_objects(spark, sf):
    """V1, whether they are valid at all."""
    return json_audit.audited(broken_properties(spark, sf)).select("event_id", "valid")


@query
def payload_salvage(spark, sf):
    e = adapter.load(spark, sf, "events")
    n = F.col("event_id") % 5
    raw = F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).when(n == 2, F.lit('{"t":"a\nb"}')).when(n == 3, F.lit("none")).otherwise(F.col("props"))
    return e.select("event_id", json_audit.salvage(raw).alias("payload"))


@query
def sentence_rebuild(spark, sf):
    """V3: sentence documents cut off in the middle of their last key."""
    s = adapter.sentences(spark, sf)
    item = F.concat(F.lit('{"id":"'), "sid", F.lit('","struct":"'), F.when(F.col("seq") == 2, "?").otherwise(F.col("struct")), F.lit('","text":"'), F.regexp_replace(F.regexp_replace("text", r"\\", ""), '"', ""), F.lit('"}'))
    d = rollup.ordered_text(s, ["project", "chapter"], ["seq"], item, ",", "items")
    docs = d.select("project", "chapter", F.concat(F.lit('{"sentences":['), "items", F.lit(',{"te')).alias("text"))
    return json_audit.rebuilt_sentences(docs)


@query
def field_patches(spark, sf):
    """Chapter documents with a patch each for the summary, a state and a path that leads nowhere."""
    c = adapter.chapters(spark, sf)
    key = ["project", F.col("number").alias("chapter"), F.lit("chapter").alias("layer")]
    docs = c.select(*key, F.to_json(F.struct("function", "mainline")).alias("text"))
    p = F.array(F.struct(F.lit(1).alias("seq"), F.lit("function").alias("path"), F.lit('"推进"').alias("value")), F.struct(F.lit(2).alias("seq"), F.lit("mainline[0].state").alias("path"), F.lit("__DELETE__").alias("value")), F.struct(F.lit(3).alias("seq"), F.lit("mainline[7].state").alias("path"), F.lit("1").alias("value")))
    patches = c.where("number % 2 = 0").select(*key, F.explode(p).alias("p")).select("project", "chapter", "layer", "p.*")
    return json_audit.apply_patches(docs, patches)


# --- derived tables


def loose_shots(spark, sf):
    """Shots of which some list a sentence of another, or leave one out."""
    return broken_shots(spark, sf)


@query
def shot_backfill(spark, sf):
    return derive.with_owners(adapter.sentences(spark, sf), loose_shots(spark, sf)).select("project", "chapter", "sid", "shot_id")


@query
def shot_orphans(spark, sf):
    return derive.orphans(adapter.sentences(spark, sf), loose_shots(spark, sf)).select("project", "chapter", "sid")


@query
def sentence_ranges(spark, sf):
    r = derive.with_ranges(loose_shots(spark, sf))
    return r.select("project", "chapter", "shot_id", F.get("sentence_range", 0).alias("first"), F.get("sentence_range", 1).alias("last"))


@query
def chapter_stats(spark, sf):
    s = stored_stats(spark, sf)
    flat = {c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",") for c in ("shot_type_dist", "func_dist")}
    return s.withColumns(flat).drop("short_sentence_rate", "sentence_cluster_rate")


@query
def chapter_rates(spark, sf):
    """D3: the two rates, rounded as the exact binary value."""
    return stored_stats(spark, sf).select("project", "chapter", "short_sentence_rate", "sentence_cluster_rate")


@query
def type_distribution(spark, sf):
    return derive.distribution(adapter.shots(spark, sf), "type")


@query
def func_distribution(spark, sf):
    return derive.distribution(adapter.shots(spark, sf), "funcs")


@query
def suspense_list(spark, sf):
    return derive.suspense(adapter.shots(spark, sf)).withColumn("sentence_range", joined("sentence_range"))


@query
def chapter_table(spark, sf):
    return rollup.chapter_table(adapter.chapters(spark, sf))


@query
def mainline_feed(spark, sf):
    return rollup.mainline_feed(adapter.chapters(spark, sf))


@query
def book_totals(spark, sf):
    return rollup.book_totals(adapter.chapters(spark, sf), stored_stats(spark, sf))


@query
def chapter_list_restore(spark, sf):
    lines = stores.corpus_lines(adapter.corpus(spark, sf))
    return chapters.restored_list(chapters.ranges(lines, chapters.headings(lines)))


def listed(spark, sf):
    return adapter.chapter_text(spark, sf).select("project", "number")


@query
def missing_chapters(spark, sf):
    return chapters.missing(listed(spark, sf), adapter.annotated(spark, sf))


@query
def summary_feed(spark, sf):
    return rollup.summary_feed(adapter.chapters(spark, sf))


@query
def project_meta(spark, sf):
    issues = gates.gate_chapters(broken_chapters(spark, sf))
    bad = listed(spark, sf).where("number % 43 = 0")
    m = rollup.project_meta(listed(spark, sf), adapter.annotated(spark, sf), adapter.sentences(spark, sf), adapter.shots(spark, sf), bad, issues)
    return m.withColumn("report", F.array_join(F.transform("report", lambda r: F.concat(r["chapter"], F.lit(":"), r["rule"])), ","))


# --- incremental merging


def snapshot_rows(spark, sf):
    s = listed(spark, sf).where("number % 3 = 0").groupBy("project").agg(F.array_sort(F.collect_set("number")).alias("aggregated"))
    return s.select("project", F.explode(F.array(F.lit("event"), F.lit("volume"))).alias("layer"), "aggregated").where("project <> 'src3'")


@query
def new_chapters(spark, sf):
    return rollup.new_chapters(adapter.annotated(spark, sf), snapshot_rows(spark, sf))


@query
def snapshot_update(spark, sf):
    fresh = rollup.new_chapters(adapter.annotated(spark, sf), snapshot_rows(spark, sf))
    return rollup.updated_snapshots(snapshot_rows(spark, sf), fresh).withColumn("aggregated", joined("aggregated"))


@query
def batch_reentry(spark, sf):
    fresh = rollup.new_chapters(adapter.annotated(spark, sf), snapshot_rows(spark, sf))
    held = fresh.groupBy("project").agg(F.collect_set("number").alias("batch"), F.max("number").alias("top"))
    held = held.select("project", F.when(F.col("top") % 2 == 0, F.array_append("batch", 0)).otherwise(F.col("batch")).alias("batch"), F.concat(F.lit("t"), "top").alias("temp_ts"))
    return rollup.reentered(fresh, held)


def entries(spark, sf):
    e = lifecycle(spark, sf).select("project", F.lit("event").alias("layer"), "idx", F.col("entity").alias("name"), "chapters", "state", "end_ch")
    idx = F.row_number().over(Window.partitionBy("project", "layer").orderBy("idx")) - 1
    return e.withColumn("idx", idx)


def instruction_rows(spark, sf):
    """Of each book: merges of all chapters by the type after theirs, one with a wrong name, one out of range, an insert, and a merge into it."""
    later = adapter.events_layer(spark, sf).groupBy("project", "type").agg(F.array_sort(F.collect_set(F.col("chapter") + 1)).alias("chapters"))
    e = entries(spark, sf).select("project", "idx", F.col("name").alias("type"))
    m = later.join(e, ["project", "type"])
    null = F.lit(None)
    cols = {"layer": F.lit("event"), "action": F.lit("merge"), "seq": F.col("idx") * 10, "entity": F.when(F.col("idx") % 4 == 3, "other").when(F.col("idx") % 2 == 0, F.col("type")), "state": F.when(F.col("idx") % 2 == 0, "已回收").otherwise("悬置"), "end_ch": F.when(F.col("idx") % 3 == 0, F.element_at("chapters", 1)), "name": null.cast("string")}
    order = ["project", "layer", "seq", "action", "idx", "entity", "chapters", "state", "end_ch", "name"]
    merges = m.withColumns(cols).select(order)
    again = m.where("idx = 0").withColumns(cols | {"seq": F.lit(5), "end_ch": F.lit(9999)}).select(order)
    books = entries(spark, sf).groupBy("project").agg((F.max("idx") + 1).alias("n"))
    none = F.array().cast("array<int>")
    rest = {"layer": F.lit("event"), "entity": null.cast("string"), "state": null.cast("string"), "end_ch": null.cast("int"), "name": null.cast("string")}
    inserts = books.withColumns(rest | {"action": F.lit("insert"), "seq": F.lit(40), "idx": null.cast("int"), "chapters": F.array(F.lit(1)), "state": F.lit("悬置"), "name": F.lit("new")}).select(order)
    early = books.withColumns(rest | {"action": F.lit("merge"), "seq": F.lit(35), "idx": F.col("n"), "chapters": F.array(F.lit(777))}).select(order)
    late = books.withColumns(rest | {"action": F.lit("merge"), "seq": F.lit(45), "idx": F.col("n"), "chapters": F.array(F.lit(5))}).select(order)
    far = books.withColumns(rest | {"action": F.lit("merge"), "seq": F.lit(50), "idx": F.lit(99), "chapters": none}).select(order)
    odd = books.withColumns(rest | {"action": F.lit("drop"), "seq": F.lit(60), "idx": F.lit(0), "chapters": none}).select(order)
    out = merges
    for part in (again, inserts, early, late, far, odd):
        out = out.unionByName(part)
    return out


@query
def apply_instructions(spark, sf):
    return rollup.applied_instructions(entries(spark, sf), instruction_rows(spark, sf)).withColumn("chapters", joined("chapters"))


@query
def rejected_instructions(spark, sf):
    return rollup.rejected_instructions(entries(spark, sf), instruction_rows(spark, sf))


@query
def rejection_reasons(spark, sf):
    return rollup.rejections(entries(spark, sf), instruction_rows(spark, sf))


# --- ledgers


@query
def pending_ledger(spark, sf):
    return ledger.pending_ledger(adapter.outcomes(spark, sf))


@query
def pending_reasons(spark, sf):
    return ledger.pending_reasons(adapter.outcomes(spark, sf).withColumn("reason", F.concat(F.lit("k"), "tokens")))


@query
def work_selection(spark, sf):
    """What is pending, of the books that the events name."""
    todo = adapter.outcomes(spark, sf).select("project", F.col("chapter").alias("number")).distinct()
    waiting = ledger.pending_ledger(adapter.outcomes(spark, sf)).withColumn("fixed", F.col("attempts") % 2 == 0)
    return ledger.selected_work(todo, waiting).unionByName(ledger.selected_work(todo, start=2, end=3))


@query
def pending_leftovers(spark, sf):
    """What is pending of chapters that never went well; those that did are the work at hand."""
    todo = adapter.outcomes(spark, sf).where("not failed").select("project", F.col("chapter").alias("number")).distinct()
    return ledger.leftovers(ledger.pending_ledger(adapter.outcomes(spark, sf)), todo)


def task_rows(spark, sf):
    o = adapter.load(spark, sf, "events")
    last = o.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    state = F.create_map(*[F.lit(x) for x in ("error", "failed", "click", "running", "view", "done", "purchase", "killed", "signup", "done")])
    return last.select(F.col("user_id").alias("id"), F.concat(F.lit("src"), F.col("user_id") % 20).alias("project"), (F.col("user_id") * 3).cast("int").alias("from_ch"), (F.col("user_id") * 3 + 40).cast("int").alias("to_ch"), state[F.col("event_type")].alias("status"))


@query
def range_state(spark, sf):
    return ledger.range_state(listed(spark, sf), adapter.annotated(spark, sf), task_rows(spark, sf))


@query
def range_missing(spark, sf):
    return ledger.range_missing(listed(spark, sf), adapter.annotated(spark, sf), task_rows(spark, sf))


@query
def next_batch(spark, sf):
    return ledger.next_batch(adapter.annotated(spark, sf))


@query
def failure_fuse(spark, sf):
    return ledger.failure_fuse(adapter.outcomes(spark, sf))


@query
def usage_cost(spark, sf):
    return ledger.usage_cost(adapter.outcomes(spark, sf))


@query
def usage_kinds(spark, sf):
    o = adapter.outcomes(spark, sf).withColumn("prompt_tokens", F.expr("tokens div 3"))
    return ledger.usage_kinds(o.withColumn("completion_tokens", F.col("tokens") - F.col("prompt_tokens")).withColumn("total_tokens", F.col("tokens")))


def meta_rows(spark, sf):
    total = listed(spark, sf).groupBy("project").agg(F.count(F.lit(1)).alias("chapters_total"))
    have = adapter.annotated(spark, sf).groupBy("project").agg(F.count(F.lit(1)).alias("chapters_annotated"))
    return total.join(have, "project", "left").na.fill(0, ["chapters_annotated"])


@query
def kb_status(spark, sf):
    books = listed(spark, sf).select("project").distinct()
    domains = books.where("project not in ('src1', 'src2')").select("project", F.when(F.col("project") > "src5", "ex").otherwise("my").alias("domain"))
    return ledger.kb_status(books, domains, meta_rows(spark, sf).where("project <> 'src4'"))


@query
def project_listing(spark, sf):
    """Books in two domains."""
    b = listed(spark, sf).select("project").distinct()
    my = b.where("project < 'src5'").select(F.concat(F.lit("mystore/"), "project", F.lit("project")).alias("path"))
    ex = b.where("project > 'src2'").select(F.concat(F.lit("ex/"), "project", F.lit("project/")).alias("path")).unionByName(b.select(F.concat(F.lit("ex/"), "project").alias("path")))
    return stores.list_projects(my, ex)


@query
def project_overview(spark, sf):
    waiting = chapters.missing(listed(spark, sf), adapter.annotated(spark, sf)).where("number % 2 = 0")
    return ledger.project_overview(meta_rows(spark, sf), waiting)


@query
def book_overview(spark, sf):
    return ledger.book_overview(manuscripts(spark, sf)).withColumn("updated", F.unix_timestamp("updated"))


@query
def session_overview(spark, sf):
    r = adapter.requests(spark, sf)
    s = r.groupBy("session_id").agg((F.max("seq") * 1000 + F.max("session_id") % 7).alias("created"))
    return ledger.session_overview(s, r, r.where("seq = 2"), r.where("seq = 3"))


@query
def task_merge(spark, sf):
    t = task_rows(spark, sf)
    return ledger.merged_tasks(t.where("id % 3 <> 0"), t.where("id % 4 <> 0").withColumn("status", F.lit("saved")))


@query
def stale_tasks(spark, sf):
    t = task_rows(spark, sf)
    done = listed(spark, sf).where("number % 5 <> 0 or project < 'src4'")
    return ledger.stale_tasks(t, ledger.range_state(listed(spark, sf), done, t)).select("id", "status")


@query
def log_tail(spark, sf):
    e = adapter.load(spark, sf, "events")
    lines = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 6 == 0, " ").otherwise(F.col("event_type")).alias("line"))
    return ledger.log_tail(lines, 20)


@query
def neighbour_context(spark, sf):
    return ledger.neighbours(adapter.requests(spark, sf))


@query
def chapter_bundle(spark, sf):
    t = adapter.chapter_text(spark, sf).select("project", "number", F.length("text").alias("n_chars"))
    return ledger.chapter_bundle(t, stored_stats(spark, sf), adapter.chapters(spark, sf))


# --- lexicon


@query
def label_words(spark, sf):
    return lexicon.label_words(adapter.shots(spark, sf))


@query
def unigram_counts(spark, sf):
    return lexicon.unigrams(lexicon.packed(adapter.sentences(spark, sf)))


@query
def ngram_counts(spark, sf):
    return lexicon.bigrams(lexicon.packed(adapter.sentences(spark, sf)))


@query
def pmi_table(spark, sf):
    return lexicon.pmi_table(lexicon.packed(adapter.sentences(spark, sf))).withColumn("pmi", F.round("pmi", 6))


@query
def pmi_words(spark, sf):
    clean = table(lexicon.packed(adapter.sentences(spark, sf)))
    return lexicon.pmi_words(clean, lexicon.pmi_table(clean))


@query
def lexicon_words(spark, sf):
    return lexicon.lexicon(adapter.shots(spark, sf), adapter.sentences(spark, sf))


@query
def lexicon_stats(spark, sf):
    return lexicon.lexicon_stats(lexicon_words(spark, sf))


def file_rows(spark, sf):
    return listed(spark, sf).select("project", F.col("number").alias("chapter"), (F.col("number") * 10).alias("mtime"))


@query
def manifest_diff(spark, sf):
    f = file_rows(spark, sf)
    now = lexicon.manifest(f, f.where("chapter % 9 <> 0"))
    then = now.where("project <> 'src6' or chapter % 5 <> 0").withColumn("sent_mtime", F.when((F.col("project") == "src7") & (F.col("chapter") % 10 == 8), "0").otherwise(F.col("sent_mtime")))
    return lexicon.needs_rebuild(now, then)


def recorded(spark, sf):
    """How the sentences and files stood at an earlier run: some chapters weren't there yet, some had another text, and one more chapter a book is gone since. (sentences, manifest)"""
    f, s = file_rows(spark, sf), adapter.sentences(spark, sf)
    turned = F.when(F.col("chapter") % 13 == 5, F.reverse("text")).otherwise(F.col("text"))
    old = s.where("chapter % 17 <> 3").withColumn("text", turned)
    gone = s.where("chapter % 17 = 4").withColumn("chapter", F.col("chapter") + 1_000_000)
    then = f.where("chapter % 17 <> 3").withColumn("mtime", F.when(F.col("chapter") % 13 == 5, 0).otherwise(F.col("mtime")))
    files = then.unionByName(f.where("chapter % 17 = 4").withColumn("chapter", F.col("chapter") + 1_000_000))
    return old.unionByName(gone), lexicon.manifest(files, files)


@query
def lexicon_refresh(spark, sf):
    """L8 acted upon: what was derived from an earlier state of the store, brought up to date; the same rows as a full build."""
    shots, sentences, f = adapter.shots(spark, sf), adapter.sentences(spark, sf), file_rows(spark, sf)
    was, then = recorded(spark, sf)
    stored = refresh.built(shots, was)
    stored = refresh.Derived(stored.unigrams, stored.bigrams, table(stored.words))
    return refresh.refreshed(stored, shots, sentences, was, refresh.changed_chapters(lexicon.manifest(f, f), then)).words


@query
def refreshed_counts(spark, sf):
    """The n-gram tables of that state after the signed changes of the chapters that differ."""
    f = file_rows(spark, sf)
    was, then = recorded(spark, sf)
    changed = table(refresh.changed_chapters(lexicon.manifest(f, f), then))
    old, new = (lexicon.packed(x.join(changed.where(c), ["project", "chapter"], "left_semi")) for x, c in ((was, "is_old"), (adapter.sentences(spark, sf), "is_new")))
    return refresh.merged_counts(lexicon.gram_counts(lexicon.packed(was)), lexicon.gram_counts(old), lexicon.gram_counts(new))


@query
def vector_refresh(spark, sf):
    """R16 acted upon, with a stand-in for the model: the size of the text and its letters e."""

    def embed(batch: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count("e"))] for t in batch]

    inputs = table(recall.embedding_inputs(recall.shot_texts(adapter.shots(spark, sf), adapter.sentences(spark, sf))))
    stored = inputs.where("chapter % 4 <> 0").select(*recall.SHOT, F.array(F.lit(-1.0).cast("float"), F.lit(-1.0).cast("float")).alias("embedding"))
    found = refresh.refreshed_vectors(stored, vector_plan(spark, sf), inputs, embed)
    return found.select(*recall.SHOT, F.col("embedding")[0].cast("long").alias("n_chars"), F.col("embedding")[1].cast("long").alias("n_e"))


# --- recall


def asked(spark, sf):
    """Requests as queries of a book each; by word overlap they look for their whole content."""
    r = adapter.requests(spark, sf)
    qid = F.concat_ws("-", "session_id", "seq")
    return r.withColumn("query_id", qid).withColumn("project", F.concat(F.lit("src"), F.col("session_id") % 20)).withColumn("text", F.col("content"))


@query
def shot_text(spark, sf):
    return recall.shot_texts(adapter.shots(spark, sf), adapter.sentences(spark, sf)).select("project", "chapter", "shot_id", "text")


@query
def label_recall(spark, sf):
    return recall.label_recall(adapter.shots(spark, sf), asked(spark, sf)).withColumn("funcs", joined("funcs"))


@query
def token_postings(spark, sf):
    texts = recall.shot_texts(adapter.shots(spark, sf), adapter.sentences(spark, sf))
    texts = texts.select("project", recall.shot_key().alias("key"), text.token_clean(F.col("text")).alias("text"))
    return lexicon.postings(texts, lexicon_words(spark, sf))


@query
def containment_hits(spark, sf):
    labels = adapter.shots(spark, sf).select("project", recall.shot_key().alias("key"), text.without_blanks(F.col("label")).alias("label")).where(F.length("label") >= 2)
    q = asked(spark, sf).select("query_id", "project", text.query_clean(F.col("content")).alias("q")).where(F.length("q") >= 2)
    return recall.containment(q, labels)


def token_inputs(spark, sf):
    """The lexicon and the shots' texts are read several times, so they are written first."""
    s = adapter.shots(spark, sf)
    texts = cut(recall.shot_texts(s, adapter.sentences(spark, sf)))
    return asked(spark, sf), s, texts, cut(lexicon_words(spark, sf))


@query
def token_overlap(spark, sf):
    return recall.token_counts(*token_inputs(spark, sf))


@query
def token_recall(spark, sf):
    return recall.token_hits(*token_inputs(spark, sf))


@query
def vector_topk(spark, sf):
    v = adapter.shot_vectors(spark, sf)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return recall.cosine_topk(q, v, 10).select("query_id", "project", "chapter", "shot_id", F.round("score", 6).alias("score"))


def merged_hits(spark, sf):
    """Three channels of each request; its vector is that of the row with its session's number (of as many as there are) and its place in it."""
    s = adapter.shots(spark, sf)
    v = adapter.shot_vectors(spark, sf)
    at = v.select(F.concat(F.lit("src"), F.col("vec_id") % 20).alias("project"), (F.col("vec_id") + 1).cast("int").alias("chapter"), F.lit("1").alias("shot_id"), "embedding")
    n = F.broadcast(v.agg(F.count(F.lit(1)).alias("vectors")))  # one row
    q = asked(spark, sf).join(n).withColumn("vec_id", (F.col("session_id") * 7 + F.col("seq")) % F.col("vectors")).join(v.select("vec_id", "embedding"), "vec_id").select("query_id", "embedding")
    return recall.merged(recall.label_hits(s, asked(spark, sf)), recall.token_hits(*token_inputs(spark, sf)), recall.cosine_topk(q, at))


@query
def recall_merge(spark, sf):
    """The flagship: a batch of requests, each with its references from three channels."""
    return merged_hits(spark, sf).select("query_id", "place", "channel", F.round("score", 6).alias("score"), "project", "chapter", "shot_id")


def references(spark, sf):
    s = adapter.shots(spark, sf)
    return recall.described(merged_hits(spark, sf), s, recall.shot_texts(s, adapter.sentences(spark, sf), trim=False))


@query
def context_block(spark, sf):
    return recall.context_blocks(references(spark, sf))


@query
def reference_lists(spark, sf):
    return draft.reference_lists(references(spark, sf), asked(spark, sf))


@query
def style_samples(spark, sf):
    r = references(spark, sf)
    parts = F.split("query_id", "-")
    return draft.style_samples(r.withColumn("session_id", parts[0]).withColumn("seq", parts[1].cast("int")))


@query
def known_books(spark, sf):
    r = asked(spark, sf).select("query_id", F.when(F.col("seq") % 3 == 0, "no such book").when(F.col("seq") % 3 == 1, F.col("project")).alias("project"))
    known, unknown = recall.known_books(r, adapter.shots(spark, sf))
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


@query
def embedding_inputs(spark, sf):
    return recall.embedding_inputs(recall.shot_texts(adapter.shots(spark, sf), adapter.sentences(spark, sf)))


@query
def embedded_inputs(spark, sf):
    """R15 with a stand-in for the model: shares of letters."""

    def embed(batch: list[str]) -> list[list[float]]:
        return [[t.count(c) / len(t) for c in "aeinorst"] for t in batch]

    return recall.embedded(embedding_inputs(spark, sf), embed).select("input", *[F.round(F.col("embedding")[i].cast("double"), 5).alias(f"e{i}") for i in range(8)])


def index_rows(spark, sf):
    f = file_rows(spark, sf).where("chapter % 4 <> 0")
    return f.select("project", "chapter", (F.col("chapter") % 9).alias("shot_count"), F.when(F.col("chapter") % 6 == 0, "0").otherwise(F.col("mtime").cast("string")).alias("source_mtime"), F.when(F.col("project") == "src9", "old").otherwise("m").alias("model"), F.lit(8).alias("dim"))


@query
def vector_plan(spark, sf):
    f = file_rows(spark, sf)
    return recall.vector_plan(lexicon.manifest(f, f), index_rows(spark, sf), "m", 8)


@query
def vector_stats(spark, sf):
    return recall.vector_stats(index_rows(spark, sf))


# --- drafts


@query
def fnv_temperature(spark, sf):
    r = adapter.requests(spark, sf)
    return r.select("session_id", "seq", text.fnv1a(F.col("content")).alias("hash"), text.temperature(F.col("content")).alias("temperature"))


@query
def tagged_draft(spark, sf):
    return draft.tagged_drafts(adapter.requests(spark, sf))


@query
def user_blocks(spark, sf):
    r = adapter.requests(spark, sf)
    n = F.col("session_id") % 4
    t = F.when(n == 0, F.concat("content", F.lit("\n \n"), "content")).when(n == 1, F.concat(F.lit("x\n【a】"), "content")).when(n == 2, F.concat(F.lit("12. "), "content")).otherwise(F.col("content"))
    return r.select("session_id", "seq", text.has_user_blocks(t).alias("blocks"))


@query
def dialogue_repair(spark, sf):
    r = adapter.requests(spark, sf)
    t = F.concat(F.lit("“走吧，”"), "label", F.lit("笑道“快走。”"), F.lit("\n他说，“"), "label", F.lit("”\n他说：好"))
    return r.select("session_id", "seq", draft.dialogue(t).alias("d")).select("session_id", "seq", "d.text", "d.fixes")


@query
def safe_names(spark, sf):
    r = adapter.requests(spark, sf)
    name = F.when(F.col("seq") == 1, "??  ").otherwise(F.col("content"))
    return r.select("session_id", "seq", text.safe_name(name).alias("name"), text.is_corpus_name(F.col("label")).alias("is_corpus_name"), text.padded(F.col("session_id") * 97).alias("padded"))


@query
def book_names(spark, sf):
    """Names asked for new books: a book's own, labels, blanks, and what a turn says."""
    r = asked(spark, sf)
    name = F.when(F.col("seq") == 1, F.concat(F.lit(" "), "project", F.lit(" "))).when(F.col("seq") == 2, F.col("label")).when(F.col("seq") == 3, "  ").otherwise(F.regexp_replace("content", "[ .,]", ""))
    return stores.new_books(r.select("query_id", name.alias("name")), adapter.chapter_text(spark, sf)).select("query_id", "problem")


@query
def stored_documents(spark, sf):
    """A book's JSON document is a file; some have no title."""
    path = fresh_path(spark)
    number = F.substring("project", 4, 9).cast("int")
    meta = meta_rows(spark, sf).select("project", F.col("project").alias("id"), F.col("chapters_total").alias("chapters"), F.when(number % 2 == 0, "t").alias("title"))
    meta.repartition("project").select("project", F.to_json(F.struct("id", "chapters", "title")).alias("value")).write.partitionBy("project").text(path)
    return stores.read_documents(spark, path, "id string, chapters long, title string")
