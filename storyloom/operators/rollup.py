"""Chapter annotations to book tables; lifecycle and target rows; incremental merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.text import padded


def chapter_table(chapters: DataFrame) -> DataFrame:
    """One row a chapter, with the place of its statistics."""
    ref = F.concat(F.lit("章节/第"), padded(F.col("number")), F.lit("章.json"))
    return chapters.select("project", "number", "title", "function", "summary", ref.alias("stats_ref"))


def mainline_feed(chapters: DataFrame) -> DataFrame:
    """(project, number, pos, entity, state)."""
    return chapters.select("project", "number", F.posexplode("mainline").alias("pos", "m")).select("project", "number", "pos", "m.entity", "m.state")


def book_totals(chapters: DataFrame, stats: DataFrame) -> DataFrame:
    """(project, first_chapter, last_chapter, chapters, shots, sentences, words); words are never counted and stay 0."""
    a = chapters.groupBy("project").agg(F.min("number").alias("first_chapter"), F.max("number").alias("last_chapter"), F.count(F.lit(1)).alias("chapters"))
    b = stats.groupBy("project").agg(F.sum("shot_count").alias("shots"), F.sum("sentence_count").alias("sentences"))
    return a.join(b, "project", "left").na.fill(0, ["shots", "sentences"]).withColumn("words", F.lit(0).cast("long"))


def ordered_text(df: DataFrame, keys: list[str], order: list[str], text: Column, between: str, name: str) -> DataFrame:
    """Texts of a group joined in order. Made for groups of a session's or a book's size: short lines by chapter."""
    rows = df.select(*keys, F.struct(*order, text.alias("_text")).alias("_row")).groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    return rows.select(*keys, F.array_join(F.transform("_rows", lambda r: r["_text"]), between).alias(name))


def summary_lines(chapters: DataFrame) -> DataFrame:
    """(project, number, line)."""
    line = F.concat(F.lit("第"), padded(F.col("number")), F.lit("章 "), F.coalesce("title", F.lit("")), F.lit("（"), F.coalesce("function", F.lit("")), F.lit("）："), F.coalesce("summary", F.lit("")))
    return chapters.select("project", "number", line.alias("line"))


def summary_feed(chapters: DataFrame) -> DataFrame:
    """(project, feed), the lines of a book in order."""
    return ordered_text(summary_lines(chapters), ["project"], ["number"], F.col("line"), "\n", "feed")


def project_meta(listed: DataFrame, done: DataFrame, sentences: DataFrame, shots: DataFrame, bad_files: DataFrame, issues: DataFrame, most: int = 20) -> DataFrame:
    """One row a book: counts, number of missing chapters, syntax check, issues and the first of them. Inputs are reduced to a row a book before they meet."""
    n = F.count(F.lit(1))
    total = listed.groupBy("project").agg(n.alias("chapters_total"))
    have = done.groupBy("project").agg(n.alias("chapters_annotated"))
    missing = listed.join(done, ["project", "number"], "left_anti").groupBy("project").agg(n.alias("chapters_missing"))
    s, h = sentences.groupBy("project").agg(n.alias("sentences")), shots.groupBy("project").agg(n.alias("shots"))
    bad = bad_files.groupBy("project").agg(n.alias("bad_files"))
    row = F.row_number().over(Window.partitionBy("project").orderBy("chapter", "layer", "rule", "detail"))
    some = issues.withColumn("_n", row).where(F.col("_n") <= most).groupBy("project").agg(F.array_sort(F.collect_list(F.struct("_n", "chapter", "layer", "rule", "detail"))).alias("report"))
    found = issues.groupBy("project").agg(n.alias("contract_issues"))
    out = total
    for part in (have, missing, s, h, bad, found, some):
        out = out.join(part, "project", "left")
    counts = ["chapters_annotated", "chapters_missing", "sentences", "shots", "bad_files", "contract_issues"]
    return out.na.fill(0, counts).withColumn("syntax_pass", F.col("bad_files") == 0)


def repaired_events(events: DataFrame) -> DataFrame:
    """Lifecycle rows made consistent: no chapters means the start; closed without end ends at the start; an end not listed is added in order."""
    chapters = F.when(F.coalesce(F.array_size("chapters"), F.lit(0)) == 0, F.array("start_ch")).otherwise(F.col("chapters"))
    end = F.when((F.col("state") == "已回收") & F.col("end_ch").isNull(), F.col("start_ch")).otherwise(F.col("end_ch"))
    e = events.withColumn("chapters", chapters).withColumn("end_ch", end)
    inside = F.col("end_ch").isNull() | F.array_contains("chapters", F.coalesce("end_ch", F.lit(-1)))
    return e.withColumn("chapters", F.when(inside, F.col("chapters")).otherwise(F.array_sort(F.array_union("chapters", F.array("end_ch")))))


def with_main_target(targets: DataFrame) -> DataFrame:
    """The target with most evidence is the main one; of equals the first."""
    size = F.coalesce(F.array_size("evidence"), F.lit(0))
    best = targets.groupBy("project").agg(F.max(F.struct(size.alias("size"), (-F.col("idx")).alias("first"))).alias("best"))
    return targets.drop("is_main").join(best, "project").withColumn("is_main", F.col("idx") == -F.col("best.first")).drop("best")


def new_chapters(done: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Annotated chapters that the event snapshot doesn't hold; a book without one is new as a whole."""
    seen = snapshots.where("layer = 'event'").select("project", F.explode("aggregated").alias("number"))
    return done.join(seen, ["project", "number"], "left_anti")


def applied_instructions(entries: DataFrame, instructions: DataFrame) -> DataFrame:
    """Entries (project, layer, idx, name, chapters, state, end_ch) after the instructions, with applied and rejected counts of the book's layer.

    Instructions (project, layer, seq, action, idx, entity, chapters, state, end_ch, name) count in order of seq. insert appends an entry, at the place after all before it. merge adds
    chapters to the entry at its idx, if that is there by then and has the name given, if one is given; state only goes from 悬置 to 已回收, end only from null to a number, and both
    only in the event layer. What isn't applied is rejected. As all rules only go forward, the first end and any closing count, and groups are reduced by min and bool_or.
    """
    base = entries.groupBy("project", "layer").agg((F.max("idx") + 1).alias("n_base"))
    inserts = instructions.where("action = 'insert' and name is not null").join(base, ["project", "layer"], "left")
    place = F.row_number().over(Window.partitionBy("project", "layer").orderBy("seq")) - 1 + F.coalesce("n_base", F.lit(0))
    inserted = inserts.select("project", "layer", place.alias("idx"), "name", F.coalesce("chapters", F.array().cast("array<int>")).alias("chapters"), "state", "end_ch", F.col("seq").alias("born"))
    every = entries.select("project", "layer", "idx", "name", "chapters", "state", "end_ch", F.lit(-1).cast("long").alias("born")).unionByName(inserted.withColumn("born", F.col("born").cast("long")))
    merges = instructions.where("action = 'merge'").select("project", "layer", "idx", "seq", "entity", F.col("chapters").alias("more"), F.col("state").alias("to_state"), F.col("end_ch").alias("to_end"))
    fits = merges.join(every, ["project", "layer", "idx"]).where((F.col("seq") > F.col("born")) & (F.col("entity").isNull() | (F.col("entity") == "") | (F.col("entity") == F.col("name"))))
    per = fits.groupBy("project", "layer", "idx").agg(
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("more", F.array().cast("array<int>"))))).alias("more"),
        F.bool_or(F.col("to_state") == "已回收").alias("closes"),
        F.min_by("to_end", F.when(F.col("to_end").isNotNull(), F.col("seq"))).alias("first_end"),
        F.count(F.lit(1)).alias("merged"),
    )
    rows = every.join(per, ["project", "layer", "idx"], "left")
    event = F.col("layer") == "event"
    none = F.array().cast("array<int>")
    rows = rows.select(
        "project",
        "layer",
        "idx",
        "name",
        F.when(F.col("merged").isNull(), F.col("chapters")).otherwise(F.array_sort(F.array_union(F.coalesce("chapters", none), F.coalesce("more", none)))).alias("chapters"),
        F.when(event & (F.col("state") == "悬置") & F.coalesce("closes", F.lit(False)), "已回收").otherwise(F.col("state")).alias("state"),
        F.when(event, F.coalesce("end_ch", "first_end")).otherwise(F.col("end_ch")).alias("end_ch"),
        (F.coalesce("merged", F.lit(0)) + F.when(F.col("born") >= 0, 1).otherwise(0)).alias("applied"),
    )
    return rows


def rejected_instructions(entries: DataFrame, instructions: DataFrame) -> DataFrame:
    """(project, layer, given, applied, rejected)."""
    done = applied_instructions(entries, instructions).groupBy("project", "layer").agg(F.sum("applied").alias("applied"))
    given = instructions.groupBy("project", "layer").agg(F.count(F.lit(1)).alias("given"))
    return given.join(done, ["project", "layer"], "left").select("project", "layer", "given", F.coalesce("applied", F.lit(0)).alias("applied")).withColumn("rejected", F.col("given") - F.col("applied"))


def rejections(entries: DataFrame, instructions: DataFrame) -> DataFrame:
    """(project, layer, seq, action, idx, reason) of each instruction that isn't applied: an action that there isn't, an insert without a name, a merge
    into a place where no entry is by then, or into one of another name."""
    base = entries.groupBy("project", "layer").agg((F.max("idx") + 1).alias("n_base"))
    named = instructions.where("action = 'insert' and name is not null").join(base, ["project", "layer"], "left")
    place = F.row_number().over(Window.partitionBy("project", "layer").orderBy("seq")) - 1 + F.coalesce("n_base", F.lit(0))
    born = named.select("project", "layer", place.alias("idx"), F.col("name").alias("e_name"), F.col("seq").cast("long").alias("born"))
    every = entries.select("project", "layer", "idx", F.col("name").alias("e_name"), F.lit(-1).cast("long").alias("born")).unionByName(born)
    rows = instructions.join(every, ["project", "layer", "idx"], "left")
    there = F.col("born").isNotNull() & (F.col("seq") > F.col("born"))
    fits = F.col("entity").isNull() | (F.col("entity") == "") | (F.col("entity") == F.col("e_name"))
    merge = F.col("action") == "merge"
    reason = F.when(merge & ~F.coalesce(there, F.lit(False)), "no_entry").when(merge & ~F.coalesce(fits, F.lit(False)), "other_name").when((F.col("action") == "insert") & F.col("name").isNull(), "no_name").when(~F.col("action").isin("merge", "insert"), "unknown_action")
    return rows.select("project", "layer", "seq", "action", "idx", reason.alias("reason")).where("reason is not null")


def updated_snapshots(snapshots: DataFrame, fresh: DataFrame) -> DataFrame:
    """(project, layer, aggregated): old and new chapters, in order."""
    new = fresh.groupBy("project").agg(F.array_sort(F.collect_set("number")).alias("new"))
    none = F.array().cast("array<int>")
    return snapshots.join(new, "project", "left").select("project", "layer", F.array_sort(F.array_union(F.coalesce("aggregated", none), F.coalesce("new", none))).alias("aggregated"))


def reentered(fresh: DataFrame, states: DataFrame) -> DataFrame:
    """(project, temp_ts): the stamp of an earlier try at just this batch, else null."""
    new = fresh.select("project", "number").distinct()
    n_new = new.groupBy("project").agg(F.count(F.lit(1)).alias("n_new"))
    held = states.select("project", F.explode("batch").alias("number"))
    n_same = new.join(held, ["project", "number"]).groupBy("project").agg(F.count(F.lit(1)).alias("n_same"))  # sums, no lists, however large a batch is
    rows = n_new.join(states.select("project", "temp_ts", F.size("batch").alias("n_held")), "project", "left").join(n_same, "project", "left")
    return rows.select("project", F.when((F.col("n_new") == F.col("n_held")) & (F.col("n_new") == F.col("n_same")), F.col("temp_ts")).alias("temp_ts"))
