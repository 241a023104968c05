"""Bookkeeping of runs: work selection, pending ledger, failure fuse, costs, status tables, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.scan import running_sums


def selected_work(listed: DataFrame, pending: DataFrame | None = None, everything: bool = False, chapters: list[int] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """All chapters, else the named ones, else a range, else the pending ones."""
    if everything:
        return listed
    if chapters:
        return listed.where(F.col("number").isin(chapters))
    if start is not None or end is not None:
        low = F.lit(True) if start is None else F.col("number") >= start
        return listed.where(low & (F.lit(True) if end is None else F.col("number") <= end))
    if pending is None:
        return listed.limit(0)
    waiting = pending.where(~F.coalesce("fixed", F.lit(False))).select("project", F.col("chapter").alias("number")).distinct()
    return listed.join(waiting, ["project", "number"], "left_semi")


def range_state(listed: DataFrame, done: DataFrame, tasks: DataFrame) -> DataFrame:
    """(id, project, todo, missing, reason) of tasks (id, project, from_ch, to_ch).

    The ends of the ranges are laid among the chapters of their book, and running counts at the two ends are subtracted: rows are sorted once, whatever the number
    of tasks, a large book in several ranges, and no task meets a chapter.
    """
    have = listed.join(done.select("project", "number", F.lit(True).alias("have")), ["project", "number"], "left")
    none = F.lit(None).cast(dict(tasks.dtypes)["id"])
    chapters = have.select("project", F.col("number").alias("at"), F.lit(1).alias("side"), none.alias("id"), F.lit(1).alias("n"), F.when(F.col("have").isNull(), 1).otherwise(0).alias("lacks"))
    ends = [tasks.select("project", F.col(c).alias("at"), F.lit(side).alias("side"), "id", F.lit(0).alias("n"), F.lit(0).alias("lacks")) for c, side in (("from_ch", 0), ("to_ch", 2))]
    rows = running_sums(chapters.unionByName(ends[0]).unionByName(ends[1]), ["project"], ["at", "side"], {"listed": F.col("n"), "lacking": F.col("lacks")}).where("side <> 1")
    sign = F.col("side") - 1
    out = rows.groupBy("id", "project").agg(F.greatest(F.sum(sign * F.col("listed")), F.lit(0)).alias("todo"), F.greatest(F.sum(sign * F.col("lacking")), F.lit(0)).alias("missing"))
    return out.withColumn("reason", F.when(F.col("todo") == 0, "empty_range").when(F.col("missing") == 0, "complete").otherwise("open"))


def range_missing(listed: DataFrame, done: DataFrame, tasks: DataFrame, width: int = 64) -> DataFrame:
    """(id, project, pos, number): the missing chapters of each task's range, in order. Ranges meet chapters by (book, block of ``width`` numbers)."""
    lacking = listed.join(done, ["project", "number"], "left_anti").withColumn("block", F.floor(F.col("number") / width))
    blocks = F.sequence(F.floor(F.col("from_ch") / width), F.floor(F.col("to_ch") / width))
    ranges = tasks.where("from_ch <= to_ch").select("id", "project", "from_ch", "to_ch", F.explode(blocks).alias("block"))
    rows = ranges.join(lacking, ["project", "block"]).where(F.col("number").between(F.col("from_ch"), F.col("to_ch")))
    return rows.select("id", "project", F.row_number().over(Window.partitionBy("id", "project").orderBy("number")).alias("pos"), "number")


def next_batch(done: DataFrame, size: int = 30) -> DataFrame:
    """(project, start, end) of the batch after the annotated chapters."""
    return done.groupBy("project").agg((F.count(F.lit(1)) + 1).alias("start")).withColumn("end", F.col("start") + size - 1)


def pending_ledger(outcomes: DataFrame) -> DataFrame:
    """(project, chapter, attempts) of chapters whose last outcome is a failure; attempts since the last success. Two partial aggregates, no window over a book."""
    at = F.struct("seq_ts", "seq_id")
    last_ok = outcomes.where(~F.col("failed")).groupBy("project", "chapter").agg(F.max(at).alias("ok"))
    fails = outcomes.where("failed").select("project", "chapter", at.alias("at")).join(last_ok, ["project", "chapter"], "left")
    return fails.where(F.col("ok").isNull() | (F.col("at") > F.col("ok"))).groupBy("project", "chapter").agg(F.count(F.lit(1)).alias("attempts"))


def pending_reasons(outcomes: DataFrame) -> DataFrame:
    """The pending chapters with the reason of their last failure: (project, chapter, attempts, reason)."""
    last = outcomes.where("failed").groupBy("project", "chapter").agg(F.max_by("reason", F.struct("seq_ts", "seq_id")).alias("reason"))
    return pending_ledger(outcomes).join(last, ["project", "chapter"])


def leftovers(ledger: DataFrame, todo: DataFrame) -> DataFrame:
    """Pending chapters outside the work at hand."""
    return ledger.join(todo.select("project", F.col("number").alias("chapter")), ["project", "chapter"], "left_anti")


def failure_fuse(outcomes: DataFrame, most: float = 0.3) -> DataFrame:
    """(project, seq_id, prior_failures, processed, blown): blown if earlier failures are over a share of what is processed, this one included."""
    failed = F.col("failed").cast("int")
    rows = running_sums(outcomes.select("project", "seq_ts", "seq_id", "failed"), ["project"], ["seq_ts", "seq_id"], {"failures": failed, "processed": F.lit(1)})
    rows = rows.select("project", "seq_id", (F.col("failures") - failed).alias("prior_failures"), F.col("processed").cast("int").alias("processed"))
    return rows.withColumn("blown", F.col("prior_failures") * 10 > F.col("processed") * round(most * 10))


def usage_cost(outcomes: DataFrame) -> DataFrame:
    """(project, calls, tokens, elapsed)."""
    return outcomes.groupBy("project").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("elapsed"), 2).alias("elapsed"))


def usage_kinds(outcomes: DataFrame) -> DataFrame:
    """(project, calls, prompt_tokens, completion_tokens, total_tokens); a call that reports no usage adds none."""
    kinds = ["prompt_tokens", "completion_tokens", "total_tokens"]
    return outcomes.groupBy("project").agg(F.count(F.lit(1)).alias("calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in kinds))


def kb_status(corpora: DataFrame, projects: DataFrame, meta: DataFrame) -> DataFrame:
    """(project, domain, state, chapters_annotated, chapters_total) of the corpora: built or not, with progress."""
    rows = corpora.select("project").distinct().join(projects, "project", "left").join(meta.select("project", "chapters_annotated", "chapters_total"), "project", "left")
    state = F.when(F.col("domain").isNull(), "unbuilt").when(F.coalesce("chapters_annotated", F.lit(0)) < F.coalesce("chapters_total", F.lit(0)), "building").otherwise("built")
    return rows.select("project", "domain", state.alias("state"), "chapters_annotated", "chapters_total")


def project_overview(meta: DataFrame, pending: DataFrame) -> DataFrame:
    """Meta with the number of pending chapters."""
    n = pending.groupBy("project").agg(F.count(F.lit(1)).alias("pending"))
    return meta.join(n, "project", "left").na.fill(0, ["pending"])


def book_overview(manuscripts: DataFrame) -> DataFrame:
    """(project, chapters, updated): the time is that of the chapter with the highest number."""
    return manuscripts.groupBy("project").agg(F.count(F.lit(1)).alias("chapters"), F.max_by("mtime", "number").alias("updated"))


def session_overview(sessions: DataFrame, requests: DataFrame, recalls: DataFrame, drafts: DataFrame) -> DataFrame:
    """(session_id, created, shots, has_recalls, has_draft, latest_final): the newest session with a final text is marked."""
    n = requests.groupBy("session_id").agg(F.count(F.lit(1)).alias("shots"))
    r, d = (x.select("session_id").distinct().withColumn(c, F.lit(True)) for x, c in ((recalls, "has_recalls"), (drafts, "has_draft")))
    rows = sessions.join(n, "session_id", "left").join(r, "session_id", "left").join(d, "session_id", "left").na.fill(0, ["shots"]).na.fill(False, ["has_recalls", "has_draft"])
    newest = rows.where("has_draft").agg(F.max(F.struct("created", "session_id")).alias("m")).select(F.col("m.session_id").alias("newest"))  # one row
    return rows.join(F.broadcast(newest)).withColumn("latest_final", F.coalesce(F.col("session_id") == F.col("newest"), F.lit(False))).drop("newest")


def merged_tasks(memory: DataFrame, disk: DataFrame) -> DataFrame:
    """(id, status, source): of a task in both, the one in memory counts only while it runs."""
    m = memory.select("id", F.col("status").alias("m_status"))
    d = disk.select("id", F.col("status").alias("d_status"))
    from_memory = F.col("d_status").isNull() | F.coalesce(F.col("m_status") == "running", F.lit(False))
    return m.join(d, "id", "full_outer").select("id", F.when(from_memory, F.col("m_status")).otherwise(F.col("d_status")).alias("status"), F.when(from_memory, "memory").otherwise("disk").alias("source"))


def stale_tasks(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """Failed or killed tasks whose range has nothing missing any more."""
    complete = states.where("missing = 0").select("id")
    return tasks.where(F.col("status").isin("failed", "killed")).join(complete, "id", "left_semi")


def log_tail(log: DataFrame, most: int = 500) -> DataFrame:
    """The last lines that aren't blank of each task's log (id, line_no, line)."""
    rows = log.where(F.trim("line") != "")
    w = Window.partitionBy("id").orderBy(F.col("line_no").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def neighbours(requests: DataFrame) -> DataFrame:
    """(session_id, seq, previous, next): the shots before and after, as the writer is shown them."""
    w = Window.partitionBy("session_id").orderBy("seq")

    def shown(of, head: str, none: str):
        text = F.concat(F.lit(f"【{head}·第"), of("seq"), F.lit("镜】"), of("type"), F.lit("「"), of("label"), F.lit("」："), of("content"))
        return F.coalesce(text, F.lit(none))

    before = shown(lambda c: F.lag(c).over(w), "前一分镜", "（无前一分镜，本镜是开场）")
    after = shown(lambda c: F.lead(c).over(w), "后一分镜", "（无后一分镜，本镜是收尾）")
    return requests.select("session_id", "seq", before.alias("previous"), after.alias("next"))


def chapter_bundle(texts: DataFrame, stats: DataFrame, chapters: DataFrame) -> DataFrame:
    """Text, annotation and counts of a chapter side by side."""
    s = stats.withColumnRenamed("chapter", "number").select("project", "number", "sentence_count", "shot_count")
    return texts.join(s, ["project", "number"], "left").join(chapters.select("project", "number", "function", "summary"), ["project", "number"], "left")
