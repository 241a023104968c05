"""The driver's tables as annotation tables: books are sources, chapters are documents. No shuffle: all of a chapter comes from its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import enums

SENTENCES_A_SHOT = 4


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def chapter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, number, text); the number of a chapter is its doc_id + 1."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("project"), (F.col("doc_id") + 1).cast("int").alias("number"), F.coalesce("text", F.lit("")).alias("text"))


def _sentences(text: Column) -> Column:
    lines = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, chapter, pos, sid, seq, struct, text, shot_id); the shot_id isn't set yet. One row a sentence."""
    rows = chapter_text(spark, sf_dir).select("project", F.col("number").alias("chapter"), F.posexplode(_sentences(F.col("text"))).alias("pos", "text"))
    seq = F.col("pos") + 1
    return rows.select("project", "chapter", "pos", F.concat(F.lit("S"), seq).alias("sid"), seq.alias("seq"), F.when(F.col("text").contains(","), "句从").otherwise("短句").alias("struct"), "text", F.lit(None).cast("string").alias("shot_id"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, chapter, pos, shot_id, type, funcs, label, sentence_ids): four sentences a shot."""
    k = SENTENCES_A_SHOT
    chapters = chapter_text(spark, sf_dir).select("project", F.col("number").alias("chapter"), _sentences(F.col("text")).alias("s"))
    labels = F.transform(F.filter("s", lambda x, i: i % k == 0), lambda x: F.substring(F.regexp_replace(F.regexp_extract(x, r"^\s*(?:\S\s*){0,6}", 0), r"\s", ""), 1, 6))
    rows = chapters.select("project", "chapter", F.size("s").alias("n"), F.posexplode(labels).alias("pos", "label"))
    ids = F.transform(F.sequence(F.col("pos") * k + 1, F.least(F.col("pos") * k + k, F.col("n"))), lambda j: F.concat(F.lit("S"), j))
    number = F.col("pos") + 1
    one, two = pick(enums.SHOT_FUNCS, F.col("chapter") * 3 + number * 5), pick(enums.SHOT_FUNCS, F.col("chapter") + number * 2)
    return rows.select(
        "project",
        "chapter",
        "pos",
        number.cast("string").alias("shot_id"),
        pick(enums.SHOT_TYPES, F.col("chapter") * 7 + number).alias("type"),
        F.when((number % 2 == 0) & (one != two), F.array(one, two)).otherwise(F.array(one)).alias("funcs"),
        "label",
        ids.alias("sentence_ids"),
    )


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, number, title, function, summary, mainline), one row a chapter."""
    text = chapter_text(spark, sf_dir)
    n = F.col("number")
    progress = F.struct(F.concat(F.lit("e"), n % 5).alias("entity"), pick(enums.MAINLINE_STATES, n).alias("state"))
    return text.select("project", "number", F.concat(F.lit("t"), n).alias("title"), pick(enums.CHAPTER_FUNCS, n).alias("function"), F.coalesce(F.get(_sentences(F.col("text")), 0), F.lit("")).alias("summary"), F.array(progress).alias("mainline"))


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, number) of the chapters that count as annotated: those whose document has a label."""
    ids = load(spark, sf_dir, "labels").select("doc_id").distinct()
    return load(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi").select(F.col("source").alias("project"), (F.col("doc_id") + 1).cast("int").alias("number"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, text): a corpus file for each 200 chapter numbers of a book; each chapter is a heading line ``N、<doc_id>`` and its text's lines."""
    rows = chapter_text(spark, sf_dir)
    text = F.concat(F.col("number").cast("string"), F.lit("、d"), (F.col("number") - 1).cast("string"), F.lit("\n"), F.col("text"))
    book = F.concat("project", F.lit("-"), F.floor(F.col("number") / 200).cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("number", text.alias("text"))))  # at most 200 chapters a file
    return rows.groupBy(book.alias("project")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def events_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, type, chapter): the chapters in which a type of shot occurs, the stuff of lifecycle entries."""
    return shots(spark, sf_dir).select("project", "type", "chapter").distinct()


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, user, seq_ts, seq_id, chapter, failed, tokens, elapsed) of processing runs: users are books of chapters, events are attempts."""
    e = load(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("p"), F.col("user_id")).alias("project"), F.col("ts").alias("seq_ts"), F.col("event_id").alias("seq_id"), (F.col("event_id") % 7).cast("int").alias("chapter"), (F.col("event_type") == "error").alias("failed"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("elapsed"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, type, funcs, label, content): a turn of a conversation asks for one shot."""
    c = load(spark, sf_dir, "conversations")
    n, t = F.col("conv_id"), F.col("turn")
    one, two = pick(enums.SHOT_FUNCS, n * 3 + t * 5), pick(enums.SHOT_FUNCS, n + t * 2)
    funcs = F.when((t % 2 == 0) & (one != two), F.array(one, two)).otherwise(F.array(one))
    return c.select(n.alias("session_id"), (t + 1).cast("int").alias("seq"), pick(enums.SHOT_TYPES, n * 7 + t).alias("type"), funcs.alias("funcs"), F.substring(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""), 1, 6).alias("label"), F.coalesce("text", F.lit("")).alias("content"))


def shot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, chapter, shot_id, embedding)."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("b"), F.col("vec_id") % 5).alias("project"), F.floor(F.col("vec_id") / 20).cast("int").alias("chapter"), (F.col("vec_id") % 20).cast("string").alias("shot_id"), "embedding", "vec_id")
