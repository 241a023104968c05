"""Readers and writers of corpus files, chapter lists, layered JSON documents and manuscripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.functions.text import book_name_problem, padded, trimmed
from storyloom.sources.checkpoints import table

SENTENCE_DOCUMENT = "schema string, chapter struct<number:int,title:string,range:string>, source string, sentences array<struct<id:string,seq:int,struct:string,text:string,shotId:string,note:string>>"
SHOT_DOCUMENT = "shots array<struct<id:string,type:string,funcs:array<string>,label:string,sentenceIds:array<string>,sentenceRange:array<int>>>"
CHAPTER_DOCUMENT = "chapter struct<number:int,title:string>, function string, summary string, mainlineProgress array<struct<entity:string,state:string>>, stats struct<sentenceCount:int,shotCount:int,shotTypeDist:map<string,int>,funcDist:map<string,int>,shortSentenceRate:double,sentenceClusterRate:double>, suspense array<struct<shot:string,label:string,sentenceRange:array<int>>>"


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, text, mtime) of each file; a file is one row, so its lines keep their order."""
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("mtime"))


def file_name(path: Column) -> Column:
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"\+", "%2B"))


def read_corpora(spark: SparkSession, path: str) -> DataFrame:
    """(project, text) of ``<name>-语料.txt`` files."""
    files = whole_files(spark, path).withColumn("name", file_name(F.col("path")))
    return files.where(F.col("name").endswith("-语料.txt")).select(F.regexp_replace("name", "-语料\\.txt$", "").alias("project"), "text")


def corpus_lines(corpora: DataFrame) -> DataFrame:
    """(project, line_no, line) from 0; CRLF counts as LF, an empty last line is kept."""
    lines = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1)
    return corpora.select("project", F.posexplode(lines).alias("line_no", "line"))


def parse_chapter_list(lines: DataFrame) -> DataFrame:
    """Rows ``number,title,start,end,chars`` or ``number,title,start-end`` of (project, line); a title may hold commas, other rows go."""
    # fixed values: the two forms of a row
    five, three = r"^(\d+),(.+),(\d+),(\d+),(\d+)$", r"^(\d+),(.+?),(\d+)-(\d+)$"
    line = F.col("line")
    long = line.rlike(five)

    def both(i: int, j: int) -> Column:
        return F.when(long, F.regexp_extract(line, five, i)).otherwise(F.regexp_extract(line, three, j))

    title = F.when(long, trimmed(F.regexp_extract(line, five, 2))).otherwise(F.regexp_extract(line, three, 2))
    rows = lines.where(long | line.rlike(three))
    return rows.select("project", both(1, 1).cast("int").alias("number"), title.alias("title"), both(3, 3).cast("int").alias("start"), both(4, 4).cast("int").alias("end"), F.when(long, F.regexp_extract(line, five, 5).cast("int")).alias("chars"))


def chapter_list_lines(chapters: DataFrame) -> DataFrame:
    """S3: the rows of a chapter list as lines (project, number, value)."""
    return chapters.select("project", "number", F.concat_ws(",", "number", "title", "start", "end", "chars").alias("value"))


def write_chapter_lists(chapters: DataFrame, path: str) -> None:
    """S3: one directory a project, each with its list in order under the head line."""
    head = chapters.select("project").distinct().select("project", F.lit(-1).alias("number"), F.lit("章号,标题,语料起始行,语料结束行,字符数").alias("value"))
    rows = head.unionByName(chapter_list_lines(chapters)).repartition("project").sortWithinPartitions("project", "number")
    rows.select("project", "value").write.mode("overwrite").partitionBy("project").text(path)


def read_layer(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents (project, chapter, mtime, doc) of a layer's ``第NNNN章.json`` files, and the rows (project, chapter, text) that don't parse."""
    return parsed_layer(whole_files(spark, path), schema)


def parsed_layer(files: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """S4 for files (path, text, mtime). A strict reader stops if there are rejects, a lenient one goes on with the documents."""
    files = files.withColumn("name", file_name(F.col("path"))).where(F.col("name").rlike("^第[0-9]{4,}章\\.json$"))
    rows = files.select(F.url_decode(F.regexp_extract("path", "/([^/]+)project/", 1)).alias("project"), F.regexp_extract("name", "([0-9]+)", 1).cast("int").alias("chapter"), "mtime", "text")
    parsed = rows.withColumn("doc", F.when(F.expr("try_parse_json(text)").isNotNull(), F.from_json("text", schema)))
    return parsed.where("doc is not null").select("project", "chapter", "mtime", "doc"), parsed.where("doc is null").select("project", "chapter", "text")


def flat_sentences(documents: DataFrame) -> DataFrame:
    rows = documents.select("project", "chapter", F.posexplode("doc.sentences").alias("pos", "s"))
    return rows.select("project", "chapter", "pos", F.col("s.id").alias("sid"), "s.seq", "s.struct", "s.text", F.col("s.shotId").alias("shot_id"))


def flat_shots(documents: DataFrame) -> DataFrame:
    rows = documents.select("project", "chapter", F.posexplode("doc.shots").alias("pos", "s"))
    return rows.select("project", "chapter", "pos", F.col("s.id").alias("shot_id"), "s.type", F.coalesce("s.funcs", F.array().cast("array<string>")).alias("funcs"), F.coalesce("s.label", F.lit("")).alias("label"), F.coalesce("s.sentenceIds", F.array().cast("array<string>")).alias("sentence_ids"), F.col("s.sentenceRange").alias("sentence_range"))


def list_projects(my: DataFrame, ex: DataFrame) -> DataFrame:
    """(project, domain) of both domains' paths that end in ``project``; a book in both counts as ``my``."""
    rows = my.select("path", F.lit("my").alias("domain"), F.lit(0).alias("rank")).unionByName(ex.select("path", F.lit("ex").alias("domain"), F.lit(1).alias("rank")))
    rows = rows.select(F.regexp_extract("path", "([^/]+)project/?$", 1).alias("project"), "domain", "rank").where("project <> ''")
    return rows.groupBy("project").agg(F.min_by("domain", "rank").alias("domain"))


def read_manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """(project, number, title, content, mtime) of ``<book>/第NNNN章.md``; the title is a first line ``# ...``."""
    return parsed_manuscripts(whole_files(spark, path, "*.md"))


def parsed_manuscripts(files: DataFrame) -> DataFrame:
    """S6 for files (path, text, mtime)."""
    files = files.withColumn("name", file_name(F.col("path"))).where(F.col("name").rlike("^第[0-9]{4}章\\.md$"))
    title = F.regexp_extract("text", r"^#\s+([^\n]+)", 1)
    return files.select(F.url_decode(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1)).alias("project"), F.regexp_extract("name", "([0-9]{4})", 1).cast("int").alias("number"), F.when(title != "", trimmed(title)).alias("title"), F.col("text").alias("content"), "mtime")


def split_name(number: Column, title: Column) -> Column:
    return F.concat(F.lit("第"), padded(number), F.lit("章_"), title, F.lit(".txt"))


def write_split_chapters(chapters: DataFrame, path: str) -> None:
    """Chapter texts as Parquet by project, with the file name that each would have."""
    chapters.withColumn("file_name", split_name(F.col("number"), F.col("title"))).write.mode("overwrite").partitionBy("project").parquet(path)


def published_versions(spark: SparkSession, path: str) -> DataFrame:
    """(project, version, folder) by the newest manifest under ``path``; no manifest: no rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "project string, version int, folder string")
    every = spark.read.schema("project string, version int, folder string, number int").parquet(f"{path}/manifest")
    newest = every.agg(F.max("number").alias("newest"))  # one row
    return every.join(F.broadcast(newest), F.col("number") == F.col("newest")).select("project", "version", "folder")


def publish(df: DataFrame, path: str) -> None:
    """A new version of the books (project, not null) that ``df`` holds; the others stay as they are, and all change at once.

    Books are written beside their old versions, then a manifest that names each book's folder: one file, which the committer moves into place as a whole. Readers go by the newest
    manifest, so a run that fails, at whatever place, changes nothing for them. A run after it writes over what it left.
    """
    spark = df.sparkSession
    old = table(published_versions(spark, path))
    number = (old.agg(F.max("version")).first()[0] or 0) + 1
    folder = F.concat(F.lit(f"v{number}@"), "project")
    df.withColumn("folder", folder).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{path}/data")
    new = df.select("project").distinct().select("project", F.lit(number).alias("version"), folder.alias("folder"))
    every = new.unionByName(old.join(new, "project", "left_anti"))
    every.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/number={number}")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The books by the newest manifest. Folders are partitions, so the join with the manifest reads only those that it names."""
    return spark.read.parquet(f"{path}/data").join(published_versions(spark, path).select("folder"), "folder").drop("folder")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file (sessions, tasks); what is missing is null."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def new_books(names: DataFrame, projects: DataFrame) -> DataFrame:
    """(…, name, problem) of asked names: too short, too long or of other characters, or ``taken`` by a book of either domain; null for those that can be made."""
    taken = projects.select(F.col("project").alias("_taken")).distinct()
    asked = names.withColumn("problem", book_name_problem(F.col("name"))).withColumn("name", trimmed(F.coalesce("name", F.lit(""))))
    rows = asked.join(taken, F.col("name") == F.col("_taken"), "left")
    return rows.withColumn("problem", F.coalesce("problem", F.when(F.col("_taken").isNotNull(), "taken"))).drop("_taken")


def latest(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key in an order that has no ties."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_row = 1").drop("_row")
