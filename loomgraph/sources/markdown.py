"""Markdown files with front matter as documents and sections.

One file is one row; everything is parsed by native expressions on that row, so reading a
directory is a scan without a shuffle (but for the path order, see ``doc_seq``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import LINE_END, strip, title_words
from loomgraph.session import cut

FRONT = r"(?s)^---[\s\p{Z}]*\n(.*?)\n---[\s\p{Z}]*\n"
HEADING = r"^(#{1,6})[\s\p{Z}]+(.+)$"


def read_raw(spark: SparkSession, directory: str, pattern: str = "*.md") -> DataFrame:
    """file_path, raw_text of the files of one directory (not of its subdirectories)."""
    files = spark.read.option("pathGlobFilter", pattern).text(directory, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("raw_text"))


def lines(text: Column) -> Column:
    """Lines as ``str.splitlines`` gives them: no empty piece after a final line end."""
    parts = F.split(text, LINE_END)
    last = F.element_at(parts, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(last == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def front_matter(raw: Column) -> Column:
    """Key-value pairs of the block at the start; the last of repeated keys wins."""
    block = F.regexp_extract(raw, FRONT, 1)
    kept = F.filter(F.transform(lines(block), strip), lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))

    def pair(x: Column) -> Column:
        value = strip(F.regexp_replace(x, "(?s)^[^:]*:", ""))
        low = F.lower(value)
        shown = F.when(low.isin("true", "false"), low).otherwise(value)
        return F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), shown.alias("value"))

    pairs = F.transform(kept, pair)
    # Last one wins, without leaning on a session setting.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def body_of(raw: Column) -> Column:
    return F.regexp_replace(raw, FRONT, "")


def first_h1(body: Column) -> Column:
    """Text of the first ``# `` line, or null."""
    found = strip(F.regexp_extract(body, r"(?m)^#[\s\p{Z}]+(.+)$", 1))
    return F.when(found != "", found)


def sections_of(body: Column, root_title: Column) -> Column:
    """Sections in order: level, title, content, path.

    A heading closes the section before it. Sections without text are left out, but their
    headings stay on the path; text before the first heading belongs to the root title.
    """
    entry = "struct<level:int,title:string>"
    root = F.struct(F.lit(1).alias("level"), root_title.alias("title"))
    start = F.struct(
        F.array(root).cast(f"array<{entry}>").alias("stack"),
        F.array().cast("array<string>").alias("text"),
        F.array().cast("array<struct<level:int,title:string,content:string,path:string>>").alias("out"),
    )

    def flushed(s: Column) -> Column:
        content = strip(F.array_join(s["text"], "\n"))
        top = F.element_at(s["stack"], -1)
        path = F.array_join(F.transform(s["stack"], lambda h: h["title"]), " > ")
        row = F.struct(top["level"].alias("level"), top["title"].alias("title"), content.alias("content"), path.alias("path"))
        return F.when(content != "", F.concat(s["out"], F.array(row))).otherwise(s["out"])

    def step(s: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, HEADING, 1)).cast("int")
        head = F.struct(level.alias("level"), strip(F.regexp_extract(line, HEADING, 2)).alias("title"))
        # Levels rise along the stack, so popping is a filter.
        opened = F.concat(F.filter(s["stack"], lambda h: h["level"] < level), F.array(head)).cast(f"array<{entry}>")
        content = strip(F.array_join(s["text"], "\n"))
        rest = F.when(content != "", F.array().cast("array<string>")).otherwise(s["text"])
        turned = F.struct(opened.alias("stack"), rest.alias("text"), flushed(s).alias("out"))
        added = F.struct(s["stack"].alias("stack"), F.concat(s["text"], F.array(line)).alias("text"), s["out"].alias("out"))
        return F.when(line.rlike(HEADING), turned).otherwise(added)

    return F.aggregate(lines(body), start, step, flushed)


def parse_documents(raw: DataFrame) -> DataFrame:
    """Documents from (file_path, raw_text).

    Missing front matter falls back to: id from the file name, title from the first H1, else
    the id in title case; department General, tier Internal, version 1.0. Empty values count as
    missing for id and title only. Null texts give no row.
    """
    stem = F.regexp_replace(F.regexp_extract("file_path", r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    get = lambda k: F.try_element_at(F.col("metadata"), F.lit(k))
    some = lambda c: F.when(c != "", c)
    out = (
        raw.where("raw_text is not null")
        .withColumn("metadata", front_matter(F.col("raw_text")))
        .withColumn("body", body_of(F.col("raw_text")))
        .withColumn("document_id", F.coalesce(some(get("document_id")), stem))
        .withColumn("title", F.coalesce(some(get("title")), first_h1(F.col("body")), title_words(F.regexp_replace("document_id", "_", " "))))
    )
    return out.select(
        "document_id",
        "title",
        F.coalesce(get("department"), F.lit("General")).alias("department"),
        F.coalesce(get("access_tier"), F.lit("Internal")).alias("access_tier"),
        F.coalesce(get("version"), F.lit("1.0")).alias("version"),
        F.coalesce(get("last_updated"), F.lit("")).alias("last_updated"),
        "file_path",
        strip(F.col("body")).alias("content"),
        "raw_text",
        sections_of(F.col("body"), F.col("title")).alias("sections"),
        "metadata",
    )


def load_directory(spark: SparkSession, directory: str, pattern: str = "*.md") -> DataFrame:
    """Parsed documents with ``doc_seq``, their rank by path.

    Paths alone are sorted, in ranges: a row's rank is its place in its range after the rows of
    the ranges before (one count for each range).
    """
    docs = parse_documents(read_raw(spark, directory, pattern))
    ranged = cut(read_raw(spark, directory, pattern).select("file_path").repartitionByRange("file_path").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("file_path"))
    order = ranged.withColumn("place", place).join(F.broadcast(ahead), "range").select("file_path", (F.col("place") + F.col("ahead")).cast("int").alias("doc_seq"))
    return docs.join(order, "file_path")
