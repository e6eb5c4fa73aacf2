"""Structure of documents: line kinds, blocks of lines, and heading paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col, trim_all

EMPTY, HEADING, PARAGRAPH, STEPS, TABLE = "Empty", "Heading", "Paragraph", "StepList", "Table"

NUMBERED = r"(?U)^(\d+(?:\.\d+)*)[.)]?\s+(\S.+)$"
CAPITALS = r"^[\p{Lu}\p{Z}\s\p{Nd}.\-:]{4,59}$"
SEPARATOR = r"(?U)^\|[\s\-:]+\|"
STEP = r"(?iU)^(?:Step\s*\d+[:.\s]|\d+[.)]\s+\S|[a-z][.)]\s+\S|[•\-*]\s+\S|➤\s+\S)"


def is_numbered_heading(line: Column) -> Column:
    """A number and a title of at most 10 words and 100 characters that is no sentence; ``line`` is trimmed."""
    title = F.regexp_extract(line, NUMBERED, 2)
    words = F.size(F.filter(F.split(title, r"(?U)\s+", -1), lambda w: w != ""))
    return ~line.rlike(r"(?U)^\d+\)") & line.rlike(NUMBERED) & (F.length(line) <= 100) & ~line.rlike("[.!?]$") & (words <= 10)


def line_kind(line: str | Column) -> Column:
    """Empty, Heading, Table, StepList or Paragraph; the first rule that fits holds."""
    t = trim_all(col(line))
    return (
        F.when(t == "", EMPTY)
        .when(t.startswith("#"), HEADING)
        .when(is_numbered_heading(t), HEADING)
        .when(t.rlike(CAPITALS), HEADING)
        .when((t.startswith("|") & t.endswith("|")) | t.rlike(SEPARATOR), TABLE)
        .when(t.rlike(STEP), STEPS)
        .otherwise(PARAGRAPH)
    )


def starts_block(before: Column, kind: Column) -> Column:
    """A line of ``kind`` ends the block whose kind so far is ``before``."""
    return (
        (kind == HEADING)
        | ((before == HEADING) & (kind == PARAGRAPH))
        | ((before == TABLE) & (kind != TABLE))
        | ((before != TABLE) & (kind == TABLE))
        | ((before == STEPS) & (kind == PARAGRAPH))
        | ((before == PARAGRAPH) & (kind == STEPS))
    )


def lines_of(pages: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row per line: keys, line_no (from 0) and line."""
    return pages.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))


def blocks(pages: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Blocks of each page: keys, block_no (from 0), block_type, text.

    Kinds change at lines; blank lines carry the kind before them on, and a
    page begins as a paragraph. One shuffle, on the keys of a page, serves the
    carried kind, the block's number and the block's lines; a page with any
    number of lines is one group, so pages are what bounds a task.
    """
    order = W.partitionBy(*keys).orderBy("line_no")
    kinds = lines_of(pages, *keys, text=text).withColumn("kind", line_kind("line"))
    real = F.when(F.col("kind") != EMPTY, F.col("kind"))
    carried = kinds.withColumn("before", F.coalesce(F.last(real, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(PARAGRAPH)))
    carried = carried.withColumn("after", F.coalesce(real, F.col("before")))
    split = carried.withColumn("block_no", F.sum((starts_block(F.col("before"), F.col("kind")) & (F.col("line_no") > 0)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    held = split.groupBy(*keys, "block_no").agg(F.max_by("after", "line_no").alias("block_type"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("held"))
    joined = trim_all(F.array_join(F.transform("held", lambda x: x["line"]), "\n"))
    return held.select(*keys, F.col("block_no").cast("int").alias("block_no"), "block_type", joined.alias("text"))


# ---- headings ----


def heading_level(line: str | Column) -> Column:
    t = trim_all(col(line))
    marks = F.length(F.regexp_extract(t, r"^#+", 0))
    numbers = F.size(F.split(F.regexp_extract(t, NUMBERED, 1), r"\.", -1))
    return F.when(marks > 0, marks).when(t.rlike(NUMBERED), numbers).otherwise(F.lit(1)).cast("int")


def heading_title(line: str | Column) -> Column:
    t = trim_all(col(line))
    numbered = F.concat_ws(" ", F.regexp_extract(t, NUMBERED, 1), trim_all(F.regexp_extract(t, NUMBERED, 2)))
    return F.when(t.startswith("#"), trim_all(F.regexp_replace(t, "^[# ]+", ""))).when(t.rlike(NUMBERED), numbered).otherwise(t)


def section_path(headings: Column) -> Column:
    """Path after an array of (level, title): a heading drops all of its level and deeper before it joins."""
    none = F.array().cast("array<struct<level:int,title:string>>")

    def push(stack: Column, h: Column) -> Column:
        own = F.struct(h["level"].cast("int").alias("level"), h["title"].alias("title"))
        return F.when(h["title"] == "", stack).otherwise(F.concat(F.filter(stack, lambda x: x["level"] < h["level"]), F.array(own)))

    return F.aggregate(headings, none, push, lambda stack: F.array_join(F.transform(stack, lambda x: x["title"]), " > "))


def heading_paths(headings: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Path that holds after each heading line of a document: doc, pos, path."""
    order = W.partitionBy(doc).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    own = headings.select(doc, pos, F.struct(heading_level(line).alias("level"), heading_title(line).alias("title")).alias("h"))
    return own.select(doc, pos, section_path(F.collect_list("h").over(order)).alias("path"))


def section_prefix(path: str | Column) -> Column:
    return F.when(col(path) != "", F.concat(F.lit("[Section: "), col(path), F.lit("] > "))).otherwise(F.lit(""))
