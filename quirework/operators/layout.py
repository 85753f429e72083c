"""From printed lines to blocks: reading order, columns, gaps, headings, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A new block begins after a gap of more than so many line heights.
GAP = 1.5
#: A line is a heading if it is so much higher than its page's median and has at most so many words.
HEADING_HEIGHT, HEADING_WORDS = 1.35, 12


def distinct_spans(spans: DataFrame) -> DataFrame:
    return spans.dropDuplicates(["span_id"])


def page_texts(spans: DataFrame) -> DataFrame:
    """Text of each page, its lines joined by blanks in reading order, and their number."""
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", "span_id", F.coalesce("text", F.lit("")).alias("text"))))
    return distinct_spans(spans).groupBy("document_id", "page_number").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count("*").alias("n_spans"))


def page_confidence(spans: DataFrame, places: int = 3) -> DataFrame:
    """Mean confidence of each page, 0 where no line has one."""
    return distinct_spans(spans).groupBy("document_id", "page_number").agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), places).alias("mean_confidence"), F.count("*").alias("n_spans"))


def dominant_sources(spans: DataFrame) -> DataFrame:
    """The most frequent source of each document's lines, the first by name among equals."""
    counts = distinct_spans(spans).where("source is not null").groupBy("document_id", "source").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "source")).alias("best")
    return counts.groupBy("document_id").agg(best).select("document_id", "best.source", (-F.col("best.n")).alias("n"))


def gap_blocks(spans: DataFrame) -> DataFrame:
    """Blocks of lines: a gap of more than GAP median line heights begins a new one.

    Heights and places are fractions of the page, so the limit is relative to
    the page's own median height. Gives one row per block with its bounding box,
    its text in reading order and whether it is a heading.
    """
    lines = distinct_spans(spans).where("document_id is not null and page_number is not null").withColumn("height", F.col("y1") - F.col("y0"))
    page = Window.partitionBy("document_id", "page_number")
    order = page.orderBy("y0", "x0", "span_id")
    lines = lines.withColumn("median", F.percentile("height", F.lit(0.5)).over(page))
    fresh = F.coalesce((F.col("y0") - F.lag("y1").over(order) > GAP * F.col("median")).cast("int"), F.lit(1))
    lines = lines.withColumn("fresh", fresh).withColumn("block", F.sum("fresh").over(order).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", "span_id", F.coalesce("text", F.lit("")).alias("text"))))
    blocks = lines.groupBy("document_id", "page_number", "block").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count("*").alias("n_lines"), F.round(F.avg("height"), 9).alias("height"), F.first("median").alias("median"),
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
    )
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    heading = (F.col("height") > HEADING_HEIGHT * F.col("median")) & (words <= HEADING_WORDS)
    return blocks.withColumn("block_type", F.when(heading, "header").otherwise("paragraph")).drop("median")


def orphans_merged(blocks: DataFrame) -> DataFrame:
    """Paragraphs of a single word joined to the block before them; blocks renumbered from 0."""
    order = Window.partitionBy("document_id", "page_number").orderBy("block")
    single = (F.col("block_type") == "paragraph") & (F.size(F.filter(F.split("text", " "), lambda w: w != "")) <= 1) & (F.row_number().over(order) > 1)
    parts = blocks.withColumn("own", (~single).cast("int")).withColumn("to", F.sum("own").over(order))
    joined = parts.groupBy("document_id", "page_number", "to").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), " ").alias("text"), F.sum("n_lines").alias("n_lines"))
    return joined.select("document_id", "page_number", (F.col("to") - 1).cast("int").alias("reading_order"), "text", "n_lines")


def column_splits(spans: DataFrame, least_spans: int = 10, gap: float = 0.2, side: float = 0.1) -> DataFrame:
    """The first wide gap between the lines' horizontal middles of each page of enough lines."""
    page = Window.partitionBy("document_id", "page_number")
    mids = distinct_spans(spans).where("document_id is not null").select("document_id", "page_number", "span_id", ((F.col("x0") + F.col("x1")) / 2).alias("mid"))
    mids = mids.withColumn("n", F.count("*").over(page)).withColumn("low", F.min("mid").over(page)).withColumn("high", F.max("mid").over(page))
    mids = mids.withColumn("before", F.lag("mid").over(page.orderBy("mid", "span_id")))
    cut = (F.col("before") + F.col("mid")) / 2
    wide = mids.where((F.col("n") >= least_spans) & (F.col("mid") - F.col("before") > gap) & (cut - F.col("low") > side) & (F.col("high") - cut > side))
    return wide.groupBy("document_id", "page_number").agg(F.round(F.min(cut), 6).alias("split"))


def contained_spans(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """span_id, block: the last block whose box holds the line, joined on document and page so that boxes of other documents never match."""
    lines = distinct_spans(spans).select("span_id", "document_id", "page_number", *(F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = (F.col("s_x0") >= F.col("x0")) & (F.col("s_y0") >= F.col("y0")) & (F.col("s_x1") <= F.col("x1")) & (F.col("s_y1") <= F.col("y1"))
    return lines.join(blocks, ["document_id", "page_number"]).where(inside).groupBy("span_id").agg(F.max("block").alias("block"))


def text_layers(pages: DataFrame, least: int = 50, first: int = 5) -> DataFrame:
    """Whether each of a document's first pages has enough text to need no recognition."""
    rows = pages.where(F.col("page_num") <= first).groupBy("document_id", "page_num").agg(F.max(F.length(F.coalesce("full_text", F.lit("")))).alias("size"))
    return rows.groupBy("document_id").agg(F.coalesce(F.bool_and(F.col("size") >= least), F.lit(False)).alias("has_text_layer"))
