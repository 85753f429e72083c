"""File sources and sinks: uploads, text pages, JSON lines, templates, content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest upload that is taken.
MOST_BYTES = 50 * 1024 * 1024
#: What a file of each type begins with, in hexadecimal digits.
MAGIC = [("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff")]
#: Types that only an extension tells.
HINTS = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "json": "application/json"}
#: Bytes of a file that must be text for a text hint to hold.
SAMPLE_BYTES = 4096


def detected_type(content: Column, path: Column) -> Column:
    """The type by the first bytes, else by the extension; a text extension needs text without null bytes."""
    head = F.hex(F.substring(content, 1, 16))
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    sample = F.substring(content, 1, SAMPLE_BYTES)
    is_text = F.is_valid_utf8(sample.cast("string")) & ~F.hex(sample).rlike("^(..)*00")
    result = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    for magic, kind in MAGIC:
        result = result.when(head.startswith(magic), kind)
    for name, kind in HINTS.items():
        result = result.when((extension == name) & (is_text if name != "docx" else F.lit(True)), kind)
    return result


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, size_bytes, mime_type, content of all files within the size limit; empty files are left out."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length").between(1, MOST_BYTES))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), detected_type(F.col("content"), F.col("path")).alias("mime_type"), "content")


def write_blobs(uploads: DataFrame, path: str) -> None:
    """Contents addressed by their hash, in one folder for each first two digits, each once."""
    rows = uploads.select("sha256", "content").dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    rows.write.mode("append").partitionBy("prefix").parquet(path)


def text_spans(texts: DataFrame) -> DataFrame:
    """id, place, text and box of each paragraph of a text: equal slices of one page, one below the other."""
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    rows = texts.where("text is not null").select("id", F.size(parts).alias("n"), F.posexplode(parts).alias("place", "text"))
    low, gap = F.col("place") / F.col("n"), F.when(F.col("n") > 1, 0.2).otherwise(0.0)
    high = (F.col("place") + 1 - gap) / F.col("n")
    return rows.select("id", "place", "text", F.lit(0.05).alias("x0"), low.alias("y0"), F.lit(0.95).alias("x1"), high.alias("y1"), F.lit(1.0).alias("confidence"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Evaluation questions, edit pairs or gold rows, one JSON object per line."""
    return spark.read.schema(schema).json(path)


def new_template_versions(known: DataFrame, loaded: DataFrame) -> DataFrame:
    """Loaded templates whose fingerprint is not known yet, as the next version of their template."""
    newest = known.groupBy("template_id").agg(F.max("version").alias("last"))
    fresh = loaded.join(known.select("template_id", "fingerprint"), ["template_id", "fingerprint"], "left_anti")
    return fresh.join(newest, "template_id", "left").withColumn("version", F.coalesce("last", F.lit(0)) + 1).drop("last")
