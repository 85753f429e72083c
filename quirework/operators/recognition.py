"""Recognition results: parsing, boxes, page classes and the way each page is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean confidence under which a page is read again, and pages of a document that the visual model may read.
LOW_CONFIDENCE, MOST_VISUAL_PAGES = 0.7, 20
#: Characters under which a page is described instead of transcribed, and that make a text layer.
FEW_CHARS, LAYER_CHARS = 50, 50
LINES = "lines array<struct<text string, bbox array<string>>>"


def parsed_lines(responses: DataFrame, confidence: float = 0.85) -> DataFrame:
    """page_id, place, text, x0, y0, x1, y1, confidence from the JSON answers of a visual model.

    JSON inside a JSON string is unpacked once; boxes are clamped to the page;
    lines without text, with fewer than four numbers or with an empty box are
    left out.
    """
    inner = F.get_json_object(F.concat(F.lit('{"v":'), "response", F.lit("}")), "$.v")
    body = F.when(F.trim("response").startswith('"'), inner).otherwise(F.col("response"))
    rows = responses.select("page_id", F.from_json(body, LINES).alias("r")).select("page_id", F.posexplode("r.lines").alias("place", "line"))
    box = [F.least(F.greatest(F.get("line.bbox", F.lit(k)).try_cast("double"), F.lit(0.0)), F.lit(1.0)) for k in range(4)]
    numbers = [F.get("line.bbox", F.lit(k)).try_cast("double").isNotNull() for k in range(4)]
    rows = rows.select("page_id", "place", F.trim("line.text").alias("text"), *(F.when(n, b).alias(c) for n, b, c in zip(numbers, box, ("x0", "y0", "x1", "y1"))))
    return rows.where("text <> '' and x0 < x1 and y0 < y1").withColumn("confidence", F.lit(confidence))


def polygon_box(polygon: Column, width: Column, height: Column) -> Column:
    """Struct of x0, y0, x1, y1 as fractions of the page of an array of (x, y) points."""
    xs, ys = F.transform(polygon, lambda p: p[0] / width), F.transform(polygon, lambda p: p[1] / height)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.struct(clamp(F.array_min(xs)).alias("x0"), clamp(F.array_min(ys)).alias("y0"), clamp(F.array_max(xs)).alias("x1"), clamp(F.array_max(ys)).alias("y1"))


def page_classes(pages: DataFrame) -> DataFrame:
    """Class of each page by its text layer and the features of its image, the first that holds."""
    kind = (
        F.when(F.col("layer_chars") >= LAYER_CHARS, "native").when(F.col("sharpness") < 60, "blurry").when(F.col("strokes") > 0.5, "handwriting").when((F.abs(F.col("skew")) > 3) | (F.col("speckle") > 0.2), "degraded").otherwise("clean")
    )
    return pages.withColumn("page_class", kind)


def page_routes(pages: DataFrame) -> DataFrame:
    """document_id, page_num, route: how each page (document_id, page_num, override, layer_chars, confidence, chars) is read.

    An override wins; a text layer is taken as it is; a sure result stays; of
    the others the first pages of a document go to the visual model, up to its
    cap, nearly empty ones to be described; the rest are flagged.
    """
    wanted = F.when(F.col("override").isNotNull(), F.lit(False)).otherwise((F.col("layer_chars") < LAYER_CHARS) & (F.coalesce("confidence", F.lit(0.0)) < LOW_CONFIDENCE))
    rows = pages.withColumn("wanted", wanted)
    turn = F.sum(F.col("wanted").cast("int")).over(Window.partitionBy("document_id").orderBy("page_num", "page_id"))
    visual = F.when(F.col("chars") < FEW_CHARS, "describe").otherwise("transcribe")
    route = F.when(F.col("override").isNotNull(), F.col("override")).when(F.col("layer_chars") >= LAYER_CHARS, "text_layer").when(~F.col("wanted"), "keep")
    return rows.withColumn("turn", turn).select("page_id", "document_id", "page_num", route.when(F.col("turn") <= MOST_VISUAL_PAGES, visual).otherwise("visual_budget_exceeded").alias("route"))
