"""Shredding nested draft outputs into related flat tables.

One depth-first pass over each JSON output emits tagged rows: the tag names the
table, ``row_key`` is the row's path within the draft and ``parent_key`` that of
the row above it; all other members are the payload, as JSON. The rows can be
written partitioned by tag and read back as one table per tag with its schema.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGGED = "tag string, draft_id string, doc string, row_key string, parent_key string, name string, pos bigint, payload string"

#: Payload schema of each flat table.
PAYLOADS = {
    "output": "error_code string, error_message string",
    "field": "value string, confidence double, error_code string",
    "party": "name string, role string, address string",
    "item": "value string",
    "chunk": "chunk_id string",
    "section": "text string, groundedness double",
    "validator": "validator_id string, status string, message string",
}


def parse_output(text: str | None) -> dict[str, Any] | None:
    """The object that ``text`` holds, unpacked from JSON strings; None if there is none."""
    value: Any = text
    while isinstance(value, str):  # each unpacking leaves a shorter text
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, dict) else None


def _members(value: Any) -> Iterator[tuple[str | None, Any]]:
    """(name, member) of an object, or of a list of objects with a name."""
    if isinstance(value, dict):
        yield from value.items()
    elif isinstance(value, list):
        for member in value:
            if isinstance(member, dict) and member.get("name") is not None:
                yield str(member["name"]), {k: v for k, v in member.items() if k != "name"}


def _listed(value: Any) -> list[Any]:
    """A list as it is, null as none, anything else as a list of one."""
    return value if isinstance(value, list) else [] if value is None else [value]


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def visit(output: dict[str, Any], doc: str) -> Iterator[tuple[str, str, str | None, str | None, int, dict[str, Any]]]:
    """Depth first: (tag, row key, parent key, name, place, payload) of each row of an output."""
    yield "output", doc, None, None, 0, {k: _text(output.get(k)) for k in ("error_code", "error_message")}
    fields = output.get("fields")
    for name, member in _members(fields):
        wrapped = isinstance(member, dict) and ("value" in member or isinstance(fields, list))
        value, rest = (member.get("value"), member) if wrapped else (member, {})
        key = f"{doc}/field/{name}"
        confidence = rest.get("confidence")
        yield "field", key, doc, name, 0, {"value": _text(value), "confidence": confidence if isinstance(confidence, (int, float)) else None, "error_code": _text(rest.get("error_code"))}
        elements = value if isinstance(value, list) else [value] if isinstance(value, dict) else []
        for pos, element in enumerate(elements):
            if isinstance(element, dict):
                yield "party", f"{key}/party/{pos}", key, name, pos, {k: _text(element.get(k)) for k in ("name", "role", "address")}
            elif element is not None:
                yield "item", f"{key}/item/{pos}", key, name, pos, {"value": _text(element)}
        if doc == "ai":
            for pos, chunk in enumerate(_listed(rest.get("supporting_chunk_ids"))):
                if chunk is not None:
                    yield "chunk", f"{key}/chunk/{pos}", key, name, pos, {"chunk_id": _text(chunk)}
    scores = output.get("sections_groundedness")
    scores = scores if isinstance(scores, dict) else {}
    for part in ("sections_text", "sections"):
        for name, member in _members(output.get(part)):
            score = scores.get(name)
            yield "section", f"{doc}/section/{name}", doc, name, 0, {"text": _text(member.get("text") if isinstance(member, dict) else member), "groundedness": score if isinstance(score, (int, float)) else None}
    if doc == "ai":
        for pos, result in enumerate(_listed(output.get("validators"))):
            if isinstance(result, dict):
                yield "validator", f"{doc}/validator/{pos}", doc, _text(result.get("field_or_section")), pos, {k: _text(result.get(k)) for k in ("validator_id", "status", "message")}


def newest_drafts(drafts: DataFrame) -> DataFrame:
    """draft_id, ai_output, final_output of the row with the latest edited_at of each draft.

    A null edited_at is earliest; then the later created_at counts, then the
    outputs' order, so that ties have one outcome.
    """
    newest = F.max(F.struct("edited_at", "created_at", "ai_output", "final_output")).alias("newest")
    return drafts.where("draft_id is not null").groupBy("draft_id").agg(newest).select("draft_id", "newest.ai_output", "newest.final_output")


def shred(drafts: DataFrame) -> DataFrame:
    """Tagged rows of the newest outputs of all drafts.

    An output that is null, empty, cut off or no object gives no rows; one that
    is only an error object gives its ``output`` row alone. Rows without a
    draft_id are left out, as nothing could point to them. Extra columns are
    ignored and drafts delivered twice count once.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for draft, *texts in batch.itertuples(index=False):
                for doc, text in zip(("ai", "final"), texts):
                    if (output := parse_output(text)) is not None:
                        rows += [(tag, draft, doc, key, parent, name, pos, json.dumps(payload, ensure_ascii=False)) for tag, key, parent, name, pos, payload in visit(output, doc)]
            yield pd.DataFrame(rows, columns=["tag", "draft_id", "doc", "row_key", "parent_key", "name", "pos", "payload"])

    return newest_drafts(drafts).mapInPandas(emit, TAGGED)


def write_tables(tagged: DataFrame, path: str) -> None:
    """One pass over the tagged rows, written partitioned by tag."""
    tagged.write.partitionBy("tag").parquet(path)


def read_flat(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The flat table ``tag``: keys and the payload's columns (prefixed ``p_`` to keep clear of the keys)."""
    rows = spark.read.schema(TAGGED).parquet(path).where(F.col("tag") == tag)
    return flat_table(rows, tag)


def flat_table(tagged: DataFrame, tag: str) -> DataFrame:
    """The rows of one tag with the payload's schema applied."""
    rows = tagged.where(F.col("tag") == tag).withColumn("payload", F.from_json("payload", PAYLOADS[tag]))
    names = [part.split()[0] for part in PAYLOADS[tag].split(", ")]
    return rows.select("draft_id", "doc", "row_key", "parent_key", "name", "pos", *(F.col(f"payload.{n}").alias(f"p_{n}") for n in names))


def found(drafts: DataFrame, path: str) -> DataFrame:
    """draft_id, doc, kind, name, pos of every row below the outputs themselves, from the flat tables written under ``path``."""
    write_tables(shred(drafts), path)
    kinds = [tag for tag in PAYLOADS if tag != "output"]
    tables = (read_flat(drafts.sparkSession, path, tag).select("draft_id", "doc", F.lit(tag).alias("kind"), "name", "pos") for tag in kinds)
    return functools.reduce(DataFrame.unionByName, tables).distinct()
