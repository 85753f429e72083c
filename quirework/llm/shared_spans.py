"""Long exact spans shared between records, by fixed-block anchors.

A run of 40 words always holds a whole aligned block of 20 words of the other
record. The index holds those blocks; every rolling window of 20 words probes
it. Around the hits the windows of 40 words are compared over all records, and
runs of confirmed windows are the maximal exact repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.words import WordHashes, window_hashes
from quirework.plans.storage import materialize

RUN = 40
BLOCK = RUN // 2
#: Bits of a block's hash. A chance hit costs a look at the windows around it and never shows in the result.
BITS = 40
#: Places that the other bits tell apart. Of records with more windows, all from the last place on are looked at if one of them is hit.
PLACES = 1 << 64 - BITS


def text_records(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """rec, src, row_id, text of every record that can hold a run."""
    a = pages.select(F.lit("page_extractions").alias("src"), F.col("extraction_id").alias("row_id"), F.col("full_text").alias("text"))
    b = sections.select(F.lit("draft_sections").alias("src"), F.col("section_id").alias("row_id"), F.col("ai_text").alias("text"))
    records = a.unionByName(b).where(F.col("row_id").isNotNull() & (F.length("text") >= 2 * RUN - 1))
    return records.select(F.xxhash64("src", "row_id").alias("rec"), "src", "row_id", "text")


def _windows(records: DataFrame, step: int, most: int) -> DataFrame:
    """rec, window of the 20-word windows that start at multiples of ``step``.

    ``window`` packs the place (upper 24 bits) and 40 bits of the hash, as
    these rows are by far the most that are shuffled.
    """
    low = np.uint64((1 << BITS) - 1)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            packed = []
            for text in batch.column("text").to_pylist():
                own = window_hashes(memo.of(text.split()), BLOCK)[::step]
                places = np.minimum(np.arange(len(own), dtype=np.uint64) * np.uint64(step), np.uint64(most - 1))
                packed.append((places << np.uint64(BITS)) | (own & low))
            if packed:
                recs = np.repeat(batch.column("rec").to_numpy(zero_copy_only=False), [len(x) for x in packed])
                yield pa.RecordBatch.from_arrays([pa.array(recs), pa.array(np.concatenate(packed).view(np.int64))], ["rec", "window"])

    return records.select("rec", "text").mapInArrow(windows, "rec bigint, window bigint")


def _around_hits(hits: DataFrame, records: DataFrame, most: int) -> DataFrame:
    """rec, pos, hash of the 40-word windows that hold a hit."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            hashes, places, counts = [], [], []
            for text, hit in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist()):
                own = window_hashes(memo.of(text.split()), RUN)
                near = (np.asarray(hit, dtype=np.int64)[:, None] + np.arange(BLOCK - RUN, 1)[None, :]).ravel()
                if most - 1 in hit:
                    near = np.concatenate([near, np.arange(most - 1 + BLOCK - RUN, len(own))])
                near = np.unique(near[(near >= 0) & (near < len(own))])
                hashes.append(own[near])
                places.append(near.astype(np.int32))
                counts.append(len(near))
            if counts:
                recs = np.repeat(batch.column("rec").to_numpy(zero_copy_only=False), counts)
                yield pa.RecordBatch.from_arrays([pa.array(recs), pa.array(np.concatenate(places)), pa.array(np.concatenate(hashes).view(np.int64))], ["rec", "pos", "hash"])

    by_record = hits.groupBy("rec").agg(F.collect_set("pos").alias("hits"))
    return by_record.join(records.select("rec", "text"), "rec").mapInArrow(windows, "rec bigint, pos int, hash bigint")


def _in_another(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows whose hash also stands in another record of ``owners``, which has the first and last record of each hash."""
    return rows.join(owners.hint("shuffle_hash"), "hash").where("first_rec <> rec or last_rec <> rec")


def shared_spans(pages: DataFrame, sections: DataFrame, most: int = PLACES) -> DataFrame:
    """src, row_id, start_word, end_word of every maximal run of shared 40-word windows.

    A word lies in a span if it lies in a run of 40 words that stands, word for
    word, in another record. Null and short texts share nothing, a record
    delivered twice is one record, repeats within one record do not count, and
    extra columns are ignored. A passage that a third of all records share
    costs a row for each place it stands in, never a pair of places.
    """
    records = text_records(pages, sections)
    ends = (F.min("rec").alias("first_rec"), F.max("rec").alias("last_rec"))
    block = F.col("window").bitwiseAND(F.lit((1 << BITS) - 1))
    index = _windows(records, BLOCK, most).groupBy(block.alias("block")).agg(*ends)
    probes = _windows(records, 1, most).join(index.hint("shuffle_hash"), block == F.col("block"))
    # written, so that nothing later holds on to the shuffled windows
    hits = materialize(probes.where("first_rec <> rec or last_rec <> rec").select("rec", F.shiftrightunsigned("window", BITS).cast("int").alias("pos")))
    del probes, index
    around = materialize(_around_hits(hits, records, most))
    owners = around.groupBy("hash").agg(*ends).where("first_rec <> last_rec")
    runs = _in_another(around, owners).select("rec", "pos")
    order = Window.partitionBy("rec").orderBy("pos")
    fresh = F.coalesce(F.col("pos") > F.lag("pos").over(order) + RUN, F.lit(True))
    spans = runs.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(order))
    spans = spans.groupBy("rec", "span").agg(F.min("pos").alias("start_word"), (F.max("pos") + RUN).alias("end_word"))
    return spans.join(records.select("rec", "src", "row_id").distinct(), "rec").select("src", "row_id", "start_word", "end_word")


def found(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """src, row_id, shared_words of every record with shared words."""
    return shared_spans(pages, sections).groupBy("src", "row_id").agg(F.sum(F.col("end_word") - F.col("start_word")).cast("bigint").alias("shared_words"))
