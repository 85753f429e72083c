"""Near-duplicate pages: MinHash candidates, Bayesian pruning, exact verification.

Pages with the same set of shingles form one class; only one page of each class
takes part in the search. Bands of MinHash values give candidate pairs. Their
values are then compared a few at a time, those that belong to no band first: a
pair is dropped as soon as the posterior probability that it reaches the
threshold falls below a tolerance. The pairs that are left are verified on the
whole sets, which are made anew for their pages only. The classes of a band that
many share are cut into parts, and each two parts meet in a task of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.words import WordHashes, mix, window_hashes
from quirework.plans.storage import broadcast_if_small, materialize

SHINGLE = 3
THRESHOLD = 0.7
LEAST_WORDS = 30
#: Bands and MinHash values per band: a pair at the threshold is a candidate with probability 0.9994.
BANDS, ROWS = 40, 5
#: MinHash values (one byte each; those of the bands are the last), and how many are added at a time in the Bayesian comparison.
VALUES, STEP = 256, 8
#: A band is cut into PARTS parts if at least HOT of the classes that one in SAMPLED stands for share it. This says who does the work, not what is found.
HOT, PARTS, SAMPLED = 50, 32, 16
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-4

_FEATURES = "extraction_id string, set_key bigint, signature binary"


@functools.lru_cache(maxsize=1)
def _seeds() -> np.ndarray:
    return np.random.default_rng(20_240_229).integers(1, 1 << 63, size=VALUES, dtype=np.uint64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """One minimum per seed over the shingles' hashes."""
    multipliers = _seeds() * np.uint64(2) + np.uint64(1)
    best = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(shingles), 256):
        products = shingles[start : start + 256, None] * multipliers[None, :]
        np.minimum(best, (products ^ (products >> np.uint64(32))).min(axis=0), out=best)
    return best


@functools.lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After STEP, 2 * STEP, ... values: the fewest matches with which a pair stays.

    With a uniform prior the similarity of a pair that matches in m of n values
    has a Beta(m + 1, n - m + 1) posterior. A byte matches by chance in one of
    256 cases, so the probability of a match is s + (1 - s) / 256.
    """
    grid = (np.arange(4000) + 0.5) / 4000
    match = grid + (1 - grid) / 256
    least = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            density = m * np.log(match) + (n - m) * np.log1p(-match)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                least.append(m)
                break
    return tuple(least)


def survivors(left: np.ndarray, right: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which pairs of signatures stay; dropped pairs are compared no further."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for k, needed in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= needed]
    keep = np.zeros(len(left), dtype=bool)
    keep[alive] = True
    return keep


def shingle_set(text: str, memo: WordHashes) -> np.ndarray | None:
    """Hashes of the distinct shingles of a text of at least 30 words."""
    words = text.lower().split()
    return np.unique(window_hashes(memo.of(words), SHINGLE)) if len(words) >= LEAST_WORDS else None


def page_features(pages: DataFrame) -> DataFrame:
    """Key of the shingle set and signature of each page of at least 30 words."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for batch in batches:
            rows = []
            for key, text in batch.itertuples(index=False):
                if (shingles := shingle_set(text, memo)) is not None:
                    rows.append((key, xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63), mix(min_hashes(shingles)).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["extraction_id", "set_key", "signature"])

    return pages.where("full_text is not null and extraction_id is not null").select("extraction_id", "full_text").mapInPandas(features, _FEATURES)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Key of each band: its number and the five bytes of its values."""
    bands = signatures[:, VALUES - BANDS * ROWS :].reshape(-1, BANDS, ROWS).astype(np.int64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.int64), bands.shape[:2]).copy()
    for column in range(ROWS):
        keys = keys << 8 | bands[:, :, column]
    return keys


def _bands(classes: DataFrame) -> DataFrame:
    """band, set_key of every class."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype=np.uint8).reshape(-1, VALUES))
                own = np.repeat(batch.column("set_key").to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(own)], ["band", "set_key"])

    return classes.select("set_key", "signature").mapInArrow(bands, "band bigint, set_key bigint")


def candidates(keys: DataFrame, hot: int = HOT) -> DataFrame:
    """key_a < key_b of the classes that share a band, each pair once."""
    few = keys.where(F.pmod(F.xxhash64("set_key"), F.lit(SAMPLED)) == 0)
    crowded = materialize(few.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") >= hot).select("band"))
    left, right = (keys.select("band", F.col("set_key").alias(f"key_{side}")) for side in "ab")
    if crowded.isEmpty():
        return left.join(right, "band").where("key_a < key_b").select("key_a", "key_b").distinct()
    crowded = broadcast_if_small(crowded)
    left, right = (side.join(crowded, "band", "left_anti") for side in (left, right))
    own = keys.join(crowded, "band").withColumn("part", F.pmod(F.xxhash64("set_key"), F.lit(PARTS)).cast("int"))
    first = own.select("band", F.col("set_key").alias("one"), F.col("part").alias("low"), F.explode(F.sequence("part", F.lit(PARTS - 1))).alias("high"))
    second = own.select("band", F.col("set_key").alias("two"), F.explode(F.sequence(F.lit(0), "part")).alias("low"), F.col("part").alias("high"))
    met = first.join(second, ["band", "low", "high"]).where("low < high or one < two")
    split = met.select(F.least("one", "two").alias("key_a"), F.greatest("one", "two").alias("key_b"))
    return left.join(right, "band").where("key_a < key_b").select("key_a", "key_b").unionByName(split).distinct()


def _shingles(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """set_key, shingles of the classes of ``ids`` (extraction_id, set_key), made anew from the pages that stand for them."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for batch in batches:
            rows = []
            for key, text in batch.itertuples(index=False):
                shingles = shingle_set(text, memo)
                # an id delivered with several texts: only the one whose class is asked for
                if shingles is not None and xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) == key:
                    rows.append((key, shingles.view(np.int64)))
            yield pd.DataFrame(rows, columns=["set_key", "shingles"])

    texts = pages.where("full_text is not null").select("extraction_id", "full_text").join(broadcast_if_small(ids), "extraction_id")
    return texts.select("set_key", "full_text").mapInPandas(sets, "set_key bigint, shingles array<bigint>").dropDuplicates(["set_key"])


def _pruned(pairs: DataFrame) -> DataFrame:
    """Candidate pairs that the Bayesian comparison of their signatures leaves."""
    least = least_matches()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, VALUES) for c in ("sig_a", "sig_b"))
                yield batch.select(["key_a", "key_b"]).filter(pa.array(survivors(left, right, least)))

    return pairs.mapInArrow(prune, "key_a bigint, key_b bigint")


def similar_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): class of each page, and pairs of classes at or over the threshold.

    ``members`` has extraction_id and set_key, one row per page of 30 words or
    more; ``links`` has key_a < key_b and their similarity. Null and short
    texts take no part; pages delivered twice count once; extra columns are
    ignored. A large class of copies costs one row per copy only.
    """
    features = materialize(page_features(pages))
    members = features.select("extraction_id", "set_key").distinct()
    classes = materialize(features.groupBy("set_key").agg(F.min("extraction_id").alias("extraction_id"), F.first("signature").alias("signature")))
    pairs = candidates(_bands(classes))
    sides = {side: classes.select(F.col("set_key").alias(f"key_{side}"), F.col("signature").alias(f"sig_{side}")) for side in "ab"}
    kept = materialize(_pruned(pairs.join(sides["a"], "key_a").join(sides["b"], "key_b").select("key_a", "key_b", "sig_a", "sig_b")))
    asked = kept.select(F.explode(F.array("key_a", "key_b")).alias("set_key")).distinct()
    found_sets = materialize(_shingles(pages, classes.select("extraction_id", "set_key").join(broadcast_if_small(asked), "set_key")))
    sets = {side: found_sets.select(F.col("set_key").alias(f"key_{side}"), F.col("shingles").alias(f"set_{side}")) for side in "ab"}
    both = kept.join(sets["a"], "key_a").join(sets["b"], "key_b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    checked = both.select("key_a", "key_b", (common / (F.size("set_a") + F.size("set_b") - common)).alias("similarity"))
    return members, checked.where(F.col("similarity") >= THRESHOLD)


def found(pages: DataFrame) -> DataFrame:
    """All pairs of pages, copies included, that are near-duplicates."""
    members, links = similar_pages(pages)
    links = links.select("key_a", "key_b")
    same = members.select(F.col("set_key").alias("key_a"), F.col("set_key").alias("key_b")).distinct()
    a, b = (members.select(F.col("extraction_id").alias(f"id_{side}"), F.col("set_key").alias(f"key_{side}")) for side in "ab")
    pairs = links.unionByName(same).join(a, "key_a").join(b, "key_b")
    pairs = pairs.where("key_a <> key_b or id_a < id_b")
    return pairs.select(F.least("id_a", "id_b").alias("extraction_id_a"), F.greatest("id_a", "id_b").alias("extraction_id_b"))


def classes_with_links(pages: DataFrame) -> DataFrame:
    """extraction_id, class_id, n_links: class of each page, named by its smallest id, and how many other classes it is similar to."""
    members, links = similar_pages(pages)
    names = members.groupBy("set_key").agg(F.min("extraction_id").alias("class_id"))
    ends = links.select(F.explode(F.array("key_a", "key_b")).alias("set_key")).groupBy("set_key").agg(F.count("*").alias("n_links"))
    return members.join(names.join(ends, "set_key", "left"), "set_key").select("extraction_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
