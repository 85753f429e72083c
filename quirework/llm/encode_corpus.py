"""Encoding a corpus with a public byte-level BPE vocabulary.

Short texts are encoded as they are. A long text is halved until its parts are
short; the parts are encoded in parallel and joined as a tree. Around each join
a window of the text is split again into pre-tokens, growing until it starts at
a boundary that no later text can move and reaches a boundary that the right
part has too; only what lies between the two is encoded anew.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public pattern of pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are encoded in parts.
PART_CHARS = 4096
#: Parts of a text in one batch.
PARTS_AT_ONCE = 1024
#: Ids on either side of a join that are looked at first.
WINDOW = 16

_PRE_TOKEN = regex.compile(PATTERN)
_IDS = pa.list_(pa.field("element", pa.int32(), nullable=True))


@functools.lru_cache(maxsize=2)
def encoder(ranks: bytes) -> tiktoken.Encoding:
    """The encoding of a rank file's contents."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _tail(encoding: tiktoken.Encoding, ids: list[int], count: int) -> tuple[int, str]:
    """Index of the first of at least ``count`` last ids that start on a whole character, and their text."""
    at = max(0, len(ids) - count)
    while True:
        try:
            return at, encoding.decode_bytes(ids[at:]).decode("utf-8")
        except UnicodeDecodeError:
            at -= 1


def _head(encoding: tiktoken.Encoding, ids: list[int], count: int) -> tuple[int, str]:
    """The same for the first ids: the index after them and their text."""
    at = min(len(ids), count)
    while True:
        try:
            return at, encoding.decode_bytes(ids[:at]).decode("utf-8")
        except UnicodeDecodeError:
            at += 1


def _fixed_boundary(text: str) -> int | None:
    """Where white space follows another character: every pre-token ends there whatever comes later."""
    for at in range(1, len(text)):
        if text[at].isspace() and not text[at - 1].isspace():
            return at
    return None


def _index_at(encoding: tiktoken.Encoding, ids: list[int], n_bytes: int) -> int:
    """How many of ``ids`` the first ``n_bytes`` bytes take."""
    taken = 0
    for index, token in enumerate(ids):
        if taken == n_bytes:
            return index
        taken += len(encoding.decode_single_token_bytes(token))
    return len(ids)


def join_ids(encoding: tiktoken.Encoding, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
    """The ids of the text of ``left`` followed by that of ``right``."""
    if not left or not right:
        return left + right
    while True:
        first, before = _tail(encoding, left, window)
        last, after = _head(encoding, right, window)
        start = 0 if first == 0 else _fixed_boundary(before)
        if start is not None:
            middle = before[start:] + after
            seam = len(before) - start
            own = {m.end() + seam for m in _PRE_TOKEN.finditer(after)}
            ends = [m.end() for m in _PRE_TOKEN.finditer(middle)]
            whole = last == len(right)
            # the window's last two pre-tokens may still change with what follows the window
            shared = [end for end in (ends if whole else ends[:-2]) if end >= seam and end in own and (whole or end < len(middle))]
            if whole and not shared:
                shared = [len(middle)]
            if shared:
                keep = first + _index_at(encoding, left[first:], len(before[:start].encode()))
                skip = _index_at(encoding, right[:last], len(middle[seam : shared[0]].encode()))
                # one pre-token at a time: the end of a cut-off text would draw in white space
                anew = [i for m in _PRE_TOKEN.finditer(middle) if m.end() <= shared[0] for i in encoding.encode_ordinary(m.group())]
                return left[:keep] + anew + right[skip:]
        if first == 0 and last == len(right):
            return encoding.encode_ordinary(before + after)
        window *= 2


def join_tree(encoding: tiktoken.Encoding, parts: list[list[int]]) -> list[int]:
    """Joins neighbouring parts level by level."""
    while len(parts) > 1:
        parts = [join_ids(encoding, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def _list_column(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=_IDS)


def encode_corpus(documents: DataFrame, vocabulary: str = VOCABULARY, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, ids: one row for each row of ``documents``; null and empty texts have an empty list.

    ``vocabulary`` is read on the driver and broadcast (a fixed file of under 1
    MB). Strings of special tokens in a text are ordinary text. Rows that share
    a doc_id and text are distinct rows of the result. Extra columns are
    ignored.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    texts = documents.select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value)
        for batch in batches:
            ids = [encoding.encode_ordinary(text) if text else [] for text in batch.column("text").to_pylist()]
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), _list_column(ids)], [*kept, "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value)
        for batch in batches:
            ids = [join_tree(encoding, [part["ids"] for part in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _list_column(ids)], ["doc_id", "ids"])

    short = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= part_chars).mapInArrow(encode, "doc_id bigint, ids array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every long text in 2**h equal parts, one batch after the other, each character copied once."""
        for batch in batches:
            for doc, print_, copies, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "print", "copies", "text"))):
                n = 1 << max(0, -(-len(text) // part_chars) - 1).bit_length()
                for first in range(0, n, PARTS_AT_ONCE):
                    numbers = range(first, min(first + PARTS_AT_ONCE, n))
                    parts = [text[k * len(text) // n : (k + 1) * len(text) // n] for k in numbers]
                    own = [pa.array([value] * len(parts), kind) for value, kind in ((doc, pa.int64()), (print_, pa.int64()), (copies, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int64()), pa.array(parts, pa.string())], ["doc_id", "print", "copies", "k", "text"])

    # keys come from the rows themselves, so that a task that runs again gives the same ones; equal rows are cut once
    long = texts.where(F.length("text") > part_chars).groupBy("doc_id", F.xxhash64("text").alias("print"), "text").agg(F.count("*").alias("copies"))
    parts = long.select("doc_id", "print", "copies", "text").mapInArrow(cut, "doc_id bigint, print bigint, copies bigint, k bigint, text string")
    encoded = parts.repartition("doc_id", "print", "k").mapInArrow(encode, "doc_id bigint, print bigint, copies bigint, k bigint, ids array<int>")
    grouped = encoded.groupBy("doc_id", "print", "copies").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    again = grouped.select("doc_id", "parts", F.explode(F.expr("sequence(1L, copies)")).alias("copy")).drop("copy")
    return short.unionByName(again.mapInArrow(join, "doc_id bigint, ids array<int>"))
