"""Evaluation passages inside training texts.

Items are normalised to words and cut into blocks of seven words. Any thirteen
consecutive words hold one whole block, so one Aho-Corasick automaton over all
blocks sees every leak while it scans each text once. A hit is extended word
by word to the longest common run and reported with its place in the original.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.plans.storage import materialize

#: Words that an item and a text must share in a row.
RUN = 13
#: Words of a block: 2 * BLOCK - 1 words in a row always hold a whole one.
BLOCK = (RUN + 1) // 2
#: Bytes of the items in one automaton; more are looked for in several passes.
BYTES_AT_ONCE = 16 << 20

_WORD = re.compile(r"\S+")
_DROPPED = re.compile(r"[^\w\s]|_")

SCHEMA = "doc_id bigint, item_id bigint, n_words int, item_word int, doc_word int, start_char int, end_char int, passage string"


def normalise(text: str) -> list[str]:
    """Words in lower case without anything but letters and digits; empty ones dropped."""
    return _DROPPED.sub("", text.lower()).split()


def word_places(text: str) -> list[tuple[int, int]]:
    """Place in the original text of each word that ``normalise`` keeps.

    Lower case is taken of the whole text there and word by word here; the few
    letters whose lower case depends on their neighbours stay one word.
    """
    return [m.span() for m in _WORD.finditer(text) if _DROPPED.sub("", m.group().lower())]


class Blocks:
    """One automaton over the blocks of all items, each with the items and places it comes from."""

    def __init__(self, items: list[tuple[int, tuple[str, ...]]]) -> None:
        self.items = items
        blocks: dict[str, list[tuple[int, int]]] = {}
        for index, (_, words) in enumerate(items):
            for at in range(0, len(words) - BLOCK + 1, BLOCK):
                blocks.setdefault(" " + " ".join(words[at : at + BLOCK]) + " ", []).append((index, at))
        self.tree = ahocorasick.Automaton()
        for block, places in blocks.items():
            self.tree.add_word(block, (len(block), places))
        if blocks:
            self.tree.make_automaton()

    def shared_runs(self, line: str) -> dict[tuple[int, int, int], int]:
        """Longest common runs of RUN words or more with normalised words: (item index, place in item, place in text) -> words."""
        runs: dict[tuple[int, int, int], int] = {}
        if not len(self.tree):
            return runs
        words, starts = [], {}
        for end, (size, places) in self.tree.iter(f" {line} "):
            if not words:
                words, at = line.split(" "), 0
                for index, word in enumerate(words):
                    starts[at] = index
                    at += len(word) + 1
            for item, place in places:
                own = self.items[item][1]
                a, b = place, starts[end + 1 - size]
                while a and b and own[a - 1] == words[b - 1]:
                    a, b = a - 1, b - 1
                if (item, a, b) in runs:
                    continue
                length = 0
                while a + length < len(own) and b + length < len(words) and own[a + length] == words[b + length]:
                    length += 1
                if length >= RUN:
                    runs[item, a, b] = length
        return runs


def _scanned(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Passages of a block of items in texts with their normalised words."""
    normalised = sorted((row.item_id, tuple(normalise(row.text))) for row in items.toLocalIterator())
    shared = texts.sparkSession.sparkContext.broadcast([(key, words) for key, words in normalised if len(words) >= RUN])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = Blocks(shared.value)
        for batch in batches:
            rows = []
            lines = batch["line"] if "line" in batch else (" ".join(normalise(text)) for text in batch["text"])
            for doc, text, line in zip(batch["doc_id"], batch["text"], lines):
                runs = blocks.shared_runs(line)
                places = word_places(text) if runs else []
                for (item, a, b), length in runs.items():
                    start, end = places[b][0], places[b + length - 1][1]
                    rows.append((doc, blocks.items[item][0], length, a, b, start, end, text[start:end]))
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in SCHEMA.split(", ")])

    return texts.mapInPandas(scan, SCHEMA)


def leaked_passages(documents: DataFrame, items: DataFrame, at_once: int | None = None) -> DataFrame:
    """Every longest run of 13 or more words that a document shares with an item, with its place.

    The items are taken in blocks of about ``at_once`` bytes (BYTES_AT_ONCE), each one automaton;
    with more than one block the texts are normalised once and written. Null,
    empty and short texts or items share nothing; items delivered twice count
    once. Extra columns are ignored.
    """
    known = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    blocks = max(1, -(-(known.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (at_once or BYTES_AT_ONCE)))
    texts = documents.where("text is not null").select("doc_id", "text")
    if blocks > 1:

        def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(line=[" ".join(normalise(text)) for text in batch["text"]])

        texts = materialize(texts.mapInPandas(lines, "doc_id bigint, text string, line string"))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return functools.reduce(DataFrame.unionByName, [_scanned(texts, known.where(block == turn)) for turn in range(blocks)])


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of each document that holds part of an item."""
    return leaked_passages(documents, items).select("doc_id", "item_id").distinct()
