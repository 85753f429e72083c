"""Splitting oversized texts at natural boundaries.

Every gap between two words gets a boundary strength (paragraph, sentence,
clause, plain). A sparse table answers "strongest gap within this range of
piece lengths" in constant time; among equal strengths the rightmost gap wins.
The next piece starts ``overlap`` words before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.plans.storage import broadcast_if_small

OVERLAP = 15
PLAIN, CLAUSE, SENTENCE, PARAGRAPH = range(4)

#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = frozenset("no. v. vs. mr. mrs. ms. dr. st. ave. rev. art. sec. ext. fig. p. pp. e.g. i.e. approx. dept. est. jr. sr. a.m. p.m.".split())

_WORD = re.compile(r"\S+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
_SENTENCE_END = re.compile(r"[.!?…。][\"'”’)\]]*$")
_INITIAL = re.compile(r"^[(\"“]?[A-Z]\.$")

SCHEMA = "extraction_id string, piece_no int, n_pieces int, start_word int, end_word int, n_words int, boundary int, piece string"


def boundary_strengths(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of the gap after each word."""
    strengths = np.zeros(len(starts), dtype=np.int64)
    for i in range(len(starts)):
        last = text[ends[i] - 1]
        if i + 1 < len(starts) and starts[i + 1] - ends[i] > 1 and _BLANK_LINE.search(text, ends[i], starts[i + 1]):
            strengths[i] = PARAGRAPH
        elif last.isalnum():
            continue
        else:
            word = text[starts[i] : ends[i]]
            if _SENTENCE_END.search(word):
                following = text[starts[i + 1]] if i + 1 < len(starts) else "A"
                abbreviated = word.lower() in ABBREVIATIONS or _INITIAL.match(word)
                strengths[i] = CLAUSE if abbreviated or following.islower() else SENTENCE
            elif last in ",;:)":
                strengths[i] = CLAUSE
    return strengths


class StrongestGap:
    """Sparse table over boundary strengths; ties go to the right."""

    def __init__(self, strengths: np.ndarray) -> None:
        n = len(strengths)
        self.size = n
        self.levels = [strengths * n + np.arange(n)]
        width = 1
        while 2 * width <= n:
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def query(self, low: int, high: int) -> tuple[int, int]:
        """Strength and place of the strongest gap in ``low..high``, both included."""
        level = (high - low + 1).bit_length() - 1
        best = int(max(self.levels[level][low], self.levels[level][high - (1 << level) + 1]))
        return divmod(best, self.size)


def cut_points(strengths: np.ndarray, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(first word, word after the last, strength of the cut) of each piece."""
    n = len(strengths)
    limit = max(limit, 1)
    overlap = min(overlap, limit - 1)
    table, pieces, start = StrongestGap(strengths), [], 0
    while n - start > limit:
        least = start + overlap  # a gap after this word still moves on by a word
        high = start + limit - 1
        middle = max(least, start + limit // 2)
        strength, gap = table.query(middle, high)
        if strength < SENTENCE and middle > least:
            strength, gap = max((strength, gap), table.query(least, middle - 1))
        pieces.append((start, gap + 1, strength))
        start = gap + 1 - overlap
    pieces.append((start, n, PARAGRAPH))
    return pieces


def split_text(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces of ``text``: first word, word after the last, strength of the cut, the text itself; none if it fits."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) <= limit:
        return []
    starts, ends = np.array(spans).T
    return [(a, b, s, text[starts[a] : ends[b - 1]]) for a, b, s in cut_points(boundary_strengths(text, starts, ends), limit, overlap)]


def latest_limits(specs: DataFrame) -> DataFrame:
    """template_id, section_name, limit_max of the highest version of each section that has a limit."""
    newest = F.max(F.struct("template_version", "created_at", "target_length_max")).alias("newest")
    return specs.groupBy("template_id", F.col("name").alias("section_name")).agg(newest).select("template_id", "section_name", F.col("newest.target_length_max").alias("limit_max")).where("limit_max is not null")


def split_oversized(pages: DataFrame, specs: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every page that has more words than its section's newest spec allows.

    A page that fits, or has no spec, no limit or no text, gives no rows. A
    limit below one word counts as one word for the pieces. Rows delivered
    twice give their pieces once; extra columns are ignored. Pieces are exact
    slices of the text, in order, each starting ``overlap`` words before the
    end of the last one (fewer where the limit itself is not larger).
    """
    limits = broadcast_if_small(latest_limits(specs))
    due = pages.select("extraction_id", "template_id", "section_name", "full_text").join(limits, ["template_id", "section_name"]).where(F.length("full_text") > 2 * F.col("limit_max")).select("extraction_id", "full_text", "limit_max")

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, limit in batch.itertuples(index=False):
                cut = split_text(text, int(limit), overlap)
                rows += [(key, k, len(cut), a, b, b - a, s, piece) for k, (a, b, s, piece) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=["extraction_id", "piece_no", "n_pieces", "start_word", "end_word", "n_words", "boundary", "piece"])

    return due.mapInPandas(pieces, SCHEMA).dropDuplicates(["extraction_id", "piece_no"])


def found(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """The pages that had to be split."""
    return split_oversized(pages, specs).where("piece_no = 0").select("extraction_id")
