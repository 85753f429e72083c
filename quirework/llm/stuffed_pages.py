"""Keyword-stuffed and link-list pages, by a hidden Markov model over lines.

Texts are cut into lines, and long lines into sentences and short pieces. Each
piece shows a few coarse features (links, tags, prices, figures, function words, phrases that the page
repeats, and how much its words belong to search phrases). A hidden Markov
model labels the pieces as prose, link list, tag list, menu or record (dockets,
exhibit lists, tables of contents); a page is flagged if more than half of its
words lie in link lists, tag lists and menus.

The model is trained on a bounded sample of documents: seeds are pieces that
their form gives away, the rest of the sample is fitted by expectation
maximisation. No labels are given.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("prose", "links", "tags", "menu", "record")
PROSE, LINKS, TAGS, MENU, RECORD = range(5)
#: States of text that is written only to be found.
STUFFED = (LINKS, TAGS, MENU)
#: About so many documents, chosen by the hash of their ids, train the model.
SAMPLE = 3000
#: Words of a piece at most.
PIECE_WORDS = 12
ROUNDS = 5
#: Places of pages that are solved together, padding included.
TOGETHER = 32_768
#: Share of words in links, tags and menus above which a page is flagged.
SHARE = 0.5

#: Function words of the corpus's languages.
FUNCTION_WORDS = frozenset(
    """a an and as at been before but by could did for from had has have he her his if in is it its me my no not of on or our
    she that the their there they this to under was were which while who with within without would
    al como con de del el en la las lo los para por que se sin sobre su sus tras un una y
    au aux avec bien ce cette dans de des du elle en est et il la le les leur mais ont par pas pour que qui sous sur un une
    als am an auf aus bei das dem den der des die durch ein eine einem einer es für im in ist kam laut mit nach nicht noch obwohl
    oder sich sie sind über um und von vor war wird wurde wurden zu zum zur""".split()
)

_SENTENCE = re.compile(r"(?<=[.!?:;])\s+")
_LETTERS = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"https?:|www\.|href=|\]\(|//", re.IGNORECASE)
_TAG = re.compile(r"^#|^(?:tags|keywords|labels|stichworte|etiquetas|mots)\b:?$", re.IGNORECASE)
_LABEL = re.compile(r"^-?\d+%$|★|^(?:SKU|NEW|SALE|PDF)$")
_FIGURE = re.compile(r"\d{3}|\d[/:.,-]\d|^\d{1,2}[,.]?$")
_BAR = re.compile(r"^[|»•›>·/\\]+$")

#: Number of values of each feature.
SIZES = (4, 3, 3, 4, 4, 6, 3, 4)


class TokenFacts(dict):
    """What a token is, kept for tokens seen before: link, tag, label, bar and figure as 1 in fields of ten bits of one number."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        link = _LINK.search(token) is not None
        facts = (link, _TAG.search(token) is not None, _LABEL.search(token) is not None, _BAR.match(token) is not None, not link and _FIGURE.search(token) is not None)
        value = self[token] = sum(int(fact) << 10 * k for k, fact in enumerate(facts))
        return value


_facts = TokenFacts()


def pieces(text: str) -> list[str]:
    """Lines, long ones cut at sentence ends and then into runs of PIECE_WORDS words."""
    found = []
    for line in text.split("\n"):
        for sentence in _SENTENCE.split(line) if len(line) > 40 else (line,):
            words = sentence.split()
            found += [" ".join(words[i : i + PIECE_WORDS]) for i in range(0, len(words), PIECE_WORDS)]
    return found


class Page:
    """A text's pieces with their words and the features that need no model."""

    def __init__(self, text: str) -> None:
        self.pieces = pieces(text)
        self.sizes = np.array([len(p.split()) for p in self.pieces], dtype=np.int64)
        self.words = [_LETTERS.findall(p.lower()) for p in self.pieces]
        pairs = Counter(pair for words in self.words for pair in zip(words, words[1:]))
        total = max(1, sum(map(len, self.words)))
        often = {pair for pair, n in pairs.items() if n >= 3 and 2 * n >= 0.04 * total}
        self.features = np.zeros((len(self.pieces), len(SIZES)), dtype=np.int64)
        for i, (piece, words) in enumerate(zip(self.pieces, self.words)):
            tokens = piece.split()
            n = len(tokens)
            counts = sum(map(_facts.__getitem__, tokens))
            links, tags, labels, bars, figures = ((counts >> 10 * k & 1023) / n for k in range(5))
            function = sum(1 for w in words if w in FUNCTION_WORDS) / max(1, len(words))
            repeated = sum(1 for pair in zip(words, words[1:]) if pair in often) / max(1, len(words) - 1) if often else 0
            self.features[i, :5] = (
                0 if links == 0 else 1 if links < 0.15 else 2 if links < 0.35 else 3,
                0 if tags == 0 else 1 if tags < 0.25 else 2,
                0 if labels == 0 else 1 if labels < 0.15 else 2,
                0 if function == 0 else 1 if function < 0.12 else 2 if function < 0.3 else 3,
                0 if repeated == 0 else 1 if repeated < 0.34 else 2 if repeated < 0.67 else 3,
            )
            self.features[i, 6] = 0 if bars == 0 else 1 if bars < 0.2 else 2
            self.features[i, 7] = 0 if figures == 0 else 1 if figures < 0.15 else 2 if figures < 0.3 else 3

    def seeds(self) -> np.ndarray:
        """State of the pieces whose form gives it away, else -1."""
        links, tags, labels, function, repeated = self.features[:, :5].T
        figures = self.features[:, 7]
        seeds = np.full(len(self.pieces), -1)
        plain = (links == 0) & (tags == 0)
        seeds[plain & (figures >= 2) & (function <= 1)] = RECORD
        seeds[plain & (function >= 2) & ((repeated <= 1) | (figures >= 1)) & (self.sizes >= 5)] = PROSE
        seeds[plain & (repeated == 3) & (function <= 1) & (figures == 0) & (self.sizes >= 3)] = TAGS
        seeds[plain & (labels >= 1) & (repeated >= 1) & (function <= 1)] = MENU
        seeds[tags >= 2] = TAGS
        seeds[links >= 2] = LINKS
        return seeds


class Model:
    """Word odds, start, transition and emission probabilities."""

    def __init__(self, odds: dict[str, float]) -> None:
        self.odds = odds
        n = len(STATES)
        self.start = np.full(n, 1 / n)
        self.step = (np.full((n, n), 0.1) + 0.5 * np.eye(n)) / (0.1 * n + 0.5)
        self.emit = [np.full((n, size), 1 / size) for size in SIZES]

    def observe(self, page: Page) -> np.ndarray:
        """The page's features with the one that the word odds give."""
        features = page.features
        for i, words in enumerate(page.words):
            known = [self.odds[w] for w in words if w in self.odds]
            mean = sum(known) / len(known) if known else 0.0
            features[i, 5] = 0 if not known else 1 if mean < -1 else 2 if mean < -0.2 else 3 if mean < 0.5 else 4 if mean < 1.5 else 5
        return features

    def likelihood(self, features: np.ndarray) -> np.ndarray:
        logs = sum(np.log(table[:, features[:, k]]).T for k, table in enumerate(self.emit))
        return np.exp(logs - logs.max(axis=1, keepdims=True))

    def posteriors(self, observed: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """State probabilities of the pieces of each page, and expected steps over all, by forward and backward passes.

        Pages of similar length are solved together; places after a page's end
        say nothing, so that they change no result.
        """
        results: list[np.ndarray] = [np.zeros((0, len(STATES)))] * len(observed)
        steps = np.zeros((len(STATES), len(STATES)))
        order = [i for i in np.argsort([len(f) for f in observed], kind="stable") if len(observed[i])]
        start = 0
        for stop in range(1, len(order) + 1):
            if stop < len(order) and (stop + 1 - start) * len(observed[order[stop]]) <= TOGETHER:
                continue
            group, start = order[start:stop], stop
            longest = len(observed[group[-1]])
            like = np.ones((len(group), longest, len(STATES)))
            filled = np.zeros((len(group), longest), dtype=bool)
            for k, i in enumerate(group):
                like[k, : len(observed[i])] = self.likelihood(observed[i])
                filled[k, : len(observed[i])] = True
            ahead, back = np.empty_like(like), np.ones_like(like)
            ahead[:, 0] = self.start * like[:, 0]
            ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, longest):
                ahead[:, t] = (ahead[:, t - 1] @ self.step) * like[:, t]
                ahead[:, t] /= ahead[:, t].sum(axis=1, keepdims=True)
            for t in range(longest - 2, -1, -1):
                after = like[:, t + 1] * back[:, t + 1]
                both = ahead[:, t, :, None] * self.step * after[:, None, :]
                steps += (both / both.sum(axis=(1, 2), keepdims=True))[filled[:, t + 1]].sum(axis=0)
                back[:, t] = after @ self.step.T
                back[:, t] /= back[:, t].sum(axis=1, keepdims=True)
            states = ahead * back
            states /= states.sum(axis=2, keepdims=True)
            for k, i in enumerate(group):
                results[i] = states[k, : len(observed[i])]
        return results, steps

    def fit(self, observed: list[np.ndarray], weights: list[np.ndarray]) -> None:
        """Emissions (and, from the second call on, steps) of the weighted states."""
        for k, size in enumerate(SIZES):
            counts = np.full((len(STATES), size), 0.5)
            for features, states in zip(observed, weights):
                for state in range(len(STATES)):
                    counts[state] += np.bincount(features[:, k], weights=states[:, state], minlength=size)
            self.emit[k] = counts / counts.sum(axis=1, keepdims=True)

    def shares(self, pages: list[Page]) -> list[tuple[float, list[int]]]:
        """Share of words in links, tags and menus, and the state of each piece, of every page."""
        result = []
        for page, states in zip(pages, self.posteriors([self.observe(page) for page in pages])[0]):
            best = states.argmax(axis=1) if len(states) else np.zeros(0, dtype=np.int64)
            result.append((float(page.sizes[np.isin(best, STUFFED)].sum() / max(1, page.sizes.sum())), best.tolist()))
        return result


def word_odds(pages: list[Page], states: list[np.ndarray]) -> dict[str, float]:
    """Log odds of each frequent word between stuffed and other pieces, each page counting a word once for either."""
    sides = (Counter(), Counter())
    for page, own in zip(pages, states):
        seen = (set(), set())
        for words, state in zip(page.words, own):
            if state >= 0:
                seen[int(state in STUFFED)].update(words)
        for side, words in zip(sides, seen):
            side.update(words)
    sums = [sum(side.values()) or 1 for side in sides]
    return {w: max(-4.0, min(4.0, math.log((sides[1][w] + 0.5) / sums[1]) - math.log((sides[0][w] + 0.5) / sums[0]))) for w in sides[0] | sides[1] if sides[0][w] + sides[1][w] >= 5}


def train(texts: list[str]) -> Model:
    """Seeds give the first word odds and emissions; expectation maximisation fits the rest."""
    pages = [page for page in map(Page, texts) if len(page.pieces)]
    seeds = [page.seeds() for page in pages]
    model = Model(word_odds(pages, seeds))
    if not pages:
        return model
    observed = [model.observe(page) for page in pages]
    weights = [np.where(own[:, None] < 0, 0.0, np.eye(len(STATES))[own]) for own in seeds]
    model.fit(observed, weights)
    for _ in range(ROUNDS):
        results, steps = model.posteriors(observed)
        # seeds keep their side (stuffed or not), all else is free
        weights = []
        for own, states in zip(seeds, results):
            allowed = np.ones((len(own), len(STATES)))
            stuffed = np.isin(np.arange(len(STATES)), STUFFED)
            allowed[np.isin(own, (PROSE, RECORD))] = np.where(stuffed, 1e-3, 1.0)
            allowed[np.isin(own, STUFFED)] = np.where(stuffed, 1.0, 1e-3)
            kept = states * allowed + 1e-12
            weights.append(kept / kept.sum(axis=1, keepdims=True))
        model.start = np.mean([w[0] for w in weights], axis=0) + 0.01
        model.start /= model.start.sum()
        steps = steps + 1.0
        model.step = steps / steps.sum(axis=1, keepdims=True)
        model.odds = word_odds(pages, [np.where(w.max(axis=1) > 0.9, w.argmax(axis=1), -1) for w in weights])
        observed = [model.observe(page).copy() for page in pages]
        model.fit(observed, weights)
    return model


def trained_model(documents: DataFrame) -> Model:
    """The model of a sample of about SAMPLE documents, chosen by the hash of their ids and sorted by id."""
    texts = documents.select("doc_id", "text").where("text is not null")
    share = min(1.0, SAMPLE / max(texts.count(), 1))
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))
    return train([row.text for row in sorted(sample.collect(), key=lambda row: (row.doc_id is None, row.doc_id, row.text))])


def page_shares(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, other_share, labels: words of each document, their share in link lists, tag lists and menus, and its pieces' labels.

    Null, empty and blank texts have no words and a share of 0. Every row of
    ``documents`` gives one row; extra columns are ignored. A document without
    an id is labelled like any other.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(trained_model(documents))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for first in range(0, len(batch), 500):
                part = batch.iloc[first : first + 500]
                pages = [Page(text if isinstance(text, str) else "") for text in part["text"]]
                for doc, page, (share, states) in zip(part["doc_id"], pages, model.value.shares(pages)):
                    rows.append((doc, int(page.sizes.sum()), share, [STATES[s] for s in states]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "other_share", "labels"])

    return documents.select("doc_id", "text").mapInPandas(label, "doc_id bigint, n_words bigint, other_share double, labels array<string>")


def found(documents: DataFrame) -> DataFrame:
    """The documents of which more than half the words lie in link lists, tag lists and menus."""
    return page_shares(documents).where(F.col("other_share") > SHARE).select("doc_id").distinct()
