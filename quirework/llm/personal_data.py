"""Personal data in free text, by a skip-chain conditional random field.

Tokens near anything that could be personal data form windows. A linear chain
over each window has learned potentials; in addition all tokens of a document
that are written alike share a potential: each sends its belief to the group
and gets back what the others believe, and the chain is solved again. These
rounds of loopy message passing carry the label of a name in a clear context
("Signed by ...") to its other places in the document. Groups exchange sums, so
even a group that holds a third of all tokens is only aggregated.

The chain is trained on a bounded sample of windows that exact patterns label
(there are no labels in the data); in a quarter of them the features of formats
are left out, so that an item can also be told by what stands around it. How
often a word stands as a name in clear contexts is counted over all texts. The
counts travel as a table of fixed size that is addressed by the word's hash: two
words in one cell can only make a window more. A second pass does the same with
the (document, word) pairs that the first windows took for names, so that every
other place of such a word in its document has a window too.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.words import mix
from quirework.plans.storage import materialize

LABELS = ("other", "email", "phone", "id_number", "address", "name")
OTHER, EMAIL, PHONE, ID, ADDRESS, NAME = range(6)
#: About so many texts of each source, chosen by the hash of their ids, are searched for training windows, and so many windows of at most PART_TOKENS tokens are used.
SAMPLE_TEXTS, SAMPLE_WINDOWS, PART_TOKENS = {"ocr_spans": 20_000, "draft_sections": 2_500}, 4_000, 80
#: A word can be part of a name if at least one in so many of its places with a capital is in a clear context.
PLACES = 50
#: Of so many training windows, one has no features of formats.
WITHOUT_FORMATS = 4
#: Passes over the windows in training and windows per gradient step; rounds of messages between equal tokens.
PASSES, BATCH, ROUNDS = 8, 64, 2
#: Weight of what the other tokens of a group believe, and its limit.
SHARED, MOST = 1.0, 4.0
#: Log probability of being no part of an item above which a token takes no part in the messages.
SURE = -1e-3
#: Log probability of being no part of an item up to which a name token makes windows at its other places in the document.
MAYBE = -0.1
#: Places of windows that are solved together, padding included.
PADDED = 16_384
#: Tokens around a trigger that belong to its window.
AROUND = 9
#: Characters around a token that is flagged for a format in which the format is looked for.
NEAR = 120
#: Tables by hash have two to this power cells of one byte, and take in so many (document, word) pairs at a time.
CELLS, PAIRS = 24, 1 << 20
#: Different tokens that are kept at most, in tables of tokens seen before.
KEPT = 300_000
#: Windows that are scored together at least, if there are so many.
SCORED = 2_000
#: A pair sets the cells that begin at these bits of its hash; a word is looked at only if all are set.
PROBES = (40, 20, 0)

#: Street types, labels, titles and company endings of the corpus.
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Row|Terrace|Ter|Blvd|Boulevard|Drive|Dr|Way|Place|Pl|Close|Square|Sq"
SHORT_STREETS = frozenset("st rd ave ln ct ter blvd dr pl sq".split())
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Judge|Justice|Officer|Attorney|Nurse|Sgt|Detective|Hon"
COMPANY = frozenset("llc llp inc ltd co corporation group holdings company county court corp gmbh plc".split())

_TOKEN = re.compile(r"[^\W_]+(?:[-.'’@+_/]+[^\W_]+)*|\S")
_PARTICLE = r"(?:von|van|de|la|der|du|di|del|al)"
_PARTICLES = frozenset("von van de la der du di del al".split())
_WORD = r"(?:(?:al-|el-)?[^\W\d_a-zß-ÿ][^\W\d_]+(?:[-'’][^\W\d_a-zß-ÿ][^\W\d_]+)*)"
_GIVEN = rf"(?:{_WORD}|[A-Z]\.)"
_PERSON = rf"(?:{_GIVEN}(?: (?:{_GIVEN}|{_PARTICLE}))* ?{_WORD}|{_WORD}, {_GIVEN}(?: {_GIVEN})*)"
_EMAIL = r"[\w.+-]+\s?(?:@|\[at\]|\(at\))\s?[\w-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[\w-]+)+"
_PHONE = r"(?<![\w+-])(?:\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|0\d{2,4} \d{3,4} \d{4}|\d{3}([-. ])\d{3}\1\d{4})(?![\w-])"
_STREET = (
    rf"(?:(?:Flat|Apt\.?|Unit|Suite) [#\w]+, )?(?<![\w.$-])\d{{1,5}}[A-Z]?(?:[-–]\d{{1,5}})? (?:[NSEW]\.? )?(?:(?!County|COUNTY){_WORD} ){{1,2}}(?:(?i:{STREETS}))\b\.?(?:,? (?:(?i:Suite|Unit|Apt\.?|Ste\.?|Flat) ?#?\w+|#\s?\w+))?"
    rf"|\b\d{{1,4}},? (?:rue|avenue|calle|via) (?:(?:des|de|du|la|le|les|del) )*{_WORD}|\b{_WORD}(?:weg|straße|strasse|gasse|platz|allee) \d{{1,4}}[a-z]?\b"
)
_LAYOUT = r"(?:[A-Z]{2} ?(?:\d\d ?){3}[A-Z]|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{1,2}\d{8,9}|\d{3}[- ]?\d{2}[- ]?\d{4})"
_SERIAL = rf"(?:{_LAYOUT}|[A-Z]{{1,2}}\d{{6,7}})"
_KIND = r"(?i:SSN|social security(?: no\.?| number)?|tax id|NINO|national insurance(?: number| no\.?)?|passport(?: no\.?)?|driver['’]?s? licen[cs]e(?: no\.?)?|licen[cs]e)"

#: Patterns that label the training windows: label, pattern, group of the item.
PATTERNS = [
    (EMAIL, re.compile(_EMAIL, re.IGNORECASE), 0),
    (PHONE, re.compile(_PHONE), 0),
    (PHONE, re.compile(r"(?i:\bfax|\bcall|phone:?|telephone at|;) (\d{10})(?!\d)"), 1),
    (ID, re.compile(rf"{_KIND}:? ({_SERIAL})(?![\w-])"), 1),
    (ID, re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{2} ?(?:\d\d ?){3}[A-Z])(?![\w-])"), 1),
    # a line that goes on after a number of national layout; a letter with fewer figures can be any reference
    (ID, re.compile(rf"^({_LAYOUT})(?=,? [a-z])"), 1),
    (ADDRESS, re.compile(_STREET), 0),
    (NAME, re.compile(rf"(?:(?:[Ss]igned|[Pp]repared|[Ww]itnessed) by|[Ff]ile of|[Rr]ecords? of|[Cc]ontact|[Aa]ttention|of record:|Bill to:|[Cc]laimant:|[Dd]eponent,|Witness) ({_PERSON})"), 1),
    (NAME, re.compile(rf"\b(?:{TITLES})\.? ({_WORD})(?! (?:of|Court))"), 1),
    (NAME, re.compile(rf"({_PERSON})(?: (?:testified|(?:may|can) be reached|and diagnosed|shows? {_KIND})|,? (?:resides at|holder of)\b)"), 1),
    (NAME, re.compile(rf"({_PERSON})(?: at| \(|,) ?(?:{_EMAIL})"), 1),
    (NAME, re.compile(rf"^({_PERSON}), (?:{_STREET})"), 1),
    (NAME, re.compile(rf"^({_PERSON}) for (?:{_WORD} ){{1,4}}(?:LL[CP]|Inc|Ltd|Co|Group|Corporation)\b"), 1),
    (NAME, re.compile(rf"(?:examined|treated) ({_PERSON}) (?:and|on)\b"), 1),
]
#: Patterns that begin with a person, and words of which a text must hold one for them.
_NEEDED = {
    pattern: words
    for _, pattern, _ in PATTERNS
    for end, words in {
        r"holder of)\b)": ("testified", " be reached", "and diagnosed", " show", "resides at", "holder of"),
        rf"(?:{_EMAIL})": ("@", "[at]", "(at)"),
    }.items()
    if pattern.pattern.startswith(f"({_PERSON})") and pattern.pattern.endswith(end)
}
_CAPITAL = r"[^\W\d_a-zß-ÿ]"
_CONTEXT = re.compile(rf"(?:[Ss]igned by|repared by|itnessed by|[Ff]ile of|[Rr]ecords? of|ontact|[Aa]ttention|examined|treated) (?={_CAPITAL})|of record:|Bill to:|[Cc]laimant:|eponent,|Witness |{_CAPITAL}[\w'’-]* (?:testified|(?:may|can) be reached|and diagnosed)|\b(?:{TITLES})\b")

#: Flags of a text's tokens: without the ones that a format needs it is not looked for.
IS_NAME, IS_EMAIL, IS_NUMBER, IS_STREET, IS_CONTEXT, IS_DIGITS, IS_HOUSE, IS_ROAD, IS_NUMBERED = 1, 2, 4, 8, 16, 32, 64, 128, 256
#: Formats that an item of each label can have, whatever stands around it.
FORMATS = [
    (EMAIL, IS_EMAIL, re.compile(_EMAIL, re.IGNORECASE)),
    (PHONE, IS_NUMBER, re.compile(rf"{_PHONE}|(?<![\w.,-])\d{{10}}(?![\w.,-]*\d)")),
    (ADDRESS, IS_STREET, re.compile(_STREET)),
    (ID, IS_NUMBER, re.compile(rf"(?<![\w-]){_SERIAL}(?![\w-])")),
]


_MISREAD = str.maketrans("0159@i", "olsgal")


@functools.lru_cache(maxsize=1 << 17)
def alike(token: str) -> str:
    """Key of tokens that are written alike: letters without case and accents, misread figures as letters."""
    plain = token.casefold().translate(_MISREAD)
    if not plain.isascii():
        plain = unicodedata.normalize("NFKD", plain)
    return plain if plain.isalnum() else "".join(filter(str.isalnum, plain))


def pattern_items(text: str, patterns=None) -> list[tuple[int, int, int]]:
    """(label, start, end) of the items that the patterns find; the first of overlapping ones."""
    taken = np.zeros(len(text) + 1, dtype=bool)
    items = []
    for label, pattern, group in PATTERNS if patterns is None else patterns:
        if pattern in _NEEDED and not any(word in text for word in _NEEDED[pattern]):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(group)
            last = text[start:end].rsplit(None, 1)[-1].lower().strip(".,") if end > start else ""
            if label == NAME and (last in COMPANY or re.match(r" (?:[A-Z]\w+ )*(?:LL[CP]|Inc|Ltd|Co|Group|Corporation|County|Court)\b", text[end:])):
                continue
            if not taken[start:end].any():
                taken[start:end] = True
                items.append((label, start, end))
    return items


def name_words(texts: DataFrame) -> DataFrame:
    """cell, n: how often the words of each cell stand in a name in a clear context, over all texts.

    Words that mostly stand elsewhere are left out.
    """

    names = [p for p in PATTERNS if p[0] == NAME]

    def rows(counts: Counter, tokens: Counter) -> pd.DataFrame:
        seen = Counter()
        for token, n in tokens.items():
            if (plain := token.strip(".,;:()'\"?!"))[:1].isupper() and (key := alike(plain.partition("-")[0])):
                seen[key] += n
        return pd.DataFrame([(_code(word) >> 64 - CELLS, counts[word], seen[word]) for word in seen.keys() | counts.keys()], columns=["cell", "n", "seen"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, tokens = Counter(), Counter()
        for batch in batches:
            lines = [text.split() for text in batch["text"]]
            tokens.update(itertools.chain.from_iterable(lines))
            for text, words in zip(batch["text"], lines):
                if not _CONTEXT_WORDS.isdisjoint(words) and _CONTEXT.search(text):
                    for _, start, end in pattern_items(text, names):
                        counts.update(alike(w) for w in re.findall(r"[^\W\d_]{2,}", text[start:end]) if w.lower() not in _PARTICLES)
            if len(tokens) > KEPT:
                yield rows(counts, tokens)
                counts, tokens = Counter(), Counter()
        yield rows(counts, tokens)

    counted = texts.select("text").mapInPandas(count, "cell int, n bigint, seen bigint").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    return counted.where((F.col("n") > 0) & (F.col("n") * PLACES >= F.col("seen"))).select("cell", "n")


@functools.lru_cache(maxsize=1 << 17)
def _code(key: str) -> int:
    """64-bit hash of a key, from which its cell is taken."""
    return xxhash.xxh3_64_intdigest(key)


def cell_table(cells: DataFrame) -> np.ndarray:
    """One byte for each cell, from rows of cell and n; larger counts are 255. The table has a fixed size and comes in compressed parts."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << CELLS, dtype=np.uint8)
        for batch in batches:
            table[batch["cell"].to_numpy()] = np.minimum(batch["n"].to_numpy(), 255)
        if table.any():
            yield pd.DataFrame({"part": [zlib.compress(table.tobytes(), 1)]})

    whole = np.zeros(1 << CELLS, dtype=np.uint8)
    for row in cells.repartition(4, "cell").mapInPandas(pack, "part binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(row.part), dtype=np.uint8)
    return whole


class Table:
    """One byte for each cell. It travels compressed, as most cells are empty."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts

    def __getstate__(self) -> bytes:
        return zlib.compress(self.counts.tobytes(), 1)

    def __setstate__(self, packed: bytes) -> None:
        self.counts = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)


class Lexicon(Table):
    """How often words stand as names, by the cell of their key."""

    def count(self, key: str) -> int:
        return int(self.counts[_code(key) >> 64 - CELLS]) if key else 0

    @functools.cached_property
    def flags(self) -> Flags:
        """What tokens can be part of, kept for all tasks of a worker; it does not travel."""
        return Flags(self)

    @functools.cached_property
    def codes(self) -> TokenCodes:
        """Codes of tokens that can be named again, kept and not sent in the same way."""
        return TokenCodes(self.flags)

    @functools.cached_property
    def shared_keys(self) -> SharedKeys:
        """Keys of the groups of tokens, kept and not sent in the same way."""
        return SharedKeys(self)


class Tokens:
    """Tokens of one window with their places in the text and the facts that features are made of."""

    __slots__ = ("spans", "facts", "forms", "runs")

    def __init__(self, tokens: list[str], spans: list[tuple[int, int]], flags: Flags, formats: list[tuple[int, int, int]]) -> None:
        self.spans = spans
        self.facts = list(map(flags.words.__getitem__, tokens))
        self.forms = [0] * len(spans)
        for label, start, end in formats:
            if end > spans[0][0] and start < spans[-1][1]:
                first = True
                for i, (a, b) in enumerate(spans):
                    if a >= start and b <= end:
                        self.forms[i] = 2 * label + first
                        first = False
        self.runs = _runs(self.facts)


#: Features are hashed into so many weights.
HASHED = 1 << 18
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(template: int, *codes: np.ndarray) -> np.ndarray:
    """Index of the feature that a template makes of some codes."""
    value = np.full(len(codes[0]), template * 0x632BE59BD9B4E019 & (1 << 64) - 1, dtype=np.uint64)
    for code in codes:
        value = (value ^ code) * _SALT
        value ^= value >> np.uint64(29)
    return ((value * _SALT) >> np.uint64(46)).astype(np.int64)


def feature_ids(found: list[Tokens]) -> np.ndarray:
    """A row of feature indices for every token of all windows; blanks stand between windows."""
    blanks, gap, outside = [(0,) * 6] * 5, [0] * 5, [False] * 5
    facts, forms, runs, inside = blanks[:], gap[:], gap[:], outside[:]
    for window in found:
        facts += [f[:6] for f in window.facts] + blanks
        forms += window.forms + gap
        runs += window.runs + gap
        inside += [True] * len(window.spans) + outside
    own, low, shape, known, end, company = np.array(facts, dtype=np.uint64).T
    form, run = np.array(forms, dtype=np.uint64), np.array(runs, dtype=np.uint64)
    near = np.zeros(len(company), dtype=np.uint64)
    for k in range(-1, 5):  # a company's ending just before or soon after
        near |= np.roll(company, -k)
    at = np.flatnonzero(inside)
    o, e, s, k, c, f, r = (x[at] for x in (own, end, shape, known, near, form, run))
    pa, pb, na, nb = low[at - 1], low[at - 2], low[at + 1], low[at + 2]
    templates = (
        (o,), (s, k, c), (pa,), (na,), (pb, pa), (na, nb), (shape[at - 1], s, shape[at + 1]), (known[at - 1], k, known[at + 1]), (f, c), (f, pa), (form[at - 1], f, form[at + 1]), (f, pb, pa),
        (r, s), (r, run[at - 1], pa), (r, run[at + 1], na), (e,), (k, na, nb), (k, pb, pa),
    )
    return np.stack([_mixed(i + 1, *codes) for i, codes in enumerate(templates)], axis=1)


_STREET_WORDS = frozenset(STREETS.lower().split("|")) | {"rue", "calle", "via"}
_CONTEXT_WORDS = frozenset("Signed signed Prepared prepared Witnessed witnessed File file Record record Records records contact Contact attention Attention record: Bill Claimant: claimant: deponent, Deponent, Witness testified reached diagnosed examined treated resides holder".split()) | frozenset(t + end for t in TITLES.split("|") for end in ("", "."))
#: Words after which a number is none of a person.
_NUMBERED = frozenset("instrument claim parcel case".split())
_HOUSE = re.compile(r"\d{1,5}[A-Z]?(?:[-–]\d{1,5})?$")
_NUMBER_LIKE = re.compile(r"^(?!\d\d-\d\d-)(?:.*(?:\+\d|^\(?\d{3}\)|\d{3}[-. ]\d{3}|\d{9}|[A-Z]\d{3}-\d{4}|[A-Z]\d{6}|\d{3}-\d\d-)|[A-Z]{2}$)")


def _split(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Tokens between blanks of many texts: how many each text has (at least one, which may be empty), the different ones, and which of them stands at each place."""
    lines = pc.utf8_split_whitespace(texts)
    tokens = lines.flatten().dictionary_encode()
    return pc.list_value_length(lines).to_numpy().astype(np.int64), tokens.dictionary.to_numpy(zero_copy_only=False).tolist(), tokens.indices.to_numpy()


#: Figures, all of them as one.
_NINES = str.maketrans("0123456789", "9999999999")


class Flags(dict):
    """What a token between blanks can be part of; kept for tokens seen before."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.shapes: dict[str, int] = {}
        self.words = Words(lexicon)
        self.named = functools.lru_cache(maxsize=1 << 17)(lambda token: token[0].isupper() and lexicon.count(alike(token.partition("-")[0])) > 0)

    def __missing__(self, token: str) -> int:
        if len(self) > KEPT:
            self.clear()
        plain = token.strip(".,;:()'\"?!")
        if plain[:1].isupper():
            flags = self._formed(token, plain) | (IS_NAME if self.named(plain) else 0)
        else:  # which figures it has matters for names only
            shape = token.translate(_NINES)
            flags = self.shapes.get(shape)
            if flags is None:
                if len(self.shapes) > KEPT:
                    self.shapes.clear()
                flags = self.shapes[shape] = self._formed(token, plain)
        self[token] = flags
        return flags

    @staticmethod
    def _formed(token: str, plain: str) -> int:
        """Flags that do not depend on the lexicon."""
        low = plain.lower()
        flags = IS_NAME if low.startswith(("al-", "el-")) else 0
        if "@" in token or low == "at" and token[0] in "[(" or "[at]" in token.lower() or "(at)" in token.lower():
            flags |= IS_EMAIL
        if plain.isdigit() and 2 <= len(plain) <= 4:
            flags |= IS_DIGITS
        elif _NUMBER_LIKE.match(token):
            flags |= IS_NUMBER
        if low in ("rue", "calle", "via", "avenue") or low.endswith(("weg", "straße", "strasse", "gasse", "platz", "allee")):
            flags |= IS_STREET
        if low in _STREET_WORDS:
            flags |= IS_ROAD
        if _HOUSE.match(plain):
            flags |= IS_HOUSE
        if low in _NUMBERED:
            flags |= IS_NUMBERED
        if token in _CONTEXT_WORDS:
            flags |= IS_CONTEXT
        return flags

    def of(self, text: str) -> int:
        """All flags of a text's tokens."""
        return int(self.of_all(pa.array([text], pa.string()))[0])

    def of_all(self, texts: pa.Array) -> np.ndarray:
        """All flags of each text's tokens.

        Short numbers count as a number two in a row, a number after a word
        like "instrument" does not, and a road needs a house number before it.
        """
        if not len(texts):
            return np.zeros(0, dtype=np.int64)
        sizes, tokens, places = _split(texts)
        own = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))[places]
        begins = np.cumsum(sizes) - sizes
        last = np.concatenate([[0], own[:-1]])
        last[begins] = 0
        own[(own & IS_NUMBER > 0) & (last & IS_NUMBERED > 0)] &= ~IS_NUMBER
        own[own & last & IS_DIGITS > 0] |= IS_NUMBER
        roads = np.flatnonzero(own & IS_ROAD)
        if len(roads):
            houses = np.flatnonzero(own & IS_HOUSE)
            house = np.concatenate([[-9], houses])[np.searchsorted(houses, roads)]
            begin = begins[np.searchsorted(begins, roads, side="right") - 1]
            own[roads[(house >= begin) & (roads - house <= 5)]] |= IS_STREET
        return np.bitwise_or.reduceat(own, begins)


class Words(dict):
    """Codes of a window's token (itself, lower case, shape, how well known as a name, ending, company) and what it is in a run; kept for tokens seen before."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[int, int, int, int, int, int, str, bool, bool]:
        if len(self) > KEPT:
            self.clear()
        low, shape = token.lower(), _shape(token)
        count = _bin(min(self.lexicon.count(alike(part)) for part in token.replace("’", "-").split("-"))) if token[0].isalpha() else "-"
        letters = shape[0] in "Aa"
        code = xxhash.xxh3_64_intdigest
        capital = (token[0].isupper() or low.startswith(("al-", "el-"))) and (token.isalpha() or not any(c.isdigit() or c == "@" for c in token))
        facts = self[token] = (
            code(low) if letters else 1, code(low), code(shape), ord(count), code(low[-3:]) if letters else 1, int(low in COMPANY), token, capital, low in _PARTICLES,
        )
        return facts


def _runs(facts: list[tuple]) -> list[int]:
    """For each token of a run of capitalised words, initials, particles and commas between them: how well known its best word is."""
    n, i = len(facts), 0
    runs = [0] * n
    while i < n:
        j = i
        while j < n:
            _, _, _, known, _, _, token, capital, particle = facts[j]
            if not capital:
                if not 0 < j < n - 1:
                    break
                if token == ",":
                    if facts[j - 1][3] == 48 or not facts[j + 1][6][0].isupper():
                        break
                elif token == ".":
                    if len(facts[j - 1][6]) != 1 or not facts[j - 1][6].isupper():
                        break
                elif not particle:
                    break
            j += 1
        if j > i:
            best = max((f[3] for f in facts[i:j] if f[3] != 45), default=48) - 48
            firm = any(f[5] for f in facts[i : j + 1])
            runs[i:j] = [1 + best * 16 + firm * 8 + min(j - i, 4)] * (j - i)
        i = max(j, i + 1)
    return runs


def _bin(count: int) -> str:
    return "0" if count == 0 else "1" if count < 3 else "2" if count < 8 else "3"


def _shape(word: str) -> str:
    if word.isalpha() or word[0].isalpha() and not any(c.isdigit() or c == "@" for c in word):
        return "AA" if len(word) > 1 and word.isupper() else "A" if word.isupper() else "Aa" if word[0].isupper() else "a"
    if "@" in word:
        return "@"
    if any(c.isdigit() for c in word):
        digits = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d", "9", word))
        return digits if len(digits) < 14 else "9long"
    return word


_SOLID = re.compile(r"\S+")


def format_items(text: str, flags: Flags, held: int) -> list[tuple[int, int, int]]:
    """(label, start, end) of what has the format of an item, looked for around the tokens that are flagged for it."""
    found = []
    wanted = [entry for entry in FORMATS if held & entry[1]]
    if not wanted:
        return found
    if len(text) <= 2 * NEAR:
        found = [(label, *m.span()) for label, _, pattern in wanted for m in pattern.finditer(text)]
        return [item for item in found if item[0] in (EMAIL, ADDRESS) or not flags[text[: item[1]].rpartition(" ")[0].rpartition(" ")[2]] & IS_NUMBERED]
    spans = [m.span() for m in _SOLID.finditer(text)]
    marks = list(map(flags.__getitem__, text.split()))
    flagged = [k for k, mark in enumerate(marks) if mark]
    for label, need, pattern in wanted:
        places = [k for k in flagged if marks[k] & need]
        if need == IS_STREET:
            places += [k for k in flagged if marks[k] & IS_ROAD and any(mark & IS_HOUSE for mark in marks[max(0, k - 6) : k])]
        elif need == IS_NUMBER:
            places += [k for k in flagged if k and marks[k - 1] & marks[k] & IS_DIGITS]
        low, high = 0, 0
        for start, end in [*(spans[k] for k in sorted(places)), (len(text) + 2 * NEAR + 1, 0)]:
            if start - NEAR > high:
                found += [(label, *m.span()) for m in pattern.finditer(text, low, high)] if high else []
                low = max(text.rfind(" ", 0, max(0, start - NEAR)) + 1, 0)
            high = text.find(" ", end + NEAR) if end + NEAR < len(text) else len(text)
            high = len(text) if high < 0 else high
    numbered = {spans[k][1] + 1 for k in flagged if marks[k] & IS_NUMBERED}
    return [item for item in found if item[0] in (EMAIL, ADDRESS) or item[1] not in numbered]


#: Flags without which a text has no windows of its own.
OPENING = IS_NAME | IS_EMAIL | IS_NUMBER | IS_STREET | IS_CONTEXT


def windows(text: str, flags: Flags, wanted: frozenset[str] = frozenset(), held: int | None = None) -> list[Tokens]:
    """Windows of tokens around the places where personal data can be; with ``wanted`` those around these keys that are in no other window. ``held`` are the text's flags, if they are known."""
    held = flags.of(text) if held is None else held
    if not (wanted or held & OPENING):
        return []
    formats = format_items(text, flags, held)
    contexts = [m.span() for m in _CONTEXT.finditer(text)] if held & IS_CONTEXT else []
    if not (formats or contexts or wanted or held & IS_NAME):
        return []
    tokens = _TOKEN.findall(text)
    known = list(map(flags.named, tokens))
    if not (formats or contexts or wanted or True in known):
        return []
    hot = np.array(known, dtype=bool)
    starts, at = [], 0
    for token in tokens:  # nothing but blanks stands between tokens
        at = text.find(token, at)
        starts.append(at)
        at += len(token)
    for start, end in contexts + [(a, b) for _, a, b in formats]:
        hot[max(0, bisect.bisect_left(starts, start) - 1) : bisect.bisect_left(starts, end) + 1] = True
    if not (wanted or hot.any()):
        return []
    wide = _widened(hot)
    if wanted:
        wide = _widened(np.array([alike(token) in wanted for token in tokens], dtype=bool)) & ~wide
    found, marks = [], wide.tobytes() + b"\0"
    i = marks.find(1)
    while i >= 0:
        j = marks.find(0, i)
        found.append(Tokens(tokens[i:j], [(a, a + len(token)) for a, token in zip(starts[i:j], tokens[i:j])], flags, formats))
        i = marks.find(1, j)
    return found


def _widened(hot: np.ndarray) -> np.ndarray:
    """Places within AROUND of a hot one."""
    wide = np.zeros(len(hot), dtype=bool)
    for i in np.flatnonzero(hot).tolist():
        wide[max(0, i - AROUND) : i + AROUND + 1] = True
    return wide


def _padded(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of windows of different lengths in one array, and which places are filled."""
    longest = max(map(len, scores))
    array, filled = np.zeros((len(scores), longest, len(LABELS))), np.zeros((len(scores), longest), dtype=bool)
    for i, own in enumerate(scores):
        array[i, : len(own)], filled[i, : len(own)] = own, True
    return array, filled


def _lse(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def _raised(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scores' highest for each place, and what they are above it, no more as logarithms."""
    top = scores.max(axis=-1, keepdims=True)
    return top, np.exp(scores - top)


def _stepped(scores: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Scores of the next labels, summed over those before them. One exponential for each label, not for each pair; a chain's sums do not depend on the others."""
    top, values = _raised(scores)
    return top + np.log(np.einsum("ni,ij->nj", values, powers))


def _marginals(unary: np.ndarray, filled: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginals of every place of many chains at once, and the messages ahead and back."""
    length, powers = unary.shape[1], np.exp(steps)
    turned = np.ascontiguousarray(powers.T)
    ahead, back = unary.copy(), np.zeros_like(unary)
    for t in range(1, length):
        ahead[:, t] = unary[:, t] + _stepped(ahead[:, t - 1], powers)
    for t in range(length - 2, -1, -1):
        back[:, t] = np.where(filled[:, t + 1, None], _stepped(unary[:, t + 1] + back[:, t + 1], turned), 0.0)
    logs = ahead + back
    logs -= _lse(logs, 2)[:, :, None]
    return logs, ahead, back


def beliefs(unary: np.ndarray, filled: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log marginals of every place of many chains at once, and the expected steps summed over all."""
    logs, ahead, back = _marginals(unary, filled, steps)
    powers, inner = np.exp(steps), filled[:, 1:]
    _, here = _raised(ahead[:, :-1][inner])
    _, later = _raised((unary + back)[:, 1:][inner])
    whole = (np.einsum("ni,ij->nj", here, powers) * later).sum(axis=1)
    return logs, powers * np.einsum("ni,nj->ij", here / whole[:, None], later)


class Model:
    """Weights of the hashed features and of the steps between labels."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.weights = np.zeros((HASHED, len(LABELS)), dtype=np.float32)
        self.steps = np.zeros((len(LABELS), len(LABELS)))

    def __getstate__(self) -> tuple:
        return self.lexicon, self.steps, zlib.compress(self.weights.tobytes(), 1)

    def __setstate__(self, state: tuple) -> None:
        self.lexicon, self.steps = state[:2]
        self.weights = np.frombuffer(zlib.decompress(state[2]), dtype=np.float32).reshape(HASHED, len(LABELS))

    def unary(self, found: list[Tokens]) -> list[np.ndarray]:
        """Scores of the labels for the tokens of each window."""
        if not found:
            return []
        ids = feature_ids(found)
        scores = np.zeros((len(ids), len(LABELS)), dtype=np.float32)
        for column in ids.T:
            scores += self.weights[column]
        return np.split(scores, np.cumsum([len(window.spans) for window in found])[:-1])

    def train(self, chosen: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Maximum likelihood over (features, labels) of windows by adaptive gradient steps over small batches, with a small penalty."""
        if not chosen:
            return
        truth = [labels for _, labels in chosen]
        ids = np.concatenate([features for features, _ in chosen])
        ids[np.bincount(ids.ravel(), minlength=HASHED)[ids] < 2] = 0  # what was seen once teaches nothing
        rows = np.split(ids, np.cumsum([len(labels) for labels in truth])[:-1])
        size, k = HASHED, len(LABELS)
        self.weights = np.zeros((size, k))
        seen, seen_steps = np.full((size, k), 0.1), np.full((k, k), 0.1)
        draw, by_length = np.random.default_rng(11), np.argsort([len(labels) for labels in truth], kind="stable")
        for _ in range(PASSES):
            for batch in draw.permutation(-(-len(rows) // BATCH)):
                batch = by_length[batch * BATCH : (batch + 1) * BATCH]  # windows of one length need little padding
                flat = np.concatenate([rows[i] for i in batch])
                labels = [truth[i] for i in batch]
                gold, gold_steps = np.eye(k)[np.concatenate(labels)], np.zeros((k, k))
                for own in labels:
                    np.add.at(gold_steps, (own[:-1], own[1:]), 1)
                scores, filled = _padded(np.split(self.weights[flat].sum(axis=1), np.cumsum([len(x) for x in labels])[:-1]))
                logs, expected = beliefs(scores, filled, self.steps)
                error = gold - np.exp(logs[filled])
                used, place = np.unique(flat, return_inverse=True)
                slope = np.stack([np.bincount(place.ravel(), np.repeat(error[:, c], flat.shape[1]), len(used)) for c in range(k)], axis=1) - 1e-3 * self.weights[used]
                slope[used == 0] = 0
                seen[used] += slope**2
                self.weights[used] += 0.3 * slope / np.sqrt(seen[used])
                slope = gold_steps - expected - 1e-3 * self.steps
                seen_steps += slope**2
                self.steps += 0.3 * slope / np.sqrt(seen_steps)
        self.weights = self.weights.astype(np.float32)


def labelled_windows(text: str, flags: Flags, held: int | None = None) -> list[tuple[Tokens, np.ndarray]]:
    """Windows with the labels that the patterns give their tokens."""
    found = windows(text, flags, held=held)
    items = pattern_items(text) if found else []
    result = []
    for window in found:
        labels = np.zeros(len(window.spans), dtype=np.int64)
        for label, start, end in items:
            for i, (a, b) in enumerate(window.spans):
                if a >= start and b <= end:
                    labels[i] = label
        result.append((window, labels))
    return result


def _parts(window: Tokens, labels: np.ndarray, size: int = PART_TOKENS) -> Iterator[tuple[Tokens, np.ndarray]]:
    """A window in parts of at most ``size`` tokens, to learn from."""
    for at in range(0, len(labels), size):
        part = Tokens.__new__(Tokens)
        for name in Tokens.__slots__:
            setattr(part, name, getattr(window, name)[at : at + size])
        yield part, labels[at : at + size]


def trained_model(texts: DataFrame, names: DataFrame, totals: dict[str, int]) -> Model:
    """The lexicon over all ``names`` and the chain trained on a bounded sample of windows; ``totals`` has the rows of each source.

    The windows are made where the texts are; only the features of those that
    are chosen travel.
    """
    model = Model(Lexicon(cell_table(names)))
    shared = texts.sparkSession.sparkContext.broadcast(model.lexicon)
    turn = F.pmod(F.xxhash64("row_id"), F.lit(1 << 32))
    limits = {src: int(min(1.0, SAMPLE_TEXTS[src] / max(total, 1)) * (1 << 32)) for src, total in totals.items()}
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("src")]

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = shared.value.flags
        for batch in batches:
            keys, parts, truth = [], [], []
            for turn, text, held in zip(batch["turn"].tolist(), batch["text"], flags.of_all(pa.array(batch["text"], pa.string())).tolist()):
                for place, (part, labels) in enumerate(part for window in labelled_windows(text, flags, held) for part in _parts(*window)):
                    if (turn + place) % WITHOUT_FORMATS == 0:
                        part.forms = [0] * len(part.forms)
                    keys.append((turn, place))
                    parts.append(part)
                    truth.append(labels.astype(np.int8))
            if parts:
                ids = np.split(feature_ids(parts).astype(np.int32), np.cumsum(list(map(len, truth)))[:-1])
                yield pd.DataFrame([(*key, own.tobytes(), labels.tobytes()) for key, own, labels in zip(keys, ids, truth)], columns=["turn", "place", "features", "labels"])

    chosen = []
    for src in sorted(totals):
        own = texts.where(F.col("src") == src).withColumn("turn", turn).where(F.col("turn") < limit).select("turn", "text").distinct()
        windows_of = own.mapInPandas(labelled, "turn bigint, place int, features binary, labels binary")
        for row in windows_of.orderBy("turn", "place", "features").limit(SAMPLE_WINDOWS // len(totals)).collect():
            labels = np.frombuffer(row.labels, dtype=np.int8).astype(np.int64)
            chosen.append((np.frombuffer(row.features, dtype=np.int32).astype(np.int64).reshape(len(labels), -1), labels))
    model.train(chosen)
    return model


def _trimmed(text: str, label: int, start: int, end: int) -> tuple[int, int]:
    """The item without the punctuation around it."""
    while start < end and not (text[start].isalnum() or text[start] in "+(" and label == PHONE):
        start += 1
    while start < end and not text[end - 1].isalnum():
        tail = re.search(r"([^\W\d_]+)\.$", text[start:end])
        if tail and (label == NAME and len(tail[1]) == 1 or label == ADDRESS and tail[1].lower() in SHORT_STREETS):
            break
        end -= 1
    return start, end


def decoded(text: str, spans: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, start, end) of each run of equal labels."""
    items, i = [], 0
    while i < len(spans):
        j = i
        while j < len(spans) and labels[j] == labels[i] and (j == i or "\n" not in text[spans[j - 1][1] : spans[j][0]]):
            j += 1
        if labels[i] != OTHER:
            start, end = _trimmed(text, labels[i], spans[i][0], spans[j - 1][1])
            if labels[i] == ADDRESS and end < len(text) and text[end] == "." and text[start:end].split()[-1].lower() in SHORT_STREETS:
                end += 1
            if labels[i] == NAME and re.search(r"\b[A-Z]$", text[start:end]) and text[end : end + 1] == ".":
                end += 1
            if end > start and (labels[i] != ADDRESS or any(c.isdigit() for c in text[start:end])):  # a street without a number is none
                items.append((int(labels[i]), int(start), int(end)))
        i = j
    return items


def source_texts(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """src, row_id, doc, text of both tables; rows without a text or an id are left out."""
    a = spans.select(F.lit("ocr_spans").alias("src"), F.col("span_id").alias("row_id"), F.col("document_id").alias("doc"), "text")
    b = sections.select(F.lit("draft_sections").alias("src"), F.col("section_id").alias("row_id"), F.col("draft_id").alias("doc"), F.col("final_text").alias("text"))
    both = a.unionByName(b).where("row_id is not null and text is not null")
    return both.select("src", "row_id", F.xxhash64(F.coalesce("doc", "row_id")).alias("doc"), "text")


_STATE = "src string, row_id string, doc bigint, row bigint, start int, text string, ends array<int>, unary binary, sent array<struct<at: int, key: string, logs: array<double>>>, names array<bigint>"


def _lists(counts: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _state_rows(found: Sequence[tuple[tuple, Tokens]], model: Model) -> pa.RecordBatch:
    """Windows with their unary scores, the beliefs that their tokens send first, and the pairs of document and word that look like names."""
    rows, spans, named, docs, sent_all = [], [], [], [], []
    sizes: dict[str, list[int]] = {"ends": [], "sent": [], "names": []}
    scores = model.unary([window for _, window in found])
    order = np.argsort([len(own) for own in scores], kind="stable")
    for group in _groups([len(scores[i]) for i in order], order):
        array, filled = _padded([scores[i] for i in group])
        logs, _, _ = _marginals(array, filled, model.steps)
        for k, i in enumerate(group):
            (src, row_id, doc, text), window = found[i]
            begin, end = window.spans[0][0], window.spans[-1][1]
            sent = list(_sent(text, window.spans, logs[k, : len(window.spans)], None, model.lexicon))
            if not sent and not logs[k].argmax(axis=1).any():
                continue  # no other place could tell it anything
            likely = [key for at, key, _ in sent if logs[k, at, OTHER] <= MAYBE and logs[k, at, 1:].argmax() == NAME - 1]
            named += likely
            docs += [int(doc) & (1 << 64) - 1] * len(likely)
            sent_all += sent
            spans += [x - begin for span in window.spans for x in span]
            for name, n in (("ends", 2 * len(window.spans)), ("sent", len(sent)), ("names", len(likely))):
                sizes[name].append(n)
            rows.append((src, row_id, doc, begin, text[begin:end], scores[i].astype(np.float16).tobytes()))
    pairs = mix(np.array(list(map(_code, named)), dtype=np.uint64) ^ np.array(docs, dtype=np.uint64)).view(np.int64)
    src, row_id, doc, start, text, unary = zip(*rows) if rows else [()] * 6
    at, keys, logs = zip(*sent_all) if sent_all else [()] * 3
    beliefs_sent = _lists([len(LABELS)] * len(logs), pa.array(np.array(logs, dtype=np.float64).ravel()))
    messages = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.string()), beliefs_sent], names=["at", "key", "logs"])
    columns = {
        "src": pa.array(src, pa.string()),
        "row_id": pa.array(row_id, pa.string()),
        "doc": pa.array(doc, pa.int64()),
        "row": pa.array([0] * len(rows), pa.int64()),
        "start": pa.array(start, pa.int32()),
        "text": pa.array(text, pa.string()),
        "ends": _lists(sizes["ends"], pa.array(spans, pa.int32())),
        "unary": pa.array(unary, pa.binary()),
        "sent": _lists(sizes["sent"], messages),
        "names": _lists(sizes["names"], pa.array(pairs, pa.int64())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _with_ids(states: DataFrame) -> DataFrame:
    """Each window once, with a number."""
    return states.dropDuplicates(["src", "row_id", "start"]).withColumn("row", F.xxhash64("src", "row_id", "start"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches."""
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            yield from zip(*(column.to_pylist() for column in batch.slice(first, 1000).columns))


def _flagged(batches: Iterator[pa.RecordBatch], flags: Flags) -> Iterator[pa.RecordBatch]:
    """The rows whose texts can have windows of their own, with the flags of the text as last column."""
    for batch in batches:
        held = flags.of_all(batch.column("text"))
        own = np.flatnonzero(held & OPENING)
        yield batch.take(pa.array(own)).append_column("held", pa.array(held[own]))


def first_states(texts: DataFrame, model: Model) -> DataFrame:
    """Every window that its text gives away. Scores are half floats, ``ends`` (start, end) pairs."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value.lexicon.flags
        found = ((key, window) for *key, held in _rows(_flagged(batches, flags)) for window in windows(key[3], flags, held=held))
        for part in itertools.batched(found, SCORED):
            yield _state_rows(part, shared.value)

    return _with_ids(texts.select("src", "row_id", "doc", "text").mapInArrow(states, _STATE))


class TokenCodes(dict):
    """Code of the key of a token between blanks, kept for tokens seen before.

    Zero for those that are too short to be named again and for those that the
    lexicon gives a window wherever they stand.
    """

    def __init__(self, flags: Flags) -> None:
        super().__init__()
        self.flags = flags

    def __missing__(self, token: str) -> int:
        if len(self) > KEPT:
            self.clear()
        key, plain = alike(token), token.strip(".,;:()'\"?!")
        value = self[token] = _code(key) if len(key) >= 3 and plain and not (plain[0].isupper() and self.flags.named(plain)) else 0
        return value


_NAMED = "src string, row_id string, doc bigint, text string, names array<string>"


def later_states(texts: DataFrame, pairs: DataFrame, model: Model) -> DataFrame:
    """Windows at the other places of words that a window of their document took for a name, be they written small or stand in no clear context.

    ``pairs`` are hashes of (document, word). PAIRS of them at a time go into a
    table of fixed size; each block is one pass over the texts. The words that
    the blocks find in a text are put together before its windows are made, so
    that no two of its windows overlap.
    """
    count = pairs.count()
    blocks = -(-count // PAIRS)
    if not blocks:
        return texts.sparkSession.createDataFrame([], _STATE)
    named = functools.reduce(DataFrame.unionByName, [_found_again(texts, pairs, model, block, blocks) for block in range(blocks)])
    named = named.groupBy("src", "row_id", "doc", "text").agg(F.flatten(F.collect_list("names")).alias("names"))
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value.lexicon.flags
        found = ((key, window) for *key, names in _rows(batches) for window in windows(key[3], flags, frozenset(names)))
        for part in itertools.batched(found, SCORED):
            yield _state_rows(part, shared.value)

    return _with_ids(named.select("src", "row_id", "doc", "text", "names").mapInArrow(states, _STATE))


def _found_again(texts: DataFrame, pairs: DataFrame, model: Model, block: int, blocks: int) -> DataFrame:
    """The texts that hold a word of a pair of the block, with these words."""
    low = F.lit((1 << 32) - 1)
    own = pairs.where(F.pmod(F.col("pair").bitwiseAND(low), F.lit(blocks)) == block)
    places = F.array(*(F.shiftrightunsigned("pair", bit).bitwiseAND(F.lit((1 << CELLS) - 1)).cast("int") for bit in PROBES))
    cells = own.select(F.explode(places).alias("cell"), F.lit(1).cast("bigint").alias("n")).distinct()
    shared = texts.sparkSession.sparkContext.broadcast((model.lexicon, Table(cell_table(cells))))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, table = shared.value
        codes = lexicon.codes
        for batch in batches:
            for first in range(0, batch.num_rows, 4000):
                part = batch.slice(first, 4000)
                sizes, tokens, places = _split(part.column("text"))
                own = np.fromiter(map(codes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))[places]
                hits = np.flatnonzero(own)
                line_of = np.repeat(np.arange(len(sizes)), sizes)[hits]
                mixed = mix(own[hits] ^ part.column("doc").to_numpy().view(np.uint64)[line_of])
                kept = np.flatnonzero((mixed & np.uint64((1 << 32) - 1)) % np.uint64(blocks) == block)
                for bit in PROBES:
                    kept = kept[table.counts[((mixed[kept] >> np.uint64(bit)) & np.uint64((1 << CELLS) - 1)).astype(np.int64)] > 0]
                wanted: dict[int, set[str]] = {}
                for line, place in zip(line_of[kept].tolist(), places[hits[kept]].tolist()):
                    wanted.setdefault(line, set()).add(alike(tokens[place]))
                if wanted:
                    names = _lists(list(map(len, wanted.values())), pa.array(list(itertools.chain.from_iterable(wanted.values())), pa.string()))
                    found = part.take(pa.array(list(wanted), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*found.columns, names], names=["src", "row_id", "doc", "text", "names"])

    return texts.select("src", "row_id", "doc", "text").mapInArrow(again, _NAMED)


def _groups(lengths: list[int], order: np.ndarray) -> Iterator[np.ndarray]:
    """Windows of similar lengths whose padded scores stay small together."""
    start = 0
    for stop in range(1, len(lengths) + 1):
        if stop == len(lengths) or (stop + 1 - start) * lengths[stop] > PADDED:
            yield order[start:stop]
            start = stop


def _solved(batch: pa.RecordBatch, steps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, spans, log marginals, what the messages told each place) of each window of a batch, with the messages added to its scores."""
    if not batch.num_rows:
        return
    sizes = pc.list_value_length(batch.column("ends")).to_numpy() // 2
    spans = batch.column("ends").flatten().to_numpy().reshape(-1, 2)
    flat = np.frombuffer(b"".join(batch.column("unary").to_pylist()), dtype=np.float16).astype(np.float64).reshape(-1, len(LABELS))
    firsts, told = np.cumsum(sizes) - sizes, np.zeros_like(flat)
    messages = batch.column("messages").flatten()
    counts = pc.fill_null(pc.list_value_length(batch.column("messages")), 0).to_numpy(zero_copy_only=False)
    np.add.at(told, np.repeat(firsts, counts) + messages.field("at").to_numpy(), messages.field("logs").flatten().to_numpy().reshape(-1, len(LABELS)))
    flat += told
    order = np.argsort(sizes, kind="stable")
    for group in _groups(sizes[order].tolist(), order):
        places = firsts[group, None] + np.arange(sizes[group[-1]])
        filled = places < (firsts + sizes)[group, None]
        array = np.where(filled[:, :, None], flat[np.minimum(places, len(flat) - 1)], 0.0)
        logs, _, _ = _marginals(array, filled, steps)
        for k, i in enumerate(group.tolist()):
            own = slice(firsts[i], firsts[i] + sizes[i])
            yield i, spans[own], logs[k, : sizes[i]], told[own]


_MESSAGE = "row bigint, at int, doc bigint, key string, logs array<double>"


def shared_key(token: str, lexicon: Lexicon) -> str:
    """Key of the group that a token shares a potential with; empty for those too short or too common to stand for one thing.

    Capitalised words of three letters, small ones that are known as names, and
    numbers and addresses of six letters and figures belong to a group.
    """
    key = alike(token)
    if token.lower() in _STREET_WORDS:
        return ""
    if token.isalpha() and token.islower():
        return key if len(key) >= 3 and token not in _PARTICLES and lexicon.count(key) else ""
    return key if len(key) >= (3 if token[0].isupper() else 6) else ""


class SharedKeys(dict):
    """Key of a token's group and whether it is known as a name, kept for tokens seen before."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[str, bool]:
        if len(self) > KEPT:
            self.clear()
        key = shared_key(token, self.lexicon)
        value = self[token] = key, self.lexicon.count(key) > 0
        return value


def _sent(text: str, spans: list[tuple[int, int]], logs: np.ndarray, got: np.ndarray | None, lexicon: Lexicon) -> Iterator[tuple[int, str, list[float]]]:
    """(place, key, belief) of the tokens of a window that may be part of an item or are known as names, without what their group told them."""
    maybe = (logs[:, OTHER] <= SURE).tolist()
    keys, beliefs = lexicon.shared_keys, None
    for at, (a, b) in enumerate(spans):
        if b - a >= 3 and (maybe[at] or text[a].isupper()):
            key, known = keys[text[a:b]]
            if key and (known or maybe[at]):
                if beliefs is None:
                    own = np.minimum(np.maximum(logs, -MOST * 2), 0)
                    beliefs = (own if got is None else own - got).tolist()
                yield at, key, beliefs[at]


def _exchange(states: DataFrame, messages: DataFrame | None, model: Model) -> DataFrame:
    """New messages: for each token what the other tokens of its group believe."""
    steps, shared = model.steps, states.sparkSession.sparkContext.broadcast(model.lexicon)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            row, doc, texts = (batch.column(c).to_pylist() for c in ("row", "doc", "text"))
            for i, spans, logs, told in _solved(batch, steps):
                rows += [(row[i], at, doc[i], key, own) for at, key, own in _sent(texts[i], spans.tolist(), logs, told, shared.value)]
            if rows:
                row, at, doc, key, logs = zip(*rows)
                columns = [pa.array(row, pa.int64()), pa.array(at, pa.int32()), pa.array(doc, pa.int64()), pa.array(key, pa.string()), _lists([len(LABELS)] * len(logs), pa.array(np.array(logs).ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "at", "doc", "key", "logs"])

    if messages is None:
        sent = states.select("row", "doc", F.explode("sent").alias("s")).select("row", "s.at", "doc", "s.key", "s.logs")
    else:
        sent = materialize(states.join(messages, "row", "left").select("row", "doc", "text", "ends", "unary", "messages").mapInArrow(send, _MESSAGE))
    parts = [F.col("logs")[k] for k in range(len(LABELS))]
    groups = sent.groupBy("doc", "key").agg(F.count("*").alias("n"), *(F.sum(part).alias(f"sum{k}") for k, part in enumerate(parts))).where("n > 1")
    others = [(F.col(f"sum{k}") - part) / (F.col("n") - 1) for k, part in enumerate(parts)]
    back = sent.join(groups, ["doc", "key"]).select("row", "at", F.array(*others).alias("mean"))
    top = F.array_max("mean")
    logs = F.transform("mean", lambda x: F.lit(SHARED) * F.greatest(x - top, F.lit(-MOST)))
    return back.groupBy("row").agg(F.collect_list(F.struct("at", logs.alias("logs"))).alias("messages"))


def find_personal_data(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """src, row_id, start, end, pii_type, value of every item of personal data.

    Null and empty texts have none; rows without an id are left out, as nothing
    could point to them; rows delivered twice count once; extra columns are
    ignored. A row without a document is a document of its own.
    """
    texts = source_texts(spans, sections)
    names = materialize(name_words(texts))
    model = trained_model(texts, names, {"ocr_spans": spans.count(), "draft_sections": sections.count()})
    steps = model.steps
    first = materialize(first_states(texts, model))
    pairs = materialize(first.select(F.explode("names").alias("pair")).distinct())
    states = first.unionByName(materialize(later_states(texts, pairs, model)))
    messages = None
    for _ in range(ROUNDS):
        messages = _exchange(states, messages, model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            src, row_id, begins, texts = (batch.column(c).to_pylist() for c in ("src", "row_id", "start", "text"))
            for i, own, logs, _ in _solved(batch, steps):
                labels = logs.argmax(axis=1)
                if labels.any():
                    first, text = begins[i], texts[i]
                    for label, start, end in decoded(text, own.tolist(), labels.tolist()):
                        rows.append((src[i], row_id[i], first + start, first + end, LABELS[label], text[start:end]))
            if rows:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), kinds)), names=["src", "row_id", "start", "end", "pii_type", "value"])

    schema = "src string, row_id string, start int, end int, pii_type string, value string"
    return states.join(messages, "row", "left").select("src", "row_id", "start", "text", "ends", "unary", "messages").mapInArrow(decode, schema)


def redact(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """src, row_id, text: every text with a placeholder like [EMAIL] in place of each item, all else unchanged."""
    items = find_personal_data(spans, sections)
    placed = items.groupBy("src", "row_id").agg(F.array_sort(F.collect_set(F.struct("start", "end", "pii_type"))).alias("items"))
    texts = source_texts(spans, sections).select("src", "row_id", "text").distinct().join(placed, ["src", "row_id"], "left")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(done, item):
        kept = F.substring(F.col("text"), done["at"] + 1, item["start"] - done["at"])
        return F.struct(F.concat(done["out"], kept, F.lit("["), F.upper(item["pii_type"]), F.lit("]")).alias("out"), item["end"].alias("at"))

    whole = F.aggregate("items", zero, put, lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    return texts.select("src", "row_id", F.coalesce(whole, F.col("text")).alias("text"))


def found(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """src, row_id, pii_type, value of every item."""
    return find_personal_data(spans, sections).select("src", "row_id", "pii_type", "value").distinct()
