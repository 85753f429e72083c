"""Repairing text from scanned pages.

Header and footer lines are those at the edges of a page that come back on
other pages of the document; page numbers are edge lines that hold nothing
else. Misread words are found over the whole vocabulary: a word's anagram hash
is the sum of the fifth powers of its letters, so a confusion such as rn for m
changes the hash by a fixed difference. A rare word minus the differences of
its possible confusions meets, in one SQL join, the frequent word it stands for.
Words broken at line ends are joined as the counts of both spellings say.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.plans.storage import broadcast_if_small, materialize

#: What is read, and what stood there.
CONFUSIONS = [("c", "e"), ("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("d", "cl"), ("b", "h"), ("f", "t"), ("vv", "w"), ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("9", "g"), ("@", "a"), ("(", "c")]
#: Most confusions in one word.
MOST_CONFUSIONS = 4
#: A frequent variant stands at least so often, and so many times as often as the rare word.
FREQUENT, RATIO = 20, 20
#: Sources of text that was never scanned.
NATIVE = ("pdfplumber",)
#: Lines at the top and at the bottom of a page that can be header, footer or page number.
EDGE = 2
#: A running header comes again within so many pages.
NEXT_PAGES = 4
#: Words from which on a line that comes again later, at the very same height, is a header too.
HEADER_WORDS = 3
#: Letters that a page number with its ornament takes at most.
PAGE_LETTERS = 16
#: Longest line that can be a header or footer.
HEADER_CHARS = 300
#: A page text with a longer line is not cut where the lines of the page end.
SCAN_LINE_CHARS = 200
#: One differing letter is allowed a header for so many letters.
LETTERS_PER_ERROR = 8

_OUTER = ".,;:()[]{}<>\"'!?…“”‘’„«»|*•~–—-‐‑¬­"
_HAS_LETTER = re.compile(r"[^\W\d_]")
_NUMBER = r"(?:\d{1,6}|[ivxlc]{1,7})"
_PAGE = rf"[\[(\-–—~|*•\s]*(?:page|pg\.?|p\.|seite|página|pagina)?\s*{_NUMBER}(?:\s*(?:of|/|von|de|sur)\s*\d{{1,6}})?[\])\-–—~|*•\s]*"
PAGE_ONLY = rf"(?i)^{_PAGE}$"
PAGE_AT_EITHER_END = rf"(?i)^{_PAGE}(?:\s*\|\s*|\s{{2,}})|(?:\s*\|\s*|\s{{2,}}){_PAGE}$"
HYPHENS = "-‐‑¬­"
BROKEN = r"[\p{L}][-‐‑¬­]\s*$"


def anagram_hash(word: str) -> int:
    """Sum of the fifth powers of the letters: equal for all their orders."""
    return sum(ord(c) ** 5 for c in word)


_DIFFERENCES = [(wrong, anagram_hash(wrong) - anagram_hash(right)) for wrong, right in CONFUSIONS]


def possible_hashes(word: str) -> dict[int, int]:
    """Hash of what ``word`` may stand for -> fewest confusions that lead there."""
    reached = {anagram_hash(word): 0}
    for wrong, difference in _DIFFERENCES:  # only how often each confusion is taken counts, not where
        for target, taken in list(reached.items()):
            for more in range(1, min(word.count(wrong), MOST_CONFUSIONS - taken) + 1):
                found = target - more * difference
                reached[found] = min(reached.get(found, MOST_CONFUSIONS), taken + more)
    return {target: taken for target, taken in reached.items() if taken}


def word_cores(spans: DataFrame) -> DataFrame:
    """core, n: every token of all lines in lower case without outer punctuation, if it has a letter.

    An opening bracket that is never closed may be a misread c and stays.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch["text"]:
                tokens = text.lower().split()
                counts.update(token.strip(_OUTER) for token in tokens)
                if "(" in text:
                    counts.update("(" + token.strip(_OUTER) for token in tokens if token[0] == "(" and ")" not in token)
            rows = [(core, n) for core, n in counts.items() if _HAS_LETTER.search(core)]
            yield pd.DataFrame(rows, columns=["core", "n"])

    counted = spans.where("text is not null").select("text").mapInPandas(count, "core string, n bigint")
    return counted.groupBy("core").agg(F.sum("n").alias("n"))


def pieces_of(cores: DataFrame) -> DataFrame:
    """word, n: the runs of letters, digits and @ within the cores."""
    pieces = cores.select(F.explode(F.split("core", r"[^\p{L}\p{N}@(]+")).alias("word"), "n").where("word <> ''")
    return pieces.groupBy("word").agg(F.sum("n").alias("n"))


def corrections(words: DataFrame) -> DataFrame:
    """word, right: the most likely frequent variant of each rare word that has one."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(word, n, target, count) for word, n in batch.itertuples(index=False) for target, count in possible_hashes(word).items()]
            yield pd.DataFrame(rows, columns=["word", "n", "target", "edits"])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(target=[anagram_hash(word) for word in batch["right"]])

    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    plain = words.where(F.col("word").rlike(r"^[\p{L}\p{N}@(]{2,}$"))
    rare = plain.where(letters >= 2 * (F.length("word") - letters)).mapInPandas(expand, "word string, n bigint, target bigint, edits int")
    frequent = plain.where((F.col("n") >= FREQUENT) & F.col("word").rlike(r"^\p{L}+$")).select(F.col("word").alias("right"), F.col("n").alias("n_right"))
    frequent = frequent.mapInPandas(hashes, "right string, n_right bigint, target bigint")
    pairs = rare.join(frequent, "target").where((F.col("n_right") >= RATIO * F.col("n")) & (F.levenshtein("word", "right") <= 2 * F.col("edits")))
    rank = F.struct((F.log("n_right") - 3 * F.col("edits")).alias("score"), "right")
    return pairs.groupBy("word").agg(F.max(rank).getField("right").alias("right"))


def page_lines(spans: DataFrame) -> DataFrame:
    """The lines of each page in reading order, each once, with their distance from both edges."""
    lines = spans.where("span_id is not null").select("span_id", F.when(F.col("page_number").isNull(), F.col("span_id")).otherwise(F.coalesce("document_id", "span_id")).alias("doc"), F.coalesce("page_number", F.lit(-1)).alias("page"), F.coalesce("text", F.lit("")).alias("text"), "x0", "x1", "y0", "y1", (~F.coalesce(F.col("source").isin(*NATIVE), F.lit(False))).alias("scanned"))
    order = Window.partitionBy("doc", "page").orderBy("y0", "x0", "span_id")
    lines = lines.withColumn("again", F.lag("span_id").over(order) == F.col("span_id")).where("again is null or not again").drop("again")
    whole = Window.partitionBy("doc", "page")
    return lines.withColumn("top", F.row_number().over(order)).withColumn("bottom", F.count("*").over(whole) - F.col("top") + 1).withColumn("next_text", F.lead("text").over(order))


#: Lines that can be header, footer or page number.
AT_EDGE = f"scanned and (top <= {EDGE} or bottom <= {EDGE})"


def body_lines(lines: DataFrame, noise: DataFrame) -> DataFrame:
    """The lines that are no noise. Only those at the edges are looked up in ``noise``, all others stay where they are."""
    at_edge = lines.where(AT_EDGE).join(noise.select("span_id"), "span_id", "left_anti")
    return lines.where(f"not ({AT_EDGE})").unionByName(at_edge)


def alike(a: Column, b: Column) -> Column:
    """Whether two lines differ in no more letters than damage explains. Distances beyond that are not counted out."""
    most = F.floor(F.greatest(F.length(a), F.length(b), F.lit(LETTERS_PER_ERROR)) / LETTERS_PER_ERROR).cast("int")
    return (F.abs(F.length(a) - F.length(b)) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)


def edge_noise(lines: DataFrame) -> DataFrame:
    """span_id, noise_type of header, footer and page number lines."""
    edges = lines.where(AT_EDGE).select("span_id", "doc", "page", "top", "bottom", "y0", "text")
    number = F.col("text").rlike(PAGE_ONLY) & F.col("text").rlike(r"(?i)[\divxlc]")
    numbers = edges.where(number).select("span_id", F.lit("page_number").alias("noise_type"))
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", PAGE_AT_EITHER_END, ""), r"\s+", " ")))
    running = F.col("text").rlike(r"^\s*\p{Ll}|[,;\-‐‑¬­]\s*$")  # begins or ends within a sentence
    keyed = materialize(edges.where(~number & ~running).withColumn("key", key).where(F.length("key").between(4, HEADER_CHARS)).select("span_id", "doc", "page", "top", "bottom", "y0", "key"))
    # a header stands at the same edge of two pages, soon again or at the same height
    edge = F.when(F.col("top") <= EDGE, "top").otherwise("bottom")
    placed = keyed.withColumn("edge", edge).withColumn("height", F.round("y0", 2))
    again = Window.partitionBy("doc", "key", "edge").orderBy("page")
    soon = (F.col("page") > F.lag("page").over(again)) & (F.col("page") - F.lag("page").over(again) <= NEXT_PAGES)
    headers = placed.withColumn("soon", soon).where("soon").select("doc", F.col("key").alias("header")).distinct()
    long = placed.where(F.size(F.split("key", " ")) >= HEADER_WORDS)
    later_again = long.groupBy("doc", "key", "edge", "height").agg(F.count_distinct("page").alias("n")).where("n >= 2")
    later_again = long.join(later_again, ["doc", "key", "edge", "height"]).select("span_id")

    # the page number after a header can be too damaged to be taken off
    size = F.length("header")
    begins = (size >= LETTERS_PER_ERROR) & (F.length("key") - size <= PAGE_LETTERS) & alike(F.substring(F.col("key"), F.lit(1), size), F.col("header"))
    known = keyed.join(headers, "doc").where(alike(F.col("key"), F.col("header")) | begins).select("span_id")
    # a header that is damaged on one of few pages has no twin: look at the same place of the next pages
    def at(place: str) -> DataFrame:
        return keyed.where(f"{place} <= {EDGE}").select("span_id", "doc", "page", "key", F.col(place).alias("place"), F.lit(place).alias("edge"))

    slots = at("top").unionByName(at("bottom")).where("length(key) >= 6")
    later = slots.select("doc", F.explode(F.array(*(F.col("page") - k for k in range(1, NEXT_PAGES + 1)))).alias("page"), "edge", F.col("span_id").alias("later_id"), F.col("key").alias("later_key"))
    twins = slots.join(later, ["doc", "page", "edge"]).where((F.col("key") != F.col("later_key")) & alike(F.col("key"), F.col("later_key")))
    twins = twins.select(F.explode(F.array("span_id", "later_id")).alias("span_id"))
    return numbers.unionByName(known.unionByName(later_again).unionByName(twins).distinct().withColumn("noise_type", F.lit("header")))


def _in_case_of(right: Column, seen: Column) -> Column:
    """``right`` in lower, upper or capital letters as ``seen`` is."""
    upper = (F.upper(seen) == seen) & seen.rlike(r"\p{Lu}.*\p{Lu}")
    return F.when(upper, F.upper(right)).when(seen.rlike(r"^\p{Lu}"), F.initcap(right)).otherwise(right)


def _joined_words(body: DataFrame, cores: DataFrame) -> DataFrame:
    """span_id, joined, compound, kept: the two spellings of each word broken at a line's end, and whether its hyphen stays."""
    broken = body.where(F.col("text").rlike(BROKEN) & F.col("next_text").rlike(r"^\s*[\p{L}]"))
    head = F.regexp_replace(F.regexp_extract("text", r"(\S+?)[-‐‑¬­]\s*$", 1), r"^[^\p{L}\p{N}]+", "")
    tail = F.regexp_replace(F.regexp_extract("next_text", r"^\s*(\S+)", 1), r"[^\p{L}\p{N}]+$", "")
    broken = broken.select("span_id", head.alias("head"), tail.alias("tail")).where("head <> '' and tail <> ''")
    broken = broken.withColumn("joined", F.concat("head", "tail")).withColumn("compound", F.concat_ws("-", "head", "tail"))
    for spelling in ("joined", "compound"):
        counts = cores.select(F.col("core").alias(f"low_{spelling}"), F.col("n").alias(f"n_{spelling}"))
        broken = broken.withColumn(f"low_{spelling}", F.lower(spelling)).join(counts, f"low_{spelling}", "left")
    n_joined, n_compound = F.coalesce("n_joined", F.lit(0)), F.coalesce("n_compound", F.lit(0))
    open_case = F.col("tail").rlike(r"^\p{Lu}") & ~F.col("head").rlike(r"^\p{Lu}+$") | F.col("head").contains("@") | F.col("tail").rlike(r"[.@]")
    kept = F.when(n_compound != n_joined, n_compound > n_joined).otherwise(open_case)
    return broken.select("span_id", "joined", "compound", "low_joined", kept.alias("kept"), n_joined.alias("n_joined"))


def repairs(spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, edge noise, fixes) of all spans; fixes has span_id, noise_type, seen, fixed."""
    lines = materialize(page_lines(spans))
    noise = materialize(edge_noise(lines).distinct())
    cores = materialize(word_cores(spans))
    body = body_lines(lines, noise)
    joined = materialize(_joined_words(body, cores))
    unseen = joined.where("not kept and n_joined = 0").select(F.col("low_joined").alias("word"), F.lit(1).cast("bigint").alias("n")).distinct()
    words = materialize(pieces_of(cores).unionByName(unseen).groupBy("word").agg(F.max("n").alias("n")))
    right = materialize(corrections(words))

    fixed_joined = joined.join(right.withColumnRenamed("word", "low_joined"), "low_joined", "left")
    fixed_joined = fixed_joined.withColumn("fixed", F.when(F.col("kept"), F.col("compound")).when(F.col("right").isNotNull() & (F.col("n_joined") < FREQUENT), _in_case_of(F.col("right"), F.col("joined"))).otherwise(F.col("joined")))
    hyphens = fixed_joined.select("span_id", F.lit("hyphen").alias("noise_type"), F.lit("").alias("seen"), "fixed")

    # cores with a misread piece, with the piece put right
    split = cores.select("core", F.explode(F.split("core", r"[^\p{L}\p{N}@(]+")).alias("word")).join(right, "word")
    wrong = split.groupBy("core").agg(F.collect_list(F.struct("word", "right")).alias("swaps"))
    wrong = wrong.select("core", F.aggregate("swaps", F.col("core"), lambda text, swap: F.replace(text, swap["word"], swap["right"])).alias("right"))
    blanks = F.when(F.contains("text", F.lit("\t")) | F.contains("text", F.lit("\u00a0")), F.translate("text", "\t\u00a0", "  ")).otherwise(F.col("text"))
    split_text = F.split(F.rtrim(blanks), " ")
    ends_broken = F.right(F.rtrim("text"), F.lit(1)).isin(*HYPHENS)
    tokens = body.select("span_id", F.explode(F.when(ends_broken, F.slice(split_text, F.lit(1), F.greatest(F.size(split_text) - 1, F.lit(0)))).otherwise(split_text)).alias("token")).where(F.length("token") > 1)
    # an opening bracket that is never closed is part of the core, be it a misread c or not
    unclosed = F.startswith("token", F.lit("(")) & ~F.contains("token", F.lit(")"))
    seen = F.btrim("token", F.lit(_OUTER))
    tokens = tokens.select("span_id", F.when(unclosed, F.concat(F.lit("("), seen)).otherwise(seen).alias("seen"))
    wrong = wrong.unionByName(wrong.where(~F.startswith("core", F.lit("("))).select(F.concat(F.lit("("), "core").alias("core"), "right"))
    misread = tokens.withColumn("core", F.lower("seen")).join(broadcast_if_small(materialize(wrong)), "core")
    misread = misread.select("span_id", F.lit("misread").alias("noise_type"), "seen", _in_case_of(F.col("right"), F.col("seen")).alias("fixed"))
    return lines, noise, hyphens.unionByName(misread)


def found(spans: DataFrame) -> DataFrame:
    """span_id, noise_type, fixed of every noisy line.

    Null and empty texts have no noise; spans without a document or page are
    pages of their own; lines delivered twice count once in the order of their
    page; extra columns are ignored.
    """
    _, noise, fixes = repairs(spans)
    edges = noise.select("span_id", "noise_type", F.lit("").alias("fixed"))
    return edges.unionByName(fixes.select("span_id", "noise_type", "fixed")).distinct()


def text_lines(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """The lines of the newest text of each page that has no spans with a text, as spans.

    Where lines are joined by blanks, a text is cut only after broken words.
    Boxes are in lines and shares of the longest line.
    """
    seen = spans.where(r"span_id is not null and text rlike '\\S'").select(F.coalesce("document_id", "span_id").alias("document_id"), F.coalesce("page_number", F.lit(-1)).alias("page_number")).distinct()
    key = [F.coalesce("document_id", "extraction_id").alias("document_id"), F.coalesce("page_num", F.lit(-1)).alias("page_number")]
    newest = pages.where(r"extraction_id is not null and full_text rlike '\\S'").groupBy(*key).agg(F.max(F.struct("created_at", "extraction_id", "full_text", "source")).alias("p"))
    alone = newest.join(seen, ["document_id", "page_number"], "left_anti").select("document_id", "page_number", "p.extraction_id", "p.full_text", "p.source")
    cuts = F.regexp_replace("full_text", rf"(?<=\p{{L}}[{HYPHENS}]) +(?=\p{{Ll}})(?!(?:and|or|to|und|oder)\b)", "\n")
    cut = alone.withColumn("texts", F.split(F.when(F.trim("full_text").contains("\n"), F.col("full_text")).otherwise(cuts), r"\r?\n"))
    cut = cut.withColumn("longest", F.array_max(F.transform("texts", F.length))).withColumn("step", F.when(F.col("longest") > SCAN_LINE_CHARS, 2.0).otherwise(1.0))
    lines = cut.select("*", F.posexplode("texts").alias("n", "text")).where(r"text rlike '\\S'")
    return lines.select(F.concat_ws(":", F.when(F.trim("full_text").contains("\n"), "lines").otherwise("blanks"), "extraction_id", "n").alias("span_id"), "document_id", "page_number", "text", F.lit(0.0).alias("x0"), (F.length("text") / F.col("longest")).alias("x1"), (F.col("n") * F.col("step")).alias("y0"), (F.col("n") * F.col("step") + 0.4).alias("y1"), "source")


def _without_inline_noise(pages: DataFrame, lines: DataFrame, noise: DataFrame) -> DataFrame:
    """Page texts whose lines were joined by blanks, without their document's headers and their page number at either end."""
    heads = lines.join(noise.where("noise_type = 'header'").select("span_id"), "span_id")
    bare = F.lower(F.trim(F.regexp_replace(F.regexp_replace("text", PAGE_AT_EITHER_END, ""), r"\s+", " ")))
    heads = heads.select("doc", bare.alias("head")).where("head <> ''").groupBy("doc").agg(F.collect_set("head").alias("heads"))
    mark = F.concat(F.lit(r"[\[(\-–—~|*•\s]*(?:\b(?:page|pg\.?|p\.|seite|página|pagina))?\s*"), F.col("page").cast("string"), F.lit(r"(?:\s*(?:of|/|von|de|sur)\s*\d+)?[\])\-–—~|*•\s]*"))
    number_first = F.concat(F.lit(r"(?i)^(?=page|pg|p\.|seite|p[áa]gina|[\[(\-–—~|*•])"), mark, F.lit(r"(?<=[\s\])\-–—~|*•])(?=\S)"))
    number_last = F.concat(F.lit(r"(?i)\s+"), mark, F.lit("$"))

    def off(text: Column, head: Column) -> Column:
        begins = F.startswith(F.lower(text), F.concat(head, F.lit(" ")))
        ends = F.endswith(F.lower(text), F.concat(F.lit(" "), head))
        return F.when(begins, F.substring(text, F.length(head) + 2, F.length(text))).when(ends, F.substring(text, F.lit(1), F.length(text) - F.length(head) - 1)).otherwise(text)

    text = F.trim(F.regexp_replace(F.regexp_replace("text", number_first, ""), number_last, ""))
    text = F.coalesce(F.aggregate("heads", text, off), text)
    text = F.trim(F.regexp_replace(text, number_last, ""))
    return pages.join(heads, "doc", "left").withColumn("text", F.when(F.col("inline"), text).otherwise(F.col("text")))


def clean_pages(spans: DataFrame, page_texts: DataFrame | None = None) -> DataFrame:
    """document_id, page_number, text: each page in continuous paragraphs, without header, footer and page number.

    Pages that have no spans come from ``page_texts`` and are repaired with the
    counts over both.

    A paragraph ends where a line stops well before the right edge of its page
    or where the gap to the next line is much wider than the line is high.
    """
    if page_texts is not None:
        columns = ["span_id", "document_id", "page_number", "text", "x0", "x1", "y0", "y1", "source"]
        spans = spans.select(*columns).unionByName(materialize(text_lines(page_texts, spans)))
    lines, noise, fixes = repairs(spans)
    swaps = fixes.where("noise_type = 'misread'").groupBy("span_id").agg(F.collect_set(F.struct("seen", "fixed")).alias("swaps"))
    joins = fixes.where("noise_type = 'hyphen'").groupBy("span_id").agg(F.first("fixed").alias("whole"))
    body = body_lines(lines, noise).join(swaps, "span_id", "left").join(joins, "span_id", "left")
    text = F.trim(F.coalesce(F.aggregate("swaps", F.col("text"), lambda t, s: F.replace(t, s["seen"], s["fixed"])), F.col("text")))
    body = body.withColumn("text", text)
    order = Window.partitionBy("doc", "page").orderBy("top")
    width = F.max("x1").over(Window.partitionBy("doc", "page"))
    tail = F.lag("whole").over(order).isNotNull()
    body = body.withColumn("text", F.when(F.col("whole").isNotNull(), F.concat(F.regexp_replace("text", r"\S+$", ""), "whole", F.regexp_extract(F.coalesce("next_text", F.lit("")), r"^\s*\S*?([^\p{L}\p{N}\s]*)(?=\s|$)", 1))).otherwise(F.col("text")))
    body = body.withColumn("text", F.when(tail, F.trim(F.regexp_replace("text", r"^\S+", ""))).otherwise(F.col("text")))
    height = F.col("y1") - F.col("y0")
    ends = (F.col("x1") < width - 0.15) | (F.lead("y0").over(order) - F.col("y1") > 2 * height)
    body = body.withColumn("stop", F.when(F.coalesce(ends, F.lit(False)) & F.col("whole").isNull(), F.lit("\n\n")).otherwise(F.lit(" ")))
    pages = body.where("text <> ''").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("top", "text", "stop"))).alias("parts"), F.bool_and(F.startswith("span_id", F.lit("blanks:")) & F.col("scanned")).alias("inline"))
    whole = F.aggregate("parts", F.lit(""), lambda t, p: F.concat(t, p["text"], p["stop"]))
    pages = pages.select("doc", "page", "inline", F.trim(F.regexp_replace(whole, r"\s+$", "")).alias("text"))
    if page_texts is not None:
        pages = _without_inline_noise(pages, lines, noise).where("text <> ''")
    return pages.select(F.col("doc").alias("document_id"), F.col("page").alias("page_number"), "text")
