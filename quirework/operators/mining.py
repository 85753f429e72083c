"""Grounding of values, word diffs, cut texts and rules mined from edits."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import text as T

#: Share of a value's words that must stand in one text, and how long a word must be to count.
GROUNDED_SHARE, WORD_LENGTH = 0.6, 3
#: A text is cut if it has so many times its limit.
OVER_LIMIT = 1.5


def normal(text: Column) -> Column:
    """Lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def grounded_values(values: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Each value (value_id, key, value) with whether a text of its key holds it, or enough of its words.

    Values without a letter or digit are not grounded; a key without texts
    grounds nothing.
    """
    long_words = F.filter(T.terms(F.col("value")), lambda w: F.length(w) >= WORD_LENGTH)
    asked = values.select("value_id", key, normal(F.col("value")).alias("v"), F.array_distinct(long_words).alias("w"))
    pairs = asked.join(texts.select(key, normal(F.col("text")).alias("t")), key, "left")
    whole = F.contains("t", "v") & (F.col("v") != "")
    share = F.size(F.filter("w", lambda w: F.contains(F.col("t"), w))) / F.size("w")
    held = F.coalesce(whole | ((F.size("w") > 0) & (share >= GROUNDED_SHARE)), F.lit(False))
    return pairs.groupBy("value_id").agg(F.bool_or(held).alias("grounded"))


def signal_terms(text: Column) -> Column:
    """Names, numbers and dates of a text: capitalised words of three letters and more, figures of two and more."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]{2,}\b"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"\b\d[\d,./-]*\d\b"), F.lit(0))))


def word_changes(pairs: DataFrame) -> DataFrame:
    """pair_id, place, op, old, new: replaced, deleted and inserted runs of words between two texts (old_text, new_text)."""
    schema = "pair_id string, place int, op string, old string, new string"

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, old, new in batch.itertuples(index=False):
                a, b = (re.findall(r"\S+|\s+", x or "") for x in (old, new))
                changes = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
                rows += [(key, k, op, "".join(a[i:j]), "".join(b[m:n])) for k, (op, i, j, m, n) in enumerate(changes)]
            yield pd.DataFrame(rows, columns=["pair_id", "place", "op", "old", "new"])

    return pairs.select("pair_id", "old_text", "new_text").mapInPandas(diff, schema)


def cut_texts(texts: DataFrame) -> DataFrame:
    """key, text, cut: texts far over their limit cut at the last sentence within it, at least one sentence kept."""
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    sizes = F.transform("parts", lambda s: F.size(T.words(s)))
    rows = texts.withColumn("parts", parts).withColumn("sizes", sizes)
    total = F.aggregate("sizes", F.lit(0), lambda a, b: a + b)
    kept = F.aggregate(
        "sizes", F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")), lambda s, x: F.when((s["words"] >= 0) & (s["words"] + x <= F.col("most")), F.struct((s["n"] + 1).alias("n"), (s["words"] + x).alias("words"))).otherwise(F.struct(s["n"].alias("n"), F.lit(-1).alias("words")))
    )["n"]
    over = F.coalesce(total > OVER_LIMIT * F.col("most"), F.lit(False))
    return rows.select("key", F.when(over, F.array_join(F.slice("parts", F.lit(1), F.greatest(kept, F.lit(1))), " ")).otherwise(F.col("text")).alias("text"), over.alias("cut"))


def rule_answers(answers: DataFrame) -> DataFrame:
    """group_id, rule of the judge's JSON answers that name a rule with enough evidence (evidence, min_evidence)."""
    rule = F.trim(F.get_json_object("answer", "$.rule"))
    evidence = F.size(F.from_json(F.get_json_object("answer", "$.evidence"), "array<string>"))
    return answers.where(rule.isNotNull() & (rule != "") & (F.upper(rule) != "NO_RULE") & (evidence >= F.col("min_evidence"))).select("group_id", rule.alias("rule"))


def new_rules(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rules whose text, trimmed and whatever its case, no rule of the template has yet; each once."""
    key = F.lower(F.trim("rule")).alias("key")
    first = found.select("template_id", key, "rule").groupBy("template_id", "key").agg(F.min("rule").alias("rule"))
    return first.join(known.select("template_id", key), ["template_id", "key"], "left_anti").select("template_id", "rule")
