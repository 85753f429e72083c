"""Claims, citations, grounding, diffs and edit mining over drafts and their sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T

#: How statuses outrank one another when claims are merged.
SEVERITY = {"supported": 0, "partial": 1, "unsupported": 2, "contradicted": 3}


def claims(sections: DataFrame) -> DataFrame:
    """section_id, claim_no, claim, chunk_ids: sentences with the chunks cited right after them.

    A citation belongs to the last sentence before it; a sentence without one
    has no chunks. A text without citations is one claim per sentence too.
    """
    marked = F.regexp_replace("ai_text", r"([.!?])\s*((?:\[chunk:[^\]]+\]\s*)+)", "$1$2␞")
    parts = F.filter(F.transform(F.split(F.regexp_replace(marked, r"([.!?])\s+(?=[^\[])", "$1␞"), "␞"), lambda s: F.trim(s)), lambda p: p != "")
    rows = sections.where("ai_text is not null").select("section_id", F.posexplode(parts).alias("claim_no", "part"))
    claim = F.trim(F.regexp_replace("part", r"\s*\[chunk:[^\]]*\]", ""))
    return rows.select("section_id", "claim_no", claim.alias("claim"), T.citations(F.col("part")).alias("chunk_ids")).where("claim <> ''")


def cited_chunks(sections: DataFrame) -> DataFrame:
    """section_id, place, chunk_id of every citation."""
    return sections.select("section_id", "draft_id", F.posexplode(T.citations(F.col("ai_text"))).alias("place", "chunk_id"))


def dangling_citations(sections: DataFrame, supporting: DataFrame) -> DataFrame:
    """Citations of a draft's sections that no field of the draft names as supporting."""
    return cited_chunks(sections).join(supporting.select("draft_id", "chunk_id").distinct(), ["draft_id", "chunk_id"], "left_anti")


def groundedness(sections: DataFrame) -> DataFrame:
    """draft_id, claims, cited, by_claim, by_section: cited share over all claims, and the mean of the sections' shares."""
    per = claims(sections).groupBy("section_id").agg(F.count("*").alias("claims"), F.sum(F.when(F.size("chunk_ids") > 0, 1).otherwise(0)).alias("cited"))
    rows = sections.select("section_id", "draft_id").join(per, "section_id").withColumn("share", F.col("cited") / F.col("claims"))
    return rows.groupBy("draft_id").agg(
        F.sum("claims").alias("claims"), F.sum("cited").alias("cited"), F.round(F.sum("cited") / F.sum("claims"), 3).alias("by_claim"), F.round(F.avg("share"), 3).alias("by_section")
    )


def length_checks(sections: DataFrame) -> DataFrame:
    """Whether each section's text is there and within its limits: ok, warn or fail."""
    n = F.size(T.words(F.coalesce("ai_text", F.lit(""))))
    within = n.between(F.coalesce("target_length_min", F.lit(0)), F.coalesce("target_length_max", F.lit(2**31 - 1)))
    return sections.select("section_id", "name", n.alias("n_words"), F.when(n == 0, "fail").when(within, "ok").otherwise("warn").alias("length_between"), F.when(F.size(T.citations(F.coalesce("ai_text", F.lit("")))) > 0, "ok").otherwise("fail").alias("cites_at_least_one"))


def newest_versions(specs: DataFrame) -> DataFrame:
    """The highest version of each template with its section names in order."""
    last = specs.groupBy("template_id").agg(F.max("template_version").alias("template_version"))
    return specs.join(last, ["template_id", "template_version"]).groupBy("template_id", "template_version").agg(F.array_sort(F.collect_set("name")).alias("sections"))


def version_changes(specs: DataFrame) -> DataFrame:
    """Sections that each version of a template adds to and drops from the one before."""
    names = specs.groupBy("template_id", "template_version").agg(F.array_sort(F.collect_set("name")).alias("names"))
    before = F.coalesce(F.lag("names").over(Window.partitionBy("template_id").orderBy("template_version")), F.array().cast("array<string>"))
    return names.select("template_id", "template_version", F.array_sort(F.array_except("names", before)).alias("added"), F.array_sort(F.array_except(before, "names")).alias("removed"))


def edit_rates(edits: DataFrame, drafts: DataFrame) -> DataFrame:
    """Share of a template's drafts in which each field or section was edited; null without drafts."""
    totals = drafts.groupBy("template_id").agg(F.count_distinct("draft_id").alias("drafts"))
    counts = edits.groupBy("template_id", "field_or_section_name", "field_type").agg(F.count_distinct("draft_id").alias("edited"))
    return counts.join(totals, "template_id", "left").withColumn("rate", F.round(F.when(F.col("drafts") > 0, F.col("edited") / F.col("drafts")), 6))


def rule_groups(edits: DataFrame, newest: int = 12, least: int = 3) -> DataFrame:
    """Groups of edits to the same field: size, evidence a rule needs, and the ids of the newest edits."""
    key = ["template_id", "field_or_section_name", "field_type"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("created_at"), "edit_id"))
    recent = edits.withColumn("rank", rank).where(F.col("rank") <= newest)
    groups = recent.groupBy(*key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "edit_id"))).alias("e"))
    return groups.where(F.col("n") >= least).select(*key, "n", F.greatest(F.lit(2), F.ceil(F.col("n") * 6 / 10)).cast("int").alias("min_evidence"), F.array_join(F.transform("e", lambda x: x["edit_id"]), ",").alias("edit_ids"))


def value_changes(edits: DataFrame) -> DataFrame:
    """edit_id, field_type, kind, distance, share: what an edit did to a value, the edit distance, and its share of the longer text.

    Values are compared trimmed; a change of null to a value is an addition,
    the other way round a removal.
    """
    get = lambda c: F.trim(F.when(F.col("field_type") == "section", F.get_json_object(c, "$.text")).otherwise(F.get_json_object(c, "$.value")))
    rows = edits.select("edit_id", "field_type", get("ai_value").alias("a"), get("user_value").alias("u"))
    kind = F.when(F.col("a").eqNullSafe(F.col("u")), "same").when(F.col("a").isNull(), "added").when(F.col("u").isNull(), "removed").otherwise("modified")
    distance = F.levenshtein("a", "u")
    return rows.select("edit_id", "field_type", kind.alias("kind"), distance.alias("distance"), F.round(distance / F.greatest(F.length("a"), F.length("u"), F.lit(1)), 6).alias("share"))


def merged_status(verdicts: DataFrame) -> DataFrame:
    """The gravest status of each claim; none counts as unsupported."""
    rank = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    back = F.create_map(*(F.lit(x) for k, v in SEVERITY.items() for x in (v, k)))
    return verdicts.groupBy("claim_id").agg(F.coalesce(F.max(rank[F.col("status")]), F.lit(SEVERITY["unsupported"])).alias("r")).select("claim_id", back[F.col("r")].alias("status"))


def list_diff(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Sorted additions and removals between two lists; order and repeats do not matter."""
    return pairs.withColumn("added", F.array_sort(F.array_except(new, old))).withColumn("removed", F.array_sort(F.array_except(old, new)))


def party_key(name):
    """Parties are the same if their names are, whatever case and outer blanks; roles do not count."""
    return F.lower(F.trim(name))
