"""Evidence for cited answers, validation of answers, and input for tagging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import cited_ids, insert_citations
from ..functions.text import strip
from .scale import top_per_group


def build_evidence(hits: DataFrame, question: str, rank: str, content: str, max_items: int = 4, item_chars: int = 3500, total_chars: int = 50_000) -> DataFrame:
    """Evidence E1, E2, ... per question, within a budget per item and in total.

    Blank hits are skipped without using a number. The best hits are cut out
    first, before and after the shuffle, so the sum runs over `max_items` rows
    however many hits a question has. What is left of the budget for an item
    follows from the capped lengths before it.
    """
    capped = hits.withColumn("_content", F.substring(content, 1, item_chars)).filter(strip(F.col("_content")) != "")
    numbered = top_per_group(capped, question, max_items, F.asc(rank), rank="_number")
    before = Window.partitionBy(question).orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    kept = numbered.withColumn("_used", F.coalesce(F.sum(F.length("_content")).over(before), F.lit(0))).filter(F.col("_used") < total_chars)
    final = F.substring(F.col("_content"), F.lit(1), (F.lit(total_chars) - F.col("_used")).cast("int"))
    extra = [name for name in hits.columns if name not in (question, rank, content)]
    return kept.select(question, F.concat(F.lit("E"), F.col("_number").cast("string")).alias("evidence_id"), *extra, final.alias("content"), F.substring("_content", 1, 500).alias("excerpt"))


def trim_to_prompt(evidence: DataFrame, question: str, overhead: Column, max_chars: int) -> DataFrame:
    """Drop the last evidence of a question until prompt text and evidence fit together.

    `overhead` is the length of the prompt without evidence. Questions whose
    prompt alone is too long keep no evidence.
    """
    number = F.substring("evidence_id", 2, 10).cast("int")
    upto = Window.partitionBy(question).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    total = overhead + F.sum(F.length("content")).over(upto)
    return evidence.withColumn("_total", total).filter(F.col("_total") <= max_chars).drop("_total")


def validate_answers(replies: DataFrame, reply: str, evidence_ids: str, general_knowledge: Column | bool, max_chars: int = 3000) -> DataFrame:
    """Check model replies against their evidence: adds answer, general_knowledge, abstained, citations, error.

    Exactly one of the result columns and `error` is filled. An answer without
    markers gets the markers of its evidence list.
    """
    wants_general = F.lit(general_knowledge) if isinstance(general_knowledge, bool) else general_knowledge
    text = F.regexp_replace(F.regexp_replace(F.col(reply), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    read = replies.withColumn("_json", F.try_parse_json(text))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("_json", f"$.{name}", "variant"))
    # The fields of a reply.
    fields = ["answer", "evidenceIds", "generalKnowledge", "abstained"]
    is_object = F.schema_of_variant("_json").startswith("OBJECT<")
    names = F.json_object_keys(F.to_json("_json"))
    unexpected = F.exists(names, lambda name: ~name.isin(*fields))
    raw_ids = F.try_variant_get("_json", "$.evidenceIds", "array<string>")
    ids_type = kind("evidenceIds")
    has_ids = F.array_contains(names, "evidenceIds")
    ids_ok = ~has_ids | (ids_type == "ARRAY<STRING>") | (ids_type == "ARRAY<VOID>") & (F.coalesce(F.size(raw_ids), F.lit(0)) == 0)
    general_type = kind("generalKnowledge")
    types_ok = (kind("answer") == "STRING") & (kind("abstained") == "BOOLEAN") & general_type.isin("STRING", "VOID") & F.array_contains(names, "generalKnowledge") & ids_ok
    raw_answer = F.try_variant_get("_json", "$.answer", "string")
    raw_general = F.when(wants_general & (general_type == "STRING"), strip(F.try_variant_get("_json", "$.generalKnowledge", "string")))
    shaped = read.select(
        *replies.columns,
        F.col("_json").isNotNull().alias("_readable"),
        F.coalesce(is_object, F.lit(False)).alias("_object"),
        F.coalesce(unexpected, F.lit(False)).alias("_unexpected"),
        F.coalesce(types_ok, F.lit(False)).alias("_typed"),
        F.length(raw_answer).alias("_length"),
        strip(raw_answer).alias("_answer"),
        F.when(raw_general != "", raw_general).alias("_general"),
        F.try_variant_get("_json", "$.abstained", "boolean").alias("_abstained"),
        F.array_distinct(F.coalesce(raw_ids, F.array().cast("array<string>"))).alias("_ids"),
    )
    cited = F.coalesce(cited_ids(F.col("_answer")), F.array().cast("array<string>"))
    known = F.col(evidence_ids)
    unknown = F.get(F.concat(F.array_except("_ids", known), F.array_except(cited, known)), F.lit(0))
    error = (
        F.when(~F.col("_readable"), F.lit("response is not valid JSON"))
        .when(~F.col("_object"), F.lit("response is not a JSON object"))
        .when(F.col("_unexpected"), F.lit("response contains unexpected fields"))
        .when(~F.col("_typed"), F.lit("response fields have invalid types"))
        .when((F.col("_length") > max_chars) | (F.coalesce(F.length("_general"), F.lit(0)) > max_chars), F.lit("response exceeds the configured character limit"))
        .when(F.coalesce(F.col("_general").rlike(r"\[E[0-9]+\]"), F.lit(False)), F.lit("general knowledge contains evidence markers"))
        .when(F.col("_abstained") & ((F.col("_answer") != "") | (F.size("_ids") > 0)), F.lit("abstained response contains an evidence answer"))
        .when(F.col("_abstained"), F.lit(None).cast("string"))
        .when(F.col("_answer") == "", F.lit("non-abstained response has no answer"))
        .when(unknown.isNotNull(), F.concat(F.lit("answer cites unknown evidence "), unknown))
        .when((F.size(cited) == 0) & (F.size("_ids") == 0), F.lit("answer has no evidence citations"))
    )
    checked = shaped.withColumn("error", error)
    complete = F.when(F.size(cited) > 0, F.col("_answer")).otherwise(insert_citations(F.col("_answer"), F.col("_ids")))
    valid = F.col("error").isNull()
    answer = F.when(valid & F.col("_abstained"), F.lit("")).when(valid, complete)
    return checked.select(
        *replies.columns,
        answer.alias("answer"),
        F.when(valid, F.col("_general")).alias("general_knowledge"),
        F.when(valid, F.col("_abstained")).alias("abstained"),
        F.when(valid, cited_ids(answer)).alias("citations"),
        "error",
    )


def tagging_inputs(documents: DataFrame, sections: DataFrame, document: str, title: str, max_chars: int = 16_000) -> DataFrame:
    """(document, content): title and visible sections of a document, cut to a budget.

    Every kept section is at least six characters long with its label, so only
    the first max_chars / 6 of them can matter; the rest is pruned before the
    shuffle.
    """
    visible = sections.filter(~F.col("hidden") & (strip(F.col("text")) != ""))
    piece = F.substring(F.concat(F.lit("\n\n["), F.col("label"), F.lit("]\n"), F.col("text")), 1, max_chars)
    first = top_per_group(visible.select(document, "ordinal", piece.alias("piece")), document, max_chars // 6 + 1, F.asc("ordinal"), rank="_rank")
    before = Window.partitionBy(document).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    within = first.withColumn("_used", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))).filter(F.col("_used") < max_chars)
    joined = within.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("ordinal", "piece"))).alias("_pieces"))
    text = F.array_join(F.transform(F.coalesce("_pieces", F.array().cast("array<struct<ordinal:int,piece:string>>")), lambda item: item["piece"]), "")
    return documents.join(joined, document, "left").select(document, F.substring(F.concat(F.lit("Title: "), F.col(title), text), 1, max_chars).alias("content"))
