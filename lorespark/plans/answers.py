"""Replies of models: answers with citations, proposed topics, and what is sent to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, taxonomy
from ..sources.tables import read_spread, read_table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def replies(spark, folder):
    """A reply per turn, in ten shapes from correct to broken."""
    turns = read_spread(spark, folder, "conversations", "conv_id").select("conv_id", "turn", "text")
    text = F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), r"[\[\]]", "")
    kind = (F.col("conv_id") + F.col("turn")) % 10
    general = F.lit(None).cast("string")

    def reply(answer, ids=None, abstained=False, general_knowledge=general):
        fields = [answer.alias("answer"), general_knowledge.alias("generalKnowledge"), F.lit(abstained).alias("abstained")]
        if ids is not None:
            fields.append(F.array(*[F.lit(item) for item in ids]).cast("array<string>").alias("evidenceIds"))
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    cited = F.concat(text, F.lit(" [E1]."))
    raw = (
        F.when(kind == 0, reply(cited, ["E1"]))
        .when(kind == 1, F.concat(F.lit("```json\n"), reply(text, ["E2", "E1", "E2"]), F.lit("\n```")))
        .when(kind == 2, reply(F.concat(text, F.lit(" [E9]"))))
        .when(kind == 3, reply(text, []))
        .when(kind == 4, reply(F.lit(""), [], True, F.concat(F.lit(" "), text, F.lit(" "))))
        .when(kind == 5, reply(cited, ["E1"], True))
        .when(kind == 6, F.concat(F.lit("not json: "), text))
        .when(kind == 7, F.lit('{"answer": 5, "generalKnowledge": null, "abstained": false}'))
        .when(kind == 8, F.lit('{"answer": "x [E1]", "generalKnowledge": null, "abstained": false, "extra": 1}'))
        .otherwise(reply(cited, ["E1"], False, F.lit("see [E1]")))
    )
    return turns.select("conv_id", "turn", raw.alias("reply"), F.array(F.lit("E1"), F.lit("E2")).alias("known"))


SHAPED = r"""shaped AS (SELECT conv_id, turn, (conv_id + turn) % 10 AS kind, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[\[\]]', '', 'g') AS t FROM conversations)"""


@query(
    "answer_validation",
    rf"""WITH {SHAPED} SELECT conv_id, turn,
      CASE kind WHEN 0 THEN t || ' [E1].' WHEN 1 THEN CASE WHEN regexp_matches(t, '[.!?](\s|$)') THEN regexp_replace(regexp_replace(t, '([.!?])(\s)', '\1 [E2] [E1]\2', 'g'), '([.!?])$', '\1 [E2] [E1]') ELSE t || ' [E2] [E1]' END WHEN 4 THEN '' END AS answer,
      CASE kind WHEN 4 THEN t END AS general_knowledge, CASE kind WHEN 0 THEN false WHEN 1 THEN false WHEN 4 THEN true END AS abstained,
      CASE kind WHEN 0 THEN 'E1' WHEN 1 THEN 'E2,E1' WHEN 4 THEN '' END AS citations,
      CASE kind WHEN 2 THEN 'answer cites unknown evidence E9' WHEN 3 THEN 'answer has no evidence citations' WHEN 5 THEN 'abstained response contains an evidence answer' WHEN 6 THEN 'response is not valid JSON'
        WHEN 7 THEN 'response fields have invalid types' WHEN 8 THEN 'response contains unexpected fields' WHEN 9 THEN 'general knowledge contains evidence markers' END AS error FROM shaped""",
)
def answer_validation(spark, folder):
    checked = evidence.validate_answers(replies(spark, folder), "reply", "known", True, 100_000)
    return checked.select("conv_id", "turn", "answer", "general_knowledge", "abstained", F.array_join("citations", ",").alias("citations"), "error")


@query(
    "topic_parsing",
    """SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 2 THEN 'topic:' || lang || '=0.9' ELSE 'topic:' || lang || '-' || source || '=0.95,topic:' || source || '=0.7' END AS topics,
      CASE doc_id % 5 WHEN 3 THEN 'classification response is not valid JSON' WHEN 4 THEN 'classification response has no topics array' END AS error FROM documents""",
)
def topic_parsing(spark, folder):
    """A reply per document: thinking and fences, plain objects, repeats, broken JSON, a missing list."""
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "lang", "source", "text")
    kind = F.col("doc_id") % 5
    entry = lambda tag, confidence: F.struct(tag.alias("tag"), F.concat(F.lit(" "), tag, F.lit("  label ")).alias("displayName"), F.lit(confidence).alias("confidence"))
    both = F.to_json(F.struct(F.array(entry(F.col("source"), 0.7), entry(F.concat(F.lit("Topic:"), "lang", F.lit(" "), "source"), 0.95), entry(F.lit("low"), 0.2)).alias("topics")))
    repeated = F.to_json(F.struct(F.array(entry(F.col("lang"), 0.8), entry(F.concat(F.lit("topic:"), "lang"), 0.9), entry(F.lit("over"), 1.5)).alias("topics")))
    reply = (
        F.when(kind == 0, F.concat(F.lit("<think>{"), "text", F.lit("</think>\nHere:\n```json\n"), both, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("The topics are "), both, F.lit(" as asked")))
        .when(kind == 2, repeated)
        .when(kind == 3, F.concat(F.lit("{ broken "), F.translate("text", "{}", "")))
        .otherwise(F.lit('{"labels": []}'))
    )
    parsed = taxonomy.parse_topics(documents.select("doc_id", reply.alias("reply")), "reply", ["doc_id"])
    shown = F.transform("topics", lambda item: F.concat(item["tag"], F.lit("="), item["confidence"].cast("string")))
    return parsed.select("doc_id", F.array_join(shown, ",").alias("topics"), "error")


@query(
    "topic_merge",
    """WITH both_lists AS (SELECT conv_id, 'topic:' || role AS tag, (turn % 4) / 4.0 AS confidence, turn AS position FROM conversations),
    best AS (SELECT conv_id, tag, max(confidence) AS confidence, min(position) AS position FROM both_lists GROUP BY ALL)
    SELECT conv_id, string_agg(tag || '=' || round(confidence, 2), ',' ORDER BY confidence DESC, position) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY confidence DESC, position) AS r FROM best) WHERE r <= 2 GROUP BY conv_id""",
)
def topic_merge(spark, folder):
    """Proposed and confirmed topics of a conversation, one per turn, merged to the best two."""
    turns = read_spread(spark, folder, "conversations", "conv_id")
    proposed = turns.select("conv_id", F.concat(F.lit("topic:"), "role").alias("tag"), F.col("role").alias("display_name"), ((F.col("turn") % 4) / 4.0).alias("confidence"), F.col("turn").alias("position"))
    merged = taxonomy.merge_topic_rows(proposed, "conv_id", 2)
    return merged.select("conv_id", F.array_join(F.transform("topics", lambda item: F.concat(item["tag"], F.lit("="), F.round(item["confidence"], 2).cast("string"))), ",").alias("topics"))


@query(
    "tagging_inputs",
    """WITH pieces AS (SELECT conv_id, turn, chr(10) || chr(10) || '[Turn ' || turn || ']' || chr(10) || text AS p FROM conversations WHERE role <> 'system')
    SELECT c.conv_id, substr('Title: Talk ' || c.conv_id || coalesce((SELECT string_agg(p, '' ORDER BY turn) FROM pieces p WHERE p.conv_id = c.conv_id), ''), 1, 700) AS content FROM (SELECT DISTINCT conv_id FROM conversations) c""",
)
def tagging_inputs(spark, folder):
    turns = read_spread(spark, folder, "conversations", "conv_id")
    documents = turns.select("conv_id").distinct().withColumn("title", F.concat(F.lit("Talk "), F.col("conv_id").cast("string")))
    sections = turns.select("conv_id", F.col("turn").cast("int").alias("ordinal"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("label"), "text", (F.col("role") == "system").alias("hidden"))
    return evidence.tagging_inputs(documents, sections, "conv_id", "title", 700)


NAMES = """names AS (SELECT DISTINCT 'topic:' || lower(replace(p_name, ' ', '-')) AS tag, lower(p_name) AS name FROM part
    UNION ALL SELECT DISTINCT 'topic:' || lower(p_type) || '-' || lower(p_brand), lower(p_type) || ' ' || lower(p_brand) FROM part
    UNION ALL SELECT DISTINCT 'topic:' || w, w FROM (SELECT lower(string_split(regexp_replace(text, '[^a-zA-Z ]+', ' ', 'g'), ' ')[2]) AS w FROM benchmark) WHERE length(w) >= 3)"""


@query(
    "orphan_topics",
    rf"""WITH {NAMES} SELECT d.doc_id, n.tag FROM documents d JOIN names n ON contains(lower(d.text), n.name) AND regexp_matches(lower(d.text), '(^|[^\p{{L}}\p{{N}}])' || n.name || '($|[^\p{{L}}\p{{N}}])')""",
)
def orphan_topics(spark, folder):
    """Unused topics named by parts, by type and brand, and by the second words of benchmark items, found in the texts."""
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text")
    parts = read_table(spark, folder, "part").select(F.concat(F.lit("topic:"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("tag")).distinct()
    kinds = read_table(spark, folder, "part").select(F.concat(F.lit("topic:"), F.lower("p_type"), F.lit("-"), F.lower("p_brand")).alias("tag")).distinct()
    second = F.lower(F.try_element_at(F.split(F.regexp_replace("text", "[^a-zA-Z ]+", " "), " "), F.lit(2)))
    common = read_table(spark, folder, "benchmark").select(second.alias("word")).filter(F.length("word") >= 3).select(F.concat(F.lit("topic:"), "word").alias("tag")).distinct()
    definitions = parts.unionByName(kinds).unionByName(common).select("tag", F.lit("topic").alias("kind"), F.col("tag").alias("display_name"), F.array().cast("array<string>").alias("aliases"), F.lit(0).alias("usage_count"))
    return taxonomy.orphan_topics(documents, definitions, "doc_id", "text").select("doc_id", "tag")


@query(
    "reconciliation_candidates",
    """WITH used AS (SELECT p_type, p_brand, count(*) AS c FROM part GROUP BY ALL), defs AS (SELECT 'topic:' || lower(p_type) || '-' || lower(replace(p_brand, '#', '')) AS tag, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 0 ELSE c END AS usage_count FROM used),
    named AS (SELECT DISTINCT l_orderkey AS document_id, 'topic:' || lower(p_type) || '-' || lower(replace(p_brand, '#', '')) AS tag FROM lineitem JOIN part ON p_partkey = l_partkey),
    offered AS (SELECT n.document_id, d.tag, d.usage_count FROM named n JOIN defs d USING (tag) WHERE usage_count > 0 UNION ALL SELECT NULL, tag, usage_count FROM defs WHERE usage_count = 0)
    SELECT coalesce(document_id, -1) AS document_id, tag, usage_count FROM offered""",
)
def reconciliation_candidates(spark, folder):
    """Topics of the parts of an order, and once every topic that nobody uses (document -1)."""
    parts = read_table(spark, folder, "part")
    tag = F.concat(F.lit("topic:"), F.lower("p_type"), F.lit("-"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    counted = parts.groupBy("p_type", "p_brand").agg(F.count("*").alias("c"))
    definitions = counted.select(
        tag.alias("tag"), F.lit("topic").alias("kind"), F.col("p_type").alias("display_name"), F.array().cast("array<string>").alias("aliases"),
        F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), F.lit(0).cast("bigint")).otherwise(F.col("c")).alias("usage_count"),
    )
    lines = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("p_partkey"))
    named = lines.join(parts, "p_partkey").select("document_id", tag.alias("tag"))
    odd, even = named.filter(F.col("document_id") % 2 == 1), named.filter(F.col("document_id") % 2 == 0)
    return taxonomy.reconciliation_candidates(definitions, odd, even).select(F.coalesce("document_id", F.lit(-1)).alias("document_id"), "tag", "usage_count")
