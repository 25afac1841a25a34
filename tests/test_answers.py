import json

from pyspark.sql import functions as F

from lorespark.functions import citations
from lorespark.operators import evidence


def check(spark, replies, general=True, limit=3000):
    frame = spark.createDataFrame([(n, reply, ["E1", "E2"]) for n, reply in enumerate(replies)], "n int, reply string, known array<string>")
    return evidence.validate_answers(frame, "reply", "known", general, limit).orderBy("n").collect()


def reply(**fields):
    return json.dumps({"generalKnowledge": None, "abstained": False, **fields})


def test_validation(spark):
    rows = check(spark, [
        reply(answer="La política concede dieciséis semanas [E1].", generalKnowledge=" Las leyes locales. "),
        reply(answer="Weeks [E99]."),
        reply(answer="Una afirmación sin cita."),
        reply(answer="First. Second! v1.2", evidenceIds=["E2", "E1", "E2"]),
        reply(answer="", abstained=True),
        reply(answer="x", abstained=True),
        reply(answer=" ", evidenceIds=["E1"]),
        reply(answer="ok [E1]", evidenceIds=["E7"]),
        "```json\n" + reply(answer="ok [E2]") + "\n```",
        "nope", "[1]", reply(answer="x [E1]", more=1), reply(answer=3), json.dumps({"answer": "x [E1]", "abstained": False}), reply(answer="x [E1]", evidenceIds="E1"),
        reply(answer="x" * 3001 + "[E1]"), reply(answer="a [E1]", generalKnowledge="b [E1]"), "null",
    ])
    assert rows[0]["general_knowledge"] == "Las leyes locales." and rows[0]["citations"] == ["E1"] and rows[0]["error"] is None
    assert rows[1]["error"] == "answer cites unknown evidence E99" and rows[2]["error"] == "answer has no evidence citations"
    assert rows[3]["answer"] == "First. [E2] [E1] Second! [E2] [E1] v1.2" and rows[3]["citations"] == ["E2", "E1"]
    assert rows[4]["abstained"] and rows[4]["answer"] == "" and rows[5]["error"] == "abstained response contains an evidence answer"
    assert rows[6]["error"] == "non-abstained response has no answer" and rows[7]["error"] == "answer cites unknown evidence E7"
    assert rows[8]["answer"] == "ok [E2]" and rows[9]["error"] == "response is not valid JSON" and rows[10]["error"] == "response is not a JSON object"
    assert rows[11]["error"] == "response contains unexpected fields"
    assert [rows[n]["error"] for n in (12, 13, 14)] == ["response fields have invalid types"] * 3
    assert rows[15]["error"].endswith("character limit") and rows[16]["error"] == "general knowledge contains evidence markers"
    assert rows[17]["error"] == "response is not a JSON object"
    assert check(spark, [reply(answer="a [E1]", generalKnowledge="b [E1]")], general=False)[0]["general_knowledge"] is None


def test_evidence_budgets(spark):
    hits = spark.createDataFrame([(1, 1, "a" * 50), (1, 2, "   "), (1, 3, "b" * 50), (1, 4, "c" * 50), (1, 5, "d"), (2, 1, "z")], "q int, rank int, text string")
    rows = evidence.build_evidence(hits, "q", "rank", "text", 3, 40, 100).orderBy("q", "evidence_id").collect()
    assert [(row["q"], row["evidence_id"], len(row["content"])) for row in rows] == [(1, "E1", 40), (1, "E2", 40), (1, "E3", 20), (2, "E1", 1)]
    built = evidence.build_evidence(hits, "q", "rank", "text", 3, 40, 100)
    assert [row["evidence_id"] for row in evidence.trim_to_prompt(built, "q", F.lit(10), 91).filter("q = 1").collect()] == ["E1", "E2"]


def test_citation_addresses(spark):
    row = spark.range(1).select(citations.section_url(F.lit(7), F.lit(123)).alias("s"), citations.page_url(F.lit("a b")).alias("p"), citations.cited_ids(F.lit("x [E2] y [E1] [E2] [Ex]")).alias("c")).first()
    assert tuple(row) == ("/documents/7/content?offset=100#section-123", "/wiki/a%20b", ["E2", "E1"])


def test_tagging_input(spark):
    documents = spark.createDataFrame([(1, "Title"), (2, "Empty")], "d int, t string")
    sections = spark.createDataFrame([(1, 0, "P1", "one", False), (1, 1, "P2", "hidden", True), (1, 2, "P3", " ", False), (1, 3, "P4", "x" * 100, False)], "d int, ordinal int, label string, text string, hidden boolean")
    rows = {row["d"]: row["content"] for row in evidence.tagging_inputs(documents, sections, "d", "t", 40).collect()}
    assert rows == {1: ("Title: Title\n\n[P1]\none\n\n[P4]\n" + "x" * 100)[:40], 2: "Title: Empty"}
