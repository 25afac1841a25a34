import datetime

import pytest

from lorespark.archive import Archive
from lorespark.model import PAGES, RequestError, Settings
from lorespark.sources import tables

T0 = datetime.datetime(2024, 1, 1)


def make(spark):
    page = lambda number, title, body, tags=(), parent=None: (number, title, title.lower().replace(" ", "-"), body, list(tags), "published", parent, {}, T0, T0, None, None)
    return spark.createDataFrame([page(1, "Home", "Look at [[tide-table]].", ["index"]), page(2, "Tide table", "The harbour shows seventeen marks for spring tides.", ["sea"], 1), page(3, "Moon", "Spring and neap.", ["sea"], 1)], PAGES)


def test_questions(spark, tmp_path):
    tables.publish({"pages": make(spark)}, str(tmp_path / "store"))
    archive = Archive.open(spark, str(tmp_path / "store"), settings=Settings(embedding_dimensions=2))
    found = archive.search("spring", limit=1)
    assert found["mode"] == "lexical" and len(found["hits"]) == 1 and found["next_cursor"]
    rest = archive.search("spring", limit=1, cursor=found["next_cursor"])
    assert {found["hits"][0]["hit"], rest["hits"][0]["hit"]} == {"p:2", "p:3"} and rest["next_cursor"] is None
    with pytest.raises(RequestError):
        archive.search("other", cursor=found["next_cursor"])
    with pytest.raises(RequestError):
        archive.search("spring", vector=[1.0])
    assert archive.search("spring", vector=[1.0, 0.0])["warning"].startswith("Semantic index")
    assert [row["id"] for row in archive.search_pages("seventeen").collect()] == [2]
    assert [row["id"] for row in archive.page("home").collect()] == [1] and [row["id"] for row in archive.page(3).collect()] == [3]
    assert [(row["id"], row["depth"]) for row in archive.tree().collect()] == [(1, 0), (3, 1), (2, 1)]
    assert [row["alias"] for row in archive.outgoing(1).collect()] == ["tide-table"]
    assert [row["id"] for row in archive.related(2).collect()] == [3]
    assert archive.list(limit=2)[1] is not None and archive.trash() == ([], None)
    assert archive.chunks().count() == 3 and archive.tags().count() == 2
    proof = archive.evidence_for("How many marks has the harbour at full moon?").collect()
    assert proof[0]["evidence_id"] == "E1" and proof[0]["locator"] == "tide-table"
    assert archive.evidence_for("spring neap").first()["locator"] == "moon"
