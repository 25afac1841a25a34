import datetime
import random

import pytest
from pyspark.sql import functions as F

from lorespark.model import PAGES
from lorespark.operators import filters, graph, paging, taxonomy, tree

T0 = datetime.datetime(2024, 1, 1)


def page(number, title, body="", tags=(), parent=None, status="published", deleted=None):
    alias = title.lower().replace(" ", "-")
    return (number, title, f"deleted-page-{number}" if deleted else alias, body, sorted(tags), status, parent, {}, T0, T0 + datetime.timedelta(minutes=number), deleted, alias if deleted else None)


def make(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_navigation(spark):
    pages = make(
        spark,
        [
            page(1, "Chart", "Follow [[north-pier]], then [[Old-Light|the light]], then [[sandbank]].", ["sea", "map"]),
            page(2, "Legend", parent=1),
            page(3, "North Pier", tags=["sea", "map"]),
            page(4, "Old Light", deleted=T0),
            page(5, "Kelp", tags=["sea"]),
        ],
    )
    links = graph.link_rows(pages)
    assert [row["id"] for row in graph.children(pages, 1).collect()] == [2]
    assert [(row["id"], row["title"], row["alias"], row["state"]) for row in graph.outgoing_links(links, pages, 1).collect()] == [
        (3, "North Pier", "north-pier", "active"), (4, "Old Light", "old-light", "deleted"), (None, None, "sandbank", "missing"),
    ]
    found = graph.related(pages, 1).collect()
    assert [row["id"] for row in found] == [3, 5] and found[0]["shared_tags"] == ["map", "sea"]
    edges = graph.related_by_edges(filters.tag_rows(pages), pages, 1).collect()
    assert [row["id"] for row in edges] == [3, 5] and edges[0]["shared_tags"] == ["map", "sea"]
    overview = graph.explore(links, pages)
    top = overview["most_linked"].first()
    assert (top["id"], top["incoming_links"]) == (3, 1)
    free = [row["id"] for row in overview["unconnected"].collect()]
    assert 1 in free and 3 not in free
    assert [(row["page_id"], row["source_alias"]) for row in graph.backlinks(links, pages).collect()] == [(3, "chart")]


def test_newest_deleted_page_answers_for_an_alias(spark):
    later = T0 + datetime.timedelta(days=1)
    pages = make(spark, [page(1, "Gone", deleted=later), page(2, "Gone", deleted=T0)])
    links = spark.createDataFrame([(9, "gone")], "source_page_id long, target_alias string")
    assert graph.link_states(links, pages).first()["id"] == 1
    assert filters.deleted_by_alias(pages, "gone").first()["id"] == 2


def test_tree_and_breadcrumbs(spark):
    pages = make(spark, [page(1, "Root"), page(2, "Child", parent=1, status="draft"), page(3, "Grandchild", parent=2), page(4, "another", parent=1)])
    rows = tree.tree(pages, "all").collect()
    assert [(row["id"], row["depth"]) for row in rows] == [(1, 0), (4, 1), (2, 1), (3, 2)]
    assert [(row["id"], row["depth"]) for row in tree.tree(pages).collect()] == [(3, 0), (1, 0), (4, 1)]
    crumbs = {row["id"]: [item["id"] for item in row["breadcrumbs"]] for row in tree.breadcrumbs(pages).collect()}
    assert crumbs == {1: [], 2: [1], 3: [1, 2], 4: [1]}
    assert sorted(row["id"] for row in tree.descendants(pages, 2).collect()) == [3]
    assert [row["id"] for row in tree.parent_candidates(pages, 2).collect()] == [4, 1]
    proposals = spark.createDataFrame([(1, 3), (2, 2), (3, 99), (4, None), (3, 4)], "id long, new_parent_id long")
    errors = {(row["id"], row["new_parent_id"]): row["error"] for row in tree.parent_errors(pages, proposals).collect()}
    assert errors[(1, 3)] == "parent relationship would create a cycle" and errors[(2, 2)] == "a page cannot be its own parent"
    assert errors[(3, 99)] == "parent page not found" and errors[(4, None)] is None and errors[(3, 4)] is None


def test_deep_chain_and_circles(spark):
    """A chain far deeper than any recursion limit, and circles of one, two and three pages with tails."""
    rows = [page(number, f"P{number}", parent=number - 1 if number > 1 else None) for number in range(1, 301)]
    rows += [page(401, "Self", parent=401), page(402, "A", parent=403), page(403, "B", parent=402), page(404, "T", parent=402)]
    rows += [page(411, "X", parent=412), page(412, "Y", parent=413), page(413, "Z", parent=411), page(414, "Tail", parent=411), page(415, "Tail 2", parent=414)]
    pages = make(spark, rows)
    depth = {row["id"]: row["depth"] for row in tree.tree(pages, "all").collect()}
    assert depth == {number: number - 1 for number in range(1, 301)}
    parents = {row[0]: row[6] for row in rows}
    crumbs = {row["id"]: [item["id"] for item in row["breadcrumbs"]] for row in tree.breadcrumbs(pages).collect()}
    for number, parent in parents.items():
        seen, cursor = [], parent
        while cursor is not None and cursor not in seen:
            seen.append(cursor)
            cursor = parents.get(cursor)
        assert crumbs[number] == seen[::-1], number


def brute_positions(rows):
    """Depth, place and size by walking the trees of (id, parent, label); pages in circles are missing."""
    known = {key for key, _, _ in rows}
    below = {}
    for key, parent, label in rows:
        below.setdefault(parent if parent in known else None, []).append((label, key))
    out = {}

    def walk(key, root, depth, place):
        size = 1
        for _, child in sorted(below.get(key, [])):
            size += walk(child, root, depth + 1, place + size)
        out[key] = (root, depth, place, size)
        return size

    for _, root in below.get(None, []):
        walk(root, root, 0, 0)
    return out


def test_positions_against_walks(spark):
    chance = random.Random(6)
    rows = [(n, None if n < 5 else chance.choice([1, chance.randrange(n), n + 7, n - 1]), chance.choice("abc")) for n in range(300)]
    frame = spark.createDataFrame(rows, "id long, parent_id long, label string")
    found = tree.positions(frame).collect()
    wanted = brute_positions(rows)
    assert len(found) == 300 and {row.id for row in found if row.cyclic} == {key for key, _, _ in rows} - wanted.keys()
    assert {row.id: (row.root, row.depth, row.place, row["size"]) for row in found if not row.cyclic} == wanted
    assert tree.positions(frame.limit(0)).collect() == []


def test_stored_forest_and_descendants(spark, tmp_path):
    pages = make(spark, [page(n, f"P{n % 7}", parent=n // 3 if n else None) for n in range(120)] + [page(500, "A", parent=501), page(501, "B", parent=500), page(502, "C", parent=501), page(600, "Of a page that is gone", parent=777), page(601, "Below", parent=600)])
    tree.write_forest(pages, str(tmp_path / "forest"))
    known = spark.read.parquet(str(tmp_path / "forest"))
    for top in (0, 3, 119, 777, 500, 502):
        below, level = set(), {top}
        parents = {row.id: row.parent_id for row in pages.collect()}
        while level:
            level = {key for key, parent in parents.items() if parent in level} - below - {top}
            below |= level
        assert {row.id for row in tree.descendants(pages, top).collect()} == below == {row.id for row in tree.descendants(pages, top, known).collect()}
    errors = {row.id: row.error for row in tree.parent_errors(pages, spark.createDataFrame([(500, 502), (7, 502), (1, 80), (0, 2)], "id long, new_parent_id long")).collect()}
    assert errors == {500: "parent relationship would create a cycle", 7: "existing parent relationship contains a cycle", 1: None, 0: "parent relationship would create a cycle"}
    assert sorted(row.id for row in tree.in_circles(pages).collect()) == [500, 501]


def test_a_path_of_many_pages(spark):
    count = 100_000
    nodes = spark.range(count).selectExpr("id", "case when id > 0 then id - 1 end as parent_id", "'x' as label")
    rows = tree.positions(nodes)
    assert rows.filter("depth = id and place = id and root = 0 and not cyclic").filter(f"size = {count} - id").count() == count


def test_tag_aliases_merge(spark):
    pages = make(spark, [page(1, "Eel", tags=["fisch"]), page(2, "Cod", tags=["fisch", "topic:fish"])])
    rows = filters.tag_rows(pages)
    none = spark.createDataFrame([], "tag string, kind string, display_name string, description string, created_by string, created_at timestamp_ntz")
    aliases = spark.createDataFrame([("fishes", "fisch"), ("owned", "other")], "alias string, canonical_tag string")
    proposed = spark.createDataFrame([("topic:fish", "topic", " Fish ", None, ["FISCH", "pez"], "human"), ("topic:x", "topic", "", None, ["owned"], "human")], "tag string, kind string, display_name string, description string, aliases array<string>, created_by string")
    result = taxonomy.define_tags(none, aliases, rows, proposed, "2024-01-01 00:00:00")
    assert sorted((row["page_id"], row["tag"]) for row in result["page_tags"].collect()) == [(1, "topic:fish"), (2, "topic:fish")]
    assert [row["tag"] for row in result["refused"].collect()] == ["topic:x"]
    names = sorted((row["alias"], row["canonical_tag"]) for row in result["aliases"].collect())
    assert names == [("fisch", "topic:fish"), ("fishes", "topic:fish"), ("owned", "other"), ("pez", "topic:fish")]
    used = taxonomy.definition_usage(result["definitions"], result["page_tags"], result["aliases"]).first()
    assert used["usage_count"] == 2 and used["aliases"] == ["fisch", "fishes", "pez"] and used["display_name"] == "Fish"
    assert sorted(row["page_id"] for row in result["reindex"].collect()) == [1, 2]
    assert taxonomy.resolve_tags(["FISHES", "new"], result["aliases"]) == ["new", "topic:fish"]


def test_topics_from_a_reply(spark):
    reply = '<think>{boats} or fish?</think>Result:\n```json\n{"topics":[{"tag":"boats","displayName":"Boats  and ships","confidence":0.7},{"tag":"topic:fish","displayName":"Fish","confidence":0.9},{"tag":"topic:rope","displayName":"Rope","confidence":0.3}]}\n```'
    odd = '{"topics":[{"tag":7,"displayName":"n","confidence":0.9},{"tag":"Über  Öl","displayName":" ","confidence":1},{"tag":"b","displayName":"b","confidence":"0.9"},{"tag":"late","displayName":"late","confidence":0.9}]}'
    frame = spark.createDataFrame([(1, reply), (2, odd), (3, '{"topics": {}}'), (4, "{"), (5, "[1]"), (6, '{"topics": []}')], "id int, reply string")
    rows = {row["id"]: row for row in taxonomy.parse_topics(frame, "reply", ["id"]).collect()}
    assert [(item["tag"], item["display_name"], item["confidence"]) for item in rows[1]["topics"]] == [("topic:fish", "Fish", 0.9), ("topic:boats", "Boats and ships", 0.7)]
    assert [(item["tag"], item["display_name"]) for item in rows[2]["topics"]] == [("topic:uber-ol", "uber-ol")]
    errors = {number: row["error"] for number, row in rows.items()}
    assert errors[4] == "classification response is not valid JSON" and errors[3] == errors[5] == "classification response has no topics array" and rows[6]["topics"] == []


def test_orphan_topic_is_found_as_a_whole_phrase(spark):
    texts = spark.createDataFrame([(1, "Knots for small boats."), (2, "knotsmith"), (3, "a REEF, (tide tables)!"), (4, "tide-tables"), (5, None)], "id int, text string")
    definitions = spark.createDataFrame([("topic:knots", "topic", "Knots", ["reef"], 0), ("topic:tide-tables", "topic", "Tides", [], 0), ("topic:boats", "topic", "Boats", [], 3)], "tag string, kind string, display_name string, aliases array<string>, usage_count long")
    found = sorted((row["id"], row["tag"]) for row in taxonomy.orphan_topics(texts, definitions, "id", "text").collect())
    assert found == [(1, "topic:knots"), (3, "topic:knots"), (3, "topic:tide-tables")]


def test_no_orphan_topic_is_left_out(spark):
    names = [f"w{number:03d}" for number in range(150)]
    texts = spark.createDataFrame([(1, " ".join(names))], "id int, text string")
    definitions = spark.createDataFrame([(f"topic:{name}", "topic", name, [], 0) for name in names], "tag string, kind string, display_name string, aliases array<string>, usage_count long")
    assert taxonomy.orphan_topics(texts, definitions, "id", "text").count() == 150


def test_generated_tags_of_other_pages_stay(spark):
    rows = lambda values: spark.createDataFrame(values, "page_id long, tag string")
    stored = rows([(1, "own"), (1, "topic:old"), (2, "topic:old"), (2, "own")])
    topics = spark.createDataFrame([(1, "topic:new", 0.7, "New"), (1, "topic:gone", 0.9, "Gone"), (1, "own", 0.9, "Own")], "page_id long, tag string, confidence double, display_name string")
    known = spark.createDataFrame([("topic:gone", "topic", "G", None, "human", None)], "tag string, kind string, display_name string, description string, created_by string, created_at timestamp_ntz")
    applied = taxonomy.apply_generated_tags(stored, rows([(1, "topic:old"), (2, "topic:old")]), rows([(1, "topic:gone")]), topics, spark.createDataFrame([], "alias string, canonical_tag string"), known, "2024-01-01 00:00:00")
    assert sorted(map(tuple, applied["page_tags"].collect())) == [(1, "own"), (1, "topic:new"), (2, "own"), (2, "topic:old")]
    assert sorted((r.page_id, r.tag) for r in applied["generated"].collect()) == [(1, "topic:new"), (2, "topic:old")]
    assert sorted(r.tag for r in applied["definitions"].collect()) == ["own", "topic:gone", "topic:new"]
    assert [tuple(r) for r in applied["managed_tags"].collect()] == [(1, ["own", "topic:new"])]


def test_a_tag_that_people_took_away_stays_away(spark):
    rows = lambda values: spark.createDataFrame(values, "page_id long, tag string")
    edits = taxonomy.reconcile_edits(rows([(4, "topic:fish"), (5, "topic:fish")]), rows([(5, "topic:rope")]), rows([(4, "mine"), (5, "topic:fish"), (5, "topic:rope")]), spark.createDataFrame([(4,), (5,)], "page_id long"))
    assert [tuple(row) for row in edits["generated"].collect()] == [(5, "topic:fish")] and [tuple(row) for row in edits["suppressed"].collect()] == [(4, "topic:fish")]
    topics = spark.createDataFrame([(4, "topic:fish", 0.8)], "page_id long, tag string, confidence double")
    applied = taxonomy.apply_generated_tags(rows([(4, "mine")]), edits["generated"], edits["suppressed"], topics, spark.createDataFrame([], "alias string, canonical_tag string"))
    assert [row["tag"] for row in applied["page_tags"].filter("page_id = 4").collect()] == ["mine"]


def test_keyset_pages(spark):
    pages = make(spark, [page(number, f"P{number}") for number in range(1, 6)])
    rows, cursor = paging.take_keyset(paging.list_pages(pages, None, 2), 2)
    assert [row["id"] for row in rows] == [5, 4]
    rows, cursor = paging.take_keyset(paging.list_pages(pages, cursor, 2), 2)
    assert [row["id"] for row in rows] == [3, 2]
    rows, cursor = paging.take_keyset(paging.list_pages(pages, cursor, 2), 2)
    assert [row["id"] for row in rows] == [1] and cursor is None


@pytest.mark.parametrize("status", ["nonsense"])
def test_unknown_status_is_refused(spark, status):
    with pytest.raises(ValueError):
        filters.with_status(make(spark, [page(1, "A")]), status)
