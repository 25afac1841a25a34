import datetime
import random

import pytest
from pyspark.sql import functions as F

from lorespark.functions.text import slugify
from lorespark.model import PAGES, RequestError
from lorespark.operators import blobs, captures, documents, filters, history, lifecycle, queues, scale

T0 = datetime.datetime(2024, 1, 1)
NOW = "2024-05-01 00:00:00"


def page(number, title, alias, body="", tags=(), status="published", parent=None, properties=None, deleted=None, deleted_alias=None):
    return (number, title, alias, body, list(tags), status, parent, properties or {}, T0, T0, deleted, deleted_alias)


def make(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def one_by_one(proposals, taken):
    taken, result = set(taken), {}
    for number, base in sorted(proposals):
        alias, suffix = base, 2
        while alias in taken:
            alias, suffix = f"{base[:190]}-{suffix}", suffix + 1
        taken.add(alias)
        result[number] = alias
    return result


@pytest.mark.parametrize("seed", range(6))
def test_alias_batches_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "a-2", "a-3", "a-2-2", "b", "b-10", "page"]
    proposals = [(number, rng.choice(bases)) for number in range(40)]
    taken = rng.sample(["a", "a-2", "a-4", "a-7", "b-2", "b-3", "page", "page-02", "a-2-3", "zzz"], 5)
    frame = spark.createDataFrame(proposals, "id long, base string")
    result = {row["id"]: row["alias"] for row in lifecycle.assign_aliases(frame, spark.createDataFrame([(alias,) for alias in taken], "alias string")).collect()}
    assert len(set(result.values())) == len(result) and not set(result.values()) & set(taken)
    assert result == one_by_one(proposals, taken)


def test_create_suffixes_titles_and_refuses_taken_aliases(spark):
    pages = make(spark, [page(5, "Hello World", "hello-world")])
    inputs = spark.createDataFrame([(1, "Hello World", None, ["Wiki", "wiki"]), (2, "Hello World", None, []), (3, "Own", "hello-world", []), (4, "Own", "mine", []), (5, "Own", "mine", [])], "no long, title string, alias string, tags array<string>")
    created, refused = lifecycle.create_pages(pages, inputs, NOW)
    assert [(row["id"], row["alias"], row["tags"]) for row in created.orderBy("id").collect()] == [(6, "hello-world-2", ["wiki"]), (7, "hello-world-3", []), (8, "mine", [])]
    assert sorted((row["no"], row["error"]) for row in refused.collect()) == [(3, "alias already exists"), (5, "alias already exists")]
    imported, _ = lifecycle.create_pages(pages, inputs.filter("no in (3, 4)"), NOW, imported=True)
    assert [row["alias"] for row in imported.orderBy("id").collect()] == ["hello-world-2", "mine"]


def test_only_real_changes_leave_revisions(spark):
    pages = make(spark, [page(1, "Page", "page", "one", ["a"], properties={"v": "1"}, parent=2), page(2, "Parent", "parent")])
    same = spark.createDataFrame([(1, "one", ["a"])], "id long, body string, tags array<string>")
    after, revisions, _ = lifecycle.update_pages(pages, same, "cli", NOW)
    assert revisions.count() == 0 and after.filter("updated_at > '2024-02-01'").count() == 0
    change = spark.createDataFrame([(1, "two", ["b"], None, True)], "id long, body string, tags array<string>, parent_id long, set_parent boolean")
    after, revisions, _ = lifecycle.update_pages(pages, change, "cli", NOW)
    row = revisions.first()
    assert (row["body"], row["tags"], row["parent_id"], row["source"]) == ("one", ["a"], 2, "cli")
    updated = after.filter("id = 1").first()
    assert (updated["body"], updated["tags"], updated["parent_id"], updated["alias"]) == ("two", ["b"], None, "page")
    numbered = revisions.drop("new").withColumn("id", F.lit(9))
    compared = history.compare_revisions(numbered, after).first()
    assert compared["metadata_changed"] and compared["from"]["body"] == "one" and compared["to"]["body"] == "two"
    restored = history.restore_revisions(numbered, after.withColumn("alias", F.when(F.col("id") == 2, F.lit("page")).otherwise(F.lit("other")))).first()
    assert restored["alias_taken"] and restored["parent_id"] == 2


def test_updates_are_checked(spark):
    pages = make(spark, [page(1, "A", "a"), page(2, "B", "b", parent=1), page(3, "C", "c", parent=2), page(4, "D", "d"), page(5, "E", "e")])
    schema = "id long, alias string, title string, tags array<string>, parent_id long, set_parent boolean, suffix_alias boolean"
    batch = [(1, "moved", None, ["Old", "x"], None, False, None), (2, "a", None, None, None, False, None), (3, "d", None, None, None, False, None), (4, "free", None, None, 77, True, None), (5, "b", None, None, None, False, True)]
    after, revisions, refused = lifecycle.update_pages(pages, spark.createDataFrame(batch, schema), "cli", NOW, spark.createDataFrame([("old", "topic:new")], "alias string, canonical_tag string"))
    found = {row["id"]: (row["alias"], row["tags"]) for row in after.collect()}
    # 1 leaves its alias to 2; 4 is refused and keeps the alias that 3 wants; a number must be free before and after the batch.
    assert found == {1: ("moved", ["topic:new", "x"]), 2: ("a", []), 3: ("c", []), 4: ("d", []), 5: ("b-2", [])}
    assert {row["id"]: row["error"] for row in refused.collect()} == {3: "alias already exists", 4: "parent page not found"}
    circle = [(1, None, None, None, 3, True, None), (5, None, None, None, 5, True, None), (9, None, None, None, None, False, None), (4, None, " ", None, None, False, None)]
    _, _, refused = lifecycle.update_pages(pages, spark.createDataFrame(circle, schema), "cli", NOW)
    errors = {row["id"]: row["error"] for row in refused.collect()}
    assert errors == {1: "parent relationship would create a cycle", 5: "parent relationship would create a cycle", 9: "page not found", 4: "title must have 1 to 200 characters"}


def test_trash_cycle(spark):
    pages = make(spark, [page(1, "Disposable", "disposable"), page(2, "Other", "other")])
    chosen = spark.createDataFrame([(1,)], "id long")
    gone = lifecycle.delete_pages(pages, chosen, NOW)
    row = filters.deleted(gone).first()
    assert (row["alias"], row["deleted_alias"]) == ("deleted-page-1", "disposable")
    replaced = gone.unionByName(make(spark, [page(3, "Replacement", "disposable")]))
    back = lifecycle.restore_pages(replaced, chosen, NOW).filter("id = 1").first()
    assert back["alias"] == "disposable-2" and back["deleted_at"] is None
    left = lifecycle.purge_pages(gone, chosen, {"tags": (spark.createDataFrame([(1, "a"), (2, "b")], "page_id long, tag string"), "page_id")})
    assert [row["id"] for row in left["pages"].collect()] == [2] and [row["page_id"] for row in left["tags"].collect()] == [2]
    assert lifecycle.purge_pages(pages, chosen, {})["pages"].count() == 2  # a live page is not purged


def test_side_by_side():
    rows = history.side_by_side("same\nold\n", "same\nnew\nextra\n")
    assert [(row["left"], row["right"], row["left_kind"], row["right_kind"]) for row in rows] == [
        ("same", "same", "same", "same"), ("old", "new", "removed", "added"), (None, "extra", "blank", "added"),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_edit_scripts_are_shortest_and_rebuild_both_texts(seed):
    rng = random.Random(seed)
    for _ in range(300):
        before, after = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        script = history.edit_script(before, after)
        assert [line for kind, line in script if kind != "added"] == before
        assert [line for kind, line in script if kind != "removed"] == after
        table = [[0] * (len(after) + 1) for _ in range(len(before) + 1)]
        for i, left in enumerate(before):
            for j, right in enumerate(after):
                table[i + 1][j + 1] = table[i][j] + 1 if left == right else max(table[i][j + 1], table[i + 1][j])
        assert sum(kind == "same" for kind, _ in script) == table[-1][-1]


def test_a_missing_last_line_break_is_a_change():
    assert [(r["left"], r["right"], r["left_kind"]) for r in history.side_by_side("a", "a\n")] == [("a", "a", "removed")]
    assert history.side_by_side("", "") == [] and [r["left_kind"] for r in history.side_by_side("a\nb\n", "a\nb\n")] == ["same", "same"]


def test_long_bodies_without_a_common_line():
    before, after = [f"left {n}\n" for n in range(50_000)], [f"right {n}\n" for n in range(50_000)]
    script = history.edit_script([*before, "same\n"], [*after, "same\n"])
    assert len(script) == 100_001 and script[-1] == ("same", "same\n")


def test_body_diff_runs_on_rows(spark):
    frame = spark.createDataFrame([(1, "same\nold\n", "same\nnew\nextra\n"), (2, "", ""), (3, None, "x")], "id int, a string, b string")
    rows = history.body_diff(frame, "a", "b", ["id"]).orderBy("id", "line").collect()
    assert [(row["id"], row["line"], row["left"], row["right"]) for row in rows] == [(1, 0, "same", "same"), (1, 1, "old", "new"), (1, 2, None, "extra"), (3, 0, None, "x")]


def test_changes_of_one_hot_key(spark):
    """Most rows belong to one key and spread over many buckets."""
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.8 else rng.randint(2, 5), T0 + datetime.timedelta(hours=number * 3), number, rng.choice("ab")) for number in range(400)]
    frame = spark.createDataFrame(rows, "k int, at timestamp_ntz, n long, v string")
    got = sorted((row["k"], row["n"], row["prev_v"]) for row in history.changes_in_stream(frame, "k", ["at", "n"], ["v"], F.to_date("at")).collect())
    last, expected = {}, []
    for key, _, number, value in rows:
        if key in last and last[key] != value:
            expected.append((key, number, last[key]))
        last[key] = value
    assert got == sorted(expected)


def test_numbers_within_a_hot_key(spark):
    rows = [(0 if number % 3 else 1, number * 7) for number in range(500)]
    got = {(row["k"], row["o"]): row["number"] for row in scale.number_within(spark.createDataFrame(rows, "k int, o long"), "k", "o", span=100).collect()}
    for key in (0, 1):
        order = sorted(o for k, o in rows if k == key)
        assert [got[(key, o)] for o in order] == list(range(1, len(order) + 1))


def events(spark, rows):
    return spark.createDataFrame([(e, T0 + datetime.timedelta(seconds=s), n, kind, owner, revision) for n, (e, s, kind, owner, revision) in enumerate(rows)], "entity_id long, at timestamp_ntz, event_id long, kind string, owner string, revision long")


def test_queue_life(spark):
    log = events(spark, [
        (1, 0, "requested", None, None), (1, 10, "claimed", "w", None), (1, 20, "renewed", "w", None),
        (2, 0, "requested", None, None), (2, 5, "claimed", "w", None), (2, 6, "failed", "w", None), (2, 20, "claimed", "w", None), (2, 21, "failed", "w", None),
        (3, 0, "requested", None, None), (3, 1, "claimed", "w", None), (3, 2, "completed", "w", None),
        (4, 0, "requested", None, None), (4, 1, "claimed", "w", 1), (4, 2, "requested", None, None), (4, 3, "completed", "w", 1),
        (5, 0, "requested", None, None), (5, 1, "cancelled", None, None),
        (6, 0, "requested", None, None), (6, 1, "failed", "w", None), (6, 2, "failed", "w", None), (6, 3, "failed", "w", None),
    ])
    queue = {row["entity_id"]: row for row in queues.fold(log, 60, queues.JOB_POLICY).collect()}
    assert sorted(queue) == [1, 2, 4, 6]
    assert queue[1]["lease_owner"] == "w" and queue[1]["lease_until"] == T0 + datetime.timedelta(seconds=80)
    assert queue[2]["attempts"] == 2 and queue[2]["available_at"] == T0 + datetime.timedelta(seconds=25) and queue[2]["lease_owner"] is None
    assert queue[4]["revision"] == 2 and queue[4]["attempts"] == 0 and queue[4]["lease_owner"] is None  # a stale completion changes nothing
    folded = queues.fold(log, 60, queues.JOB_POLICY)
    assert sorted(row["entity_id"] for row in queues.claimable(folded, "2024-01-01 00:00:30", queues.JOB_POLICY).collect()) == [2, 4]
    assert sorted(row["entity_id"] for row in queues.claimable(folded, "2024-01-01 00:10:00", queues.VECTOR_POLICY).collect()) == [1, 2, 4, 6]
    assert [row["entity_id"] for row in queues.claim(folded, "2024-01-01 00:10:00", "me", queues.JOB_POLICY).collect()] == [1]
    doubled = queues.fold(log.unionByName(log).dropDuplicates(["event_id"]), 60, queues.JOB_POLICY)
    assert sorted(map(tuple, doubled.collect())) == sorted(map(tuple, folded.collect()))


def test_backoff(spark):
    frame = spark.createDataFrame([(n,) for n in range(1, 12)], "n long")
    jobs = [row["s"] for row in frame.select(queues.backoff_seconds(F.col("n"), queues.JOB_POLICY).alias("s")).collect()]
    vectors = [row["s"] for row in frame.select(queues.backoff_seconds(F.col("n"), queues.VECTOR_POLICY).alias("s")).collect()]
    assert jobs == [min(60, 2**n) for n in range(1, 12)] and vectors == [min(300, 2 ** min(n, 8)) for n in range(1, 12)]
    queue = spark.createDataFrame([(1, 0), (2, 2)], "entity_id long, attempts long")
    after = {row["entity_id"]: (row["attempts"], row["status"]) for row in queues.failure_states(queue, queues.JOB_POLICY, NOW).collect()}
    assert after == {1: (1, "queued"), 2: (3, "failed")}
    refused = queues.failure_states(queue, queues.JOB_POLICY, NOW, F.lit(False)).collect()
    assert all(row["attempts"] == 3 and row["status"] == "failed" for row in refused)


def test_index_configuration(spark):
    pages = spark.createDataFrame([(1,), (2,)], "id long")
    wanted = {"model": "m", "dimensions": 3}
    assert queues.requeue_for_config({"model": "m", "dimensions": 3}, wanted, pages, NOW) is None
    assert queues.requeue_for_config({"model": "m", "dimensions": 4}, wanted, pages, NOW).count() == 2
    with pytest.raises(RequestError):
        queues.check_interval(299)


def test_document_life(spark):
    files = spark.createDataFrame([(1, "notes.txt", "text/plain", bytearray(b"first")), (2, "a/b.txt", "", bytearray(b"x")), (3, "x.doc", "application/msword", bytearray(b"y"))], "no long, filename string, mime string, content binary")
    inputs, refused = documents.page_inputs(files)
    row = inputs.first()
    assert row["title"] == "notes" and row["tags"] == ["type:document", "type:text"] and row["properties"] == {"document.filename": '"notes.txt"', "document.format": '"text"'}
    assert sorted(item["no"] for item in refused.collect()) == [2, 3]
    pages, _ = lifecycle.create_pages(make(spark, []), inputs, NOW)
    placed = files.filter("no = 1").withColumn("page_id", F.lit(1).cast("long"))
    stored = documents.new_documents(placed, pages, NOW)
    assert stored["documents"].first()["status"] == "queued" and stored["versions"].first()["version"] == 1 and stored["jobs"].count() == 1
    edited = pages.withColumn("body", F.lit("Human-maintained summary"))
    new = spark.createDataFrame([(2, "notes-v2.txt", "text/plain", bytearray(b"second"))], "document_id long, filename string, mime string, content binary")
    after = documents.replace_documents(stored["documents"], stored["versions"], edited, new, NOW)
    assert after["documents"].first()["needs_review"] and after["documents"].first()["filename"] == "notes-v2.txt"
    assert [(row["version"], row["status"]) for row in after["versions"].orderBy("version").collect()] == [(1, "superseded"), (2, "queued")]
    done = spark.createDataFrame([(2, 2, "completed", False)], "document_id long, version int, ocr_status string, needs_ocr boolean")
    ready = documents.complete_documents(after["documents"], after["versions"], done, NOW)
    assert ready["documents"].first()["status"] == "ready" and [row["status"] for row in ready["versions"].orderBy("version").collect()] == ["superseded", "ready"]
    assert [tuple(row) for row in documents.tagging_targets(ready["documents"], ready["versions"], edited).collect()] == [(2, 2)]
    assert documents.hydrate_documents(ready["documents"], ready["versions"]).first()["version"] == 2
    calm = documents.acknowledge_reviews(ready["documents"], edited, ready["documents"].select("id"))
    assert not calm.first()["needs_review"] and calm.first()["managed_body"] == "Human-maintained summary"
    again = documents.replace_documents(calm, ready["versions"], edited, new, NOW)
    assert not again["documents"].first()["needs_review"]


def test_capture_life(spark):
    stored = spark.createDataFrame([(1, "https://a.org/", "ready", 600)], "id long, url string, status string, refresh_interval_seconds long").select("*", *[F.lit(None).cast("timestamp_ntz").alias(name) for name in ("last_checked_at", "fetched_at", "next_refresh_at")])
    urls = spark.createDataFrame([(1, "https://a.org/", None), (2, "https://b.org/x/", "topic:y"), (3, "https://b.org/x/", None)], "no long, url string, tag string")
    made = captures.create_captures(urls, stored, NOW)
    row = made["inputs"].first()
    assert row["title"] == "Web capture: b.org/x" and row["tags"] == ["source:web", "type:web-capture", "topic:y"]
    assert sorted(item["no"] for item in made["refused"].collect()) == [1, 3]
    outcome = spark.createDataFrame([(1, "unchanged")], "web_capture_id long, outcome string")
    after = captures.apply_fetches(stored, outcome, NOW).first()
    assert after["fetched_at"] is None and after["last_checked_at"] == datetime.datetime(2024, 5, 1) and after["next_refresh_at"] == datetime.datetime(2024, 5, 1, 0, 10)


def test_blobs(spark):
    files = spark.createDataFrame([(1, bytearray(b"same content"), "text/plain"), (2, bytearray(b"same content"), "text/plain"), (3, bytearray(b"\x89PNG\r\n\x1a\n"), "text/html")], "n int, content binary, mime string")
    fresh = blobs.new_blobs(files, spark.createDataFrame([], "sha256 string"))
    rows = sorted((row["mime_type"], row["copies"], row["inline_safe"]) for row in fresh.collect())
    assert rows == [("image/png", 1, True), ("text/plain", 2, False)]
    assert blobs.new_blobs(files, fresh).count() == 0
    assert blobs.orphan_blobs(fresh, fresh.limit(1), fresh.limit(0)).count() == 1


def test_research_requests(spark):
    assert captures.check_research("  topic ", 5) == "topic"
    for bad in (("", 5), ("x" * 4001, 5), ("x", 0), ("x", 101)):
        with pytest.raises(RequestError):
            captures.check_research(*bad)
    assert spark.range(1).select(captures.requested_urls(F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("c")), 2).alias("u")).first()["u"] == ["a", "b"]


def test_slug_collisions_from_titles(spark):
    frame = spark.createDataFrame([(n, "Untitled") for n in range(50)] + [(50, "Untitled 2")], "id long, title string").select("id", slugify(F.col("title")).alias("base"))
    result = {row["id"]: row["alias"] for row in lifecycle.assign_aliases(frame, spark.createDataFrame([], "alias string")).collect()}
    assert result[0] == "untitled" and result[1] == "untitled-2" and result[49] == "untitled-50" and result[50] == "untitled-2-2"


def test_a_long_chain_of_handed_over_aliases(spark):
    """Page n wants the alias of page n - 1; where one is refused, all that wait for it are."""
    count = 10_000
    pages = spark.range(1, count + 1).selectExpr("id", "concat('Page ', id) as title", "concat('page-', id) as alias", "'' as body", "cast(array() as array<string>) as tags", "'published' as status", "cast(null as bigint) as parent_id", "cast(map() as map<string,string>) as properties", "timestamp_ntz'2024-01-01' as created_at", "timestamp_ntz'2024-01-01' as updated_at", "cast(null as timestamp_ntz) as deleted_at", "cast(null as string) as deleted_alias")
    updates = spark.range(1, count + 1).selectExpr("id", "case when id = 1 then 'first' when id = 5000 then 'page-9999' else concat('page-', id - 1) end as alias")
    errors = {row.id: row.error for row in lifecycle.checked_updates(pages, updates).filter("error is not null").collect()}
    assert errors == {n: "alias already exists" for n in range(5000, count + 1)}


def test_bodies_stay_out_of_the_lookups(spark):
    """A restore moves each body once to its page, once with the updates and once with the pages: no join over aliases or parents has it."""
    pages = make(spark, [page(number, f"P{number}", f"p-{number}", f"body {number}", parent=number + 1 if number < 6 else None) for number in range(1, 8)])
    revisions = pages.select(F.col("id").alias("page_id"), "title", F.when(F.col("id") == 3, "p-4").otherwise(F.col("alias")).alias("alias"), F.concat(F.lit("old "), "body").alias("body"), "tags", "status", (F.col("id") + 3).alias("parent_id"), "properties")
    updates = history.restore_updates(revisions.filter("page_id <> 7"), pages)
    after, written, refused = lifecycle.update_pages(pages, updates, "rest", NOW)
    found = {row.id: (row.alias, row.body, row.parent_id) for row in after.collect()}
    assert found[3] == ("p-4-2", "old body 3", 6) and found[6] == ("p-6", "old body 6", None) and found[7] == ("p-7", "body 7", None)
    assert sorted((row.page_id, row.body, row.alias) for row in written.collect()) == [(number, f"body {number}", f"p-{number}") for number in range(1, 7)] and refused.isEmpty()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame, most in ((updates, 1), (after, 2), (written.select("page_id", "source"), 0)):
            assert _moving_bodies(frame) <= most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _moving_bodies(frame):
    """Exchanges of the plan whose rows hold a body."""
    found, open_nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while open_nodes:
        node = open_nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        found += node.nodeName() == "Exchange" and "body" in [node.output().apply(at).name() for at in range(node.output().size())]
        children = node.children()
        open_nodes += [children.apply(at) for at in range(children.size())]
    return found
