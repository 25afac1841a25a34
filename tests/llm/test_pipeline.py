import hashlib
import os

import public_tokenizers
import tiktoken
from test_decontamination import brute as brute_hits
from test_dedup import brute_bytes
from test_ngram_join import brute as brute_components

import corpus_pipeline
from lorespark import session
from lorespark.llm import bpe_codec, language_id, ngram_join, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def small_corpus(spark):
    """Some documents of the smallest table, with copies, shared passages, benchmark passages and junk among them."""
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect() if len(r.text) < 2500][:90]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first().text
    long = max(rows, key=lambda row: len(row[1]))[1]
    more = [rows[3][1], rows[4][1] + " one more", rows[5][1] + "\n" + item, long[:700] + " é " + rows[6][1], rows[7][1] + " é" + long[:700], "12345 ... 678", None, ""]
    rows += [(10_000 + n, text, "en", "added", len(text or "")) for n, text in enumerate(more)]
    return folder, [*rows, (None, "a text without an id and with its own words", None, None, 43)]


def test_stages_against_brute_force(spark):
    folder, rows = small_corpus(spark)
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["identified", "deduplicated", "cut", "decontaminated", "tokenized"]

    known = stages["identified"](spark, docs, folder)
    assert known.columns == docs.columns
    model = language_id.fit(docs, docs.doc_id.isNotNull())
    kept = [row for row in rows if (lambda names, scores: names[0] != "und" and scores[0] >= 0.5)(*language_id.score_texts(model, [row[1] or ""]))]
    assert sorted(map(tuple, known.collect()), key=repr) == sorted(kept, key=repr)
    assert {10_005, 10_006, 10_007}.isdisjoint(row[0] for row in kept) and len(kept) > 85

    docs = spark.createDataFrame(kept, SCHEMA)
    found = stages["deduplicated"](spark, docs, folder)
    gone = {key for key, _, component in brute_components([row[:2] for row in kept], 5, 80) if key is not None and component != key}
    kept = [row for row in kept if row[0] not in gone]
    assert {10_000, 10_001} <= gone
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(kept, key=repr)

    docs = spark.createDataFrame(kept, SCHEMA)
    found = stages["cut"](spark, docs, folder)
    texts = {key: text.decode(errors="ignore") for key, _, _, _, text in brute_bytes([row[:2] for row in kept], 200, keep_first=True)}
    assert any(len(texts[row[0]]) < len(row[1]) for row in kept)
    kept = [(key, texts[key], lang, source, len(texts[key])) for key, _, lang, source, _ in kept]
    assert found.columns == docs.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(kept, key=repr)

    docs = spark.createDataFrame(kept, SCHEMA)
    found = stages["decontaminated"](spark, docs, folder)
    items = [(row.item_id, row.text) for row in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {key for key, _, words, _ in brute_hits([row[:2] for row in kept], items) if words}
    assert 10_002 in hit
    kept = [row for row in kept if row[0] not in hit]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(kept, key=repr)

    ranks = bpe_codec.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.BytePairCodec(ranks, "").ranks, special_tokens={})
    for row in stages["tokenized"](spark, spark.createDataFrame(kept, SCHEMA), folder).collect():
        text = next(one[1] for one in kept if one[0] == row.doc_id)
        ids = library.encode_ordinary(text)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables_pass_all_stages(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.collect() == []


def test_run_is_the_stages_one_after_the_other(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        docs = spark.createDataFrame(after.collect(), after.schema)
    wanted = sorted(map(tuple, docs.collect()))
    session.remove_written(spark)
    before = tables(spark)
    out = corpus_pipeline.run(spark, folder)
    # One table is left: what the last stage reads.
    assert len(tables(spark) - before) == 1
    assert sorted(map(tuple, out.collect())) == wanted and len(wanted) > 100
    session.remove_written(spark)
    assert tables(spark) == before


def tables(spark):
    """Written tables and checkpoints that hold anything."""
    folder = session.shared_folder(spark).removeprefix("file:")
    return {os.path.join(at, name) for at, names, _ in os.walk(folder) for name in names if name.startswith(("written-", "rdd-"))}


def most_python_steps(node, above=0):
    """Python steps of the plan of a frame that one task runs, at most; `above`: those between the node and the shuffle over it."""
    kind, children = node.nodeName(), node.children()
    if kind.startswith("AdaptiveSparkPlan"):
        return most_python_steps(node.executedPlan(), above)
    if kind.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage")):
        return max(above, most_python_steps(node.plan(), above if kind.startswith("Result") else 0))
    above = 0 if "Exchange" in kind else above + kind.startswith(("MapInArrow", "FlatMapGroupsInArrow"))
    return max([above, *(most_python_steps(children.apply(at), above) for at in range(children.size()))])


def test_a_task_holds_one_python_worker(spark, tmp_path):
    """Small sides would be broadcast, which leaves the steps before and after a join in one task; its second worker would stay."""
    _, rows = small_corpus(spark)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    frames = [suffix_dedup.shorten(docs), suffix_dedup.dedup(docs), substring_dedup.dedup(docs), ngram_join.link(docs)]

    plain = docs.selectExpr("doc_id AS _id", "text AS _text")
    sets = {row.id: (row.n, row.cls) for row in ngram_join.signatures(plain, 5, 10).filter("not is_counter").collect()}
    kind = "struct<n:bigint,cls:bigint>"
    pairs = spark.createDataFrame([(rows[4][0], 10_001, sets[rows[4][0]], sets[10_001])], f"rep_a long, rep_b long, a {kind}, b {kind}")
    frames.append(ngram_join.verified(pairs, plain, 5, 80))

    for frame in frames:
        assert len(frame.collect()) > 0
        assert most_python_steps(frame._jdf.queryExecution().executedPlan()) <= 1
    session.remove_written(spark)
