"""Full-text, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SectionFilters
from ..operators import evidence, filters, hybrid, lexical, vectors
from ..session import own_folder
from ..sources.tables import read_spread, read_table
from .fixtures import SECTIONS, WIKI, wiki
from .reading import searchable

QUERIES, ORACLE = {}, {}
WORDS = r"list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def bm25_sql(source: str, key: str, hits: list[str], length: str) -> str:
    """SQL text of the ranking: hit counts per phrase over a source of token lists."""
    names = [f"f{number}" for number in range(len(hits))]
    counted = ", ".join(f"{expression} AS {name}" for expression, name in zip(hits, names))
    containing = ", ".join(f"count(*) FILTER (WHERE {name} > 0) AS n{name}" for name in names)
    parts = " + ".join(
        f"(CASE WHEN ln((n - n{name} + 0.5) / (n{name} + 0.5)) > 0 THEN ln((n - n{name} + 0.5) / (n{name} + 0.5)) ELSE 1e-6 END) * ({name} * 2.2 / ({name} + 1.2 * (0.25 + 0.75 * length / average)))"
        for name in names
    )
    condition = " AND ".join(f"{name} > 0" for name in names)
    return f"""counted AS (SELECT *, {length} AS length, {counted} FROM {source}),
    corpus AS (SELECT count(*) AS n, avg(length) AS average, {containing} FROM counted),
    ranked AS (SELECT counted.*, -({parts}) AS score FROM counted, corpus WHERE {condition})"""


def prefix_hits(words: str, prefix: str) -> str:
    return f"len(list_filter({words}, lambda t: starts_with(t, '{prefix}')))"


BODY = f"words AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)"


def body_rows(spark, folder):
    return read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text")


@query(
    "tokenize",
    f"WITH {BODY} SELECT doc_id, len(w) AS tokens, len(list_distinct(w)) AS terms, md5(array_to_string(w, ' ')) AS digest FROM words",
)
def tokenize(spark, folder):
    from ..functions.text import tokens

    words = body_rows(spark, folder).select("doc_id", tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("terms"), F.md5(F.array_join("w", " ")).alias("digest"))


LEXICAL = f"WITH {BODY}, {bm25_sql('words', 'doc_id', [prefix_hits('w', 'the'), prefix_hits('w', 'on')], 'len(w)')} SELECT doc_id, round(score, 6) + 0.0 AS score FROM ranked ORDER BY ranked.score, doc_id DESC LIMIT 20"


@query("lexical_bm25_topk", LEXICAL)
def lexical_bm25_topk(spark, folder):
    ranked = lexical.scan_scores(body_rows(spark, folder), ["text"], "the ON", ["doc_id"])
    return ranked.orderBy("score", F.desc("doc_id")).limit(20).select("doc_id", (F.round("score", 6) + 0.0).alias("score"))


@query("bm25_from_postings", LEXICAL)
def bm25_from_postings(spark, folder):
    index = lexical.PostingsIndex.build(body_rows(spark, folder), ["text"], "doc_id")
    ranked = index.scores("the ON")
    return ranked.orderBy("score", F.desc("id")).limit(20).select(F.col("id").alias("doc_id"), (F.round("score", 6) + 0.0).alias("score"))


PHRASE = f"""WITH {BODY}, {bm25_sql('words', 'doc_id', ["len(list_filter(range(1, len(w)), lambda i: w[i] = 'de' AND starts_with(w[i + 1], 'la')))"], 'len(w)')}
    SELECT doc_id, f0 AS hits, round(score, 6) + 0.0 AS score FROM ranked"""


@query("phrase_search", PHRASE)
def phrase_search(spark, folder):
    """Every row that holds the two-token phrase, with its score."""
    ranked = lexical.scan_scores(body_rows(spark, folder), ["text"], "dé-LA", ["doc_id"])
    return ranked.select("doc_id", F.col("hits_0").cast("bigint").alias("hits"), (F.round("score", 6) + 0.0).alias("score"))


@query("phrase_from_postings", PHRASE)
def phrase_from_postings(spark, folder):
    index = lexical.PostingsIndex.build(body_rows(spark, folder), ["text"], "doc_id", positions=True)
    return index.scores("de-la").join(index.phrase_matches(["de", "la"]), "id").select(F.col("id").alias("doc_id"), "hits", (F.round("score", 6) + 0.0).alias("score"))


REWRITTEN = """now AS (SELECT doc_id, CASE WHEN lang = 'de' THEN coalesce(text, '') || ' On the ' || source WHEN lang = 'fr' THEN source ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src3' OR lang = 'es'),
    words AS (SELECT doc_id, """ + WORDS.format("coalesce(text, '')") + " AS w FROM now)"


@query("search_after_updates", f"WITH {REWRITTEN}, {bm25_sql('words', 'doc_id', [prefix_hits('w', 'the'), prefix_hits('w', 'on')], 'len(w)')} SELECT doc_id, round(score, 6) + 0.0 AS score FROM ranked")
def search_after_updates(spark, folder):
    """All matches in an index that took in all documents, then two languages rewritten, a source removed, and one language of it back."""
    rows = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text", "lang", "source")
    index = lexical.SegmentedIndex(spark, own_folder(spark), ["text"], "doc_id")
    index.update(rows, batch=0)
    rewritten = F.when(F.col("lang") == "de", F.concat(F.coalesce("text", F.lit("")), F.lit(" On the "), "source")).otherwise(F.col("source"))
    index.update(rows.filter(F.col("lang").isin("de", "fr")).withColumn("text", rewritten), batch=1)
    index.update(removed=rows.filter(F.col("source") == "src3"), batch=2)
    index.update(rows.filter((F.col("source") == "src3") & (F.col("lang") == "es")), batch=3)
    index.update(removed=rows, batch=3)  # a batch that has come before changes nothing
    return index.open().scores("the ON").select(F.col("id").alias("doc_id"), (F.round("score", 6) + 0.0).alias("score"))


PAGE_WORDS = f"""{WIKI}, rows AS (SELECT *, 'chars ' || n_chars || ' lang ' || lang AS properties_text, array_to_string(tags, ' ') AS tags_text FROM wiki WHERE deleted_at IS NULL),
    words AS (SELECT *, {WORDS.format('title')} AS w1, {WORDS.format('alias')} AS w2, {WORDS.format('body')} AS w3, {WORDS.format('tags_text')} AS w4, {WORDS.format('properties_text')} AS w5 FROM rows)"""
PAGE_LENGTH = " + ".join(f"len(w{number})" for number in range(1, 6))


def page_hits(prefix: str) -> str:
    return " + ".join(prefix_hits(f"w{number}", prefix) for number in range(1, 6))


@query(
    "search_pages",
    f"""WITH {PAGE_WORDS}, {bm25_sql('words', 'id', [page_hits('en'), page_hits('der')], PAGE_LENGTH)}
    SELECT id, title, status, round(score, 6) + 0.0 AS score FROM ranked WHERE status = 'published' AND list_contains(tags, 'lang:de') ORDER BY ranked.score, id DESC LIMIT 50""",
)
def search_pages(spark, folder):
    found = lexical.search_pages(wiki(spark, folder), "en der", ["lang:de"], limit=50)
    return found.select("id", "title", "status", (F.round("score", 6) + 0.0).alias("score"))


@query(
    "search_pages_without_words",
    f"WITH {WIKI} SELECT id, title FROM wiki WHERE deleted_at IS NULL AND status = 'published' AND list_contains(tags, 'lang:es') AND lang = 'es' ORDER BY updated_at DESC, id DESC LIMIT 30 OFFSET 10",
)
def search_pages_without_words(spark, folder):
    return lexical.search_pages(wiki(spark, folder), "", ["lang:es"], properties={"lang": "es"}, limit=30, offset=10).select("id", "title")


SECTION_WORDS = f"""{WIKI}, {SECTIONS}, words AS (SELECT *, {WORDS.format('filename')} AS w1, {WORDS.format('page_title')} AS w2, {WORDS.format('title')} AS w3,
    {WORDS.format('kind')} AS w4, {WORDS.format('locator_text')} AS w5, {WORDS.format('text')} AS w6 FROM searchable)"""


@query(
    "search_sections",
    f"""WITH {SECTION_WORDS}, {bm25_sql('words', 'section_id', [' + '.join(prefix_hits(f'w{n}', 'th') for n in range(1, 7))], ' + '.join(f'len(w{n})' for n in range(1, 7)))}
    SELECT section_id, document_id, filename, round(score, 6) + 0.0 AS score FROM ranked WHERE NOT hidden AND page_status = 'published' ORDER BY ranked.score, section_id DESC LIMIT 100""",
)
def search_sections(spark, folder):
    found = lexical.search_sections(searchable(spark, folder), "th", SectionFilters(hidden=False))
    return found.select("section_id", "document_id", "filename", (F.round("score", 6) + 0.0).alias("score"))


@query(
    "question_keywords",
    r"""WITH q AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]{3,}') AS w FROM benchmark),
    d AS (SELECT item_id, list_filter(w, lambda t, i: list_position(w, t) = i AND NOT list_contains(['and','are','como','con','cual','cuales','cuanto','cuantos','del','does','for','from','hay','how','las','los','para','por','que','the','una','what','when','where','which','who','why'], t)) AS w FROM q)
    SELECT item_id, i - 1 AS keyword_no, w[i] AS keyword FROM d, unnest(range(1, 13)) AS r(i) WHERE i <= len(w)""",
)
def question_keywords(spark, folder):
    keywords = lexical.question_keywords(read_table(spark, folder, "benchmark").select("item_id", "text"))
    return keywords.withColumn("keyword_no", F.col("keyword_no").cast("bigint"))


@query(
    "keyword_vote",
    rf"""WITH q AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]{{3,}}') AS w FROM benchmark),
    d AS (SELECT item_id, list_filter(w, lambda t, i: list_position(w, t) = i AND NOT list_contains(['and','are','como','con','cual','cuales','cuanto','cuantos','del','does','for','from','hay','how','las','los','para','por','que','the','una','what','when','where','which','who','why'], t)) AS w FROM q),
    k AS (SELECT item_id, i - 1 AS keyword_no, w[i] AS keyword FROM d, unnest(range(1, 13)) AS r(i) WHERE i <= len(w)),
    {BODY}, postings AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM words) GROUP BY ALL),
    lengths AS (SELECT doc_id, len(w) AS length FROM words), corpus AS (SELECT count(*) AS n, avg(length) AS average FROM lengths),
    vocabulary AS (SELECT DISTINCT t FROM postings), pairs AS (SELECT keyword, t FROM (SELECT DISTINCT keyword FROM k), vocabulary WHERE starts_with(t, keyword)),
    hits AS (SELECT keyword, doc_id, sum(tf) AS f FROM postings JOIN pairs USING (t) GROUP BY ALL),
    seen AS (SELECT keyword, count(*) AS c FROM hits GROUP BY keyword),
    scored AS (SELECT keyword, doc_id, round(-(CASE WHEN ln((n - c + 0.5) / (c + 0.5)) > 0 THEN ln((n - c + 0.5) / (c + 0.5)) ELSE 1e-6 END) * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / average))), 12) AS score
      FROM hits JOIN seen USING (keyword) JOIN lengths USING (doc_id), corpus),
    top AS (SELECT keyword, doc_id, row_number() OVER (PARTITION BY keyword ORDER BY score, doc_id DESC) AS rank FROM scored QUALIFY rank <= 10),
    votes AS (SELECT item_id, doc_id, count(*) AS votes, min(rank) - 1 AS best_rank, min(keyword_no * 100 + rank) AS first FROM k JOIN top USING (keyword) GROUP BY ALL)
    SELECT item_id, doc_id, votes, best_rank, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, best_rank, first) AS rank FROM votes QUALIFY rank <= 10""",
)
def keyword_vote(spark, folder):
    index = lexical.PostingsIndex.build(body_rows(spark, folder), ["text"], "doc_id")
    votes = lexical.keyword_vote(index, read_table(spark, folder, "benchmark"), "item_id", "text", 10)
    return votes.select("item_id", F.col("id").alias("doc_id"), "votes", F.col("best_rank").cast("bigint").alias("best_rank"), F.col("rank").cast("bigint").alias("rank"))


def query_vector(spark, folder):
    """The vector of the first chunk, as the vector of a question."""
    return list(read_table(spark, folder, "embeddings").filter(F.col("vec_id") == 0).select("embedding").first()["embedding"])


DISTANCE = "1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query("knn_cosine", f"SELECT vec_id, round({DISTANCE}, 6) + 0.0 AS distance FROM embeddings ORDER BY {DISTANCE}, vec_id LIMIT 100")
def knn_cosine(spark, folder):
    chunks = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    near = vectors.neighbours(chunks, query_vector(spark, folder), 100)
    return near.select(F.col("chunk_id").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance"))


def page_chunk_vectors(spark, folder):
    """Two consecutive vectors belong to one page."""
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 2).alias("page_id"), "embedding")


@query(
    "page_neighbours",
    f"""WITH {WIKI}, near AS (SELECT vec_id, vec_id // 2 AS page_id, {DISTANCE} AS d FROM embeddings WHERE vec_id // 2 IN (SELECT id FROM wiki WHERE deleted_at IS NULL AND status = 'published'))
    SELECT vec_id, page_id, round(d, 6) + 0.0 AS distance FROM near ORDER BY d, vec_id LIMIT 100""",
)
def page_neighbours(spark, folder):
    near = vectors.page_neighbours(page_chunk_vectors(spark, folder), wiki(spark, folder), query_vector(spark, folder))
    return near.select(F.col("chunk_id").alias("vec_id"), "page_id", (F.round("distance", 6) + 0.0).alias("distance"))


def section_chunk_vectors(spark, folder):
    """Vectors as chunks of turns: three consecutive vectors per conversation, the last two in one turn."""
    ident = F.col("vec_id")
    return read_table(spark, folder, "embeddings").select(
        ident.alias("chunk_id"), (F.floor(ident / 3) * 1000 + F.when(ident % 3 == 0, 0).otherwise(1)).alias("section_id"), "embedding"
    )


SECTION_NEAR = f"""snear AS (SELECT vec_id, s.section_id, s.page_id, {DISTANCE} AS d FROM embeddings e JOIN searchable s ON s.section_id = (e.vec_id // 3) * 1000 + CASE WHEN e.vec_id % 3 = 0 THEN 0 ELSE 1 END
    WHERE s.page_status = 'published' QUALIFY row_number() OVER (ORDER BY d, vec_id) <= 100),
    slist AS (SELECT 'd:' || section_id AS hit, page_id, min(r) AS rank FROM (SELECT section_id, page_id, row_number() OVER (ORDER BY d, vec_id) AS r FROM snear) GROUP BY ALL)"""


@query(
    "section_neighbours",
    f"WITH {WIKI}, {SECTIONS}, {SECTION_NEAR} SELECT vec_id, section_id, round(d, 6) + 0.0 AS distance FROM snear",
)
def section_neighbours(spark, folder):
    near = vectors.section_neighbours(section_chunk_vectors(spark, folder), searchable(spark, folder), query_vector(spark, folder))
    return near.select(F.col("chunk_id").alias("vec_id"), "section_id", (F.round("distance", 6) + 0.0).alias("distance"))


RRF = "fused AS (SELECT hit, page_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM lists GROUP BY ALL), shown AS (SELECT * FROM fused f WHERE NOT (hit LIKE 'p:%' AND page_id IN (SELECT page_id FROM fused WHERE hit LIKE 'd:%')))"
PAGE_LIST = f"""plist AS (SELECT 'p:' || id AS hit, id AS page_id, rank FROM (SELECT id, row_number() OVER (ORDER BY score, id DESC) AS rank FROM pranked WHERE status = 'published') WHERE rank <= 100)"""


def two_rankings(prefix: str) -> str:
    pages = bm25_sql("words", "id", [page_hits(prefix)], PAGE_LENGTH).replace("counted", "pcounted").replace("corpus", "pcorpus").replace("ranked", "pranked")
    parts = bm25_sql("swords", "section_id", [" + ".join(prefix_hits(f"w{n}", prefix) for n in range(1, 7))], " + ".join(f"len(w{n})" for n in range(1, 7)))
    swords = SECTION_WORDS.split("words AS", 1)[1]
    return f"""{PAGE_WORDS}, {SECTIONS}, swords AS{swords}, {pages}, {parts}, {PAGE_LIST},
    llist AS (SELECT 'd:' || section_id AS hit, page_id, rank FROM (SELECT section_id, page_id, row_number() OVER (ORDER BY score, section_id DESC) AS rank FROM ranked WHERE page_status = 'published') WHERE rank <= 100)"""


@query(
    "lexical_fusion",
    f"WITH {two_rankings('the')}, lists AS (SELECT * FROM plist UNION ALL SELECT * FROM llist), {RRF} SELECT hit, page_id, round(score, 9) AS score FROM shown",
)
def lexical_fusion(spark, folder):
    hits, _, _ = hybrid.search(wiki(spark, folder), searchable(spark, folder), "the")
    return hits.select("hit", "page_id", F.round("score", 9).alias("score"))


@query(
    "rrf_hybrid",
    f"""WITH {two_rankings('the')}, {SECTION_NEAR},
    pnear AS (SELECT page_id, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, vec_id // 2 AS page_id, {DISTANCE} AS d FROM embeddings WHERE vec_id // 2 IN (SELECT id FROM wiki WHERE deleted_at IS NULL AND status = 'published')) QUALIFY rank <= 100),
    vlist AS (SELECT 'p:' || page_id AS hit, page_id, rank FROM pnear),
    lists AS (SELECT * FROM plist UNION ALL SELECT * FROM llist UNION ALL SELECT * FROM vlist UNION ALL SELECT * FROM slist), {RRF} SELECT hit, page_id, round(score, 9) AS score FROM shown""",
)
def rrf_hybrid(spark, folder):
    hits, _, _ = hybrid.search(
        wiki(spark, folder), searchable(spark, folder), "the", vector=query_vector(spark, folder),
        page_chunks=page_chunk_vectors(spark, folder), section_chunks=section_chunk_vectors(spark, folder),
    )
    return hits.select("hit", "page_id", F.round("score", 9).alias("score"))


TWO_MODELS = "CASE WHEN label % 2 = 0 THEN 'small' ELSE 'large' END"


@query(
    "hybrid_of_one_model",
    f"""WITH {two_rankings('the')}, {SECTION_NEAR.replace("WHERE s.page_status", f"WHERE {TWO_MODELS.replace('label', 'e.label')} = 'small' AND s.page_status")},
    pnear AS (SELECT page_id, row_number() OVER (ORDER BY d, vec_id) AS rank FROM (SELECT vec_id, vec_id // 2 AS page_id, {DISTANCE} AS d FROM embeddings WHERE {TWO_MODELS} = 'small' AND vec_id // 2 IN (SELECT id FROM wiki WHERE deleted_at IS NULL AND status = 'published')) QUALIFY rank <= 100),
    vlist AS (SELECT 'p:' || page_id AS hit, page_id, rank FROM pnear),
    lists AS (SELECT * FROM plist UNION ALL SELECT * FROM llist UNION ALL SELECT * FROM vlist UNION ALL SELECT * FROM slist), {RRF} SELECT hit, page_id, round(score, 9) AS score FROM shown""",
)
def hybrid_of_one_model(spark, folder):
    """Vectors of two models in one table; the question's vector comes from one of them."""
    model = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("label") % 2 == 0, "small").otherwise("large").alias("model"))
    hits, _, _ = hybrid.search(
        wiki(spark, folder), searchable(spark, folder), "the", vector=query_vector(spark, folder), model="small",
        page_chunks=page_chunk_vectors(spark, folder).join(model, "chunk_id"), section_chunks=section_chunk_vectors(spark, folder).join(model, "chunk_id"),
    )
    return hits.select("hit", "page_id", F.round("score", 9).alias("score"))


@query(
    "post_filtered_vector_pages",
    f"""WITH {WIKI}, near AS (SELECT vec_id // 2 AS page_id, row_number() OVER (ORDER BY {DISTANCE}, vec_id) AS rank FROM embeddings
      WHERE vec_id // 2 IN (SELECT id FROM wiki WHERE deleted_at IS NULL AND status = 'published') QUALIFY rank <= 100)
    SELECT 'p:' || page_id AS hit, page_id, rank FROM near WHERE page_id IN (SELECT id FROM wiki WHERE list_contains(tags, 'lang:en'))""",
)
def post_filtered_vector_pages(spark, folder):
    """Tags are checked after the top hundred; ranks keep the gaps."""
    lists = hybrid.vector_lists(page_chunk_vectors(spark, folder), None, wiki(spark, folder), None, query_vector(spark, folder), ["lang:en"], "published", {}, SectionFilters(source="pages"))
    return lists[0].withColumn("rank", F.col("rank").cast("bigint"))


EVIDENCE = """hits AS (SELECT conv_id, turn, substr(CASE WHEN turn % 4 = 2 THEN '   ' ELSE text END, 1, 400) AS c FROM conversations),
    kept AS (SELECT *, row_number() OVER w AS number, coalesce(sum(length(c)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
      FROM hits WHERE trim(c) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(
    "evidence_budget",
    f"WITH {EVIDENCE} SELECT conv_id, 'E' || number AS evidence_id, substr(c, 1, (900 - used)::BIGINT) AS content FROM kept WHERE number <= 4 AND used < 900",
)
def evidence_budget(spark, folder):
    hits = read_spread(spark, folder, "conversations", "conv_id").select("conv_id", "turn", F.when(F.col("turn") % 4 == 2, F.lit("   ")).otherwise(F.col("text")).alias("text"))
    return evidence.build_evidence(hits, "conv_id", "turn", "text", 4, 400, 900).select("conv_id", "evidence_id", "content")


@query(
    "evidence_for_prompt",
    f"""WITH {EVIDENCE}, e AS (SELECT conv_id, number, substr(c, 1, (900 - used)::BIGINT) AS content FROM kept WHERE number <= 4 AND used < 900)
    SELECT conv_id, 'E' || number AS evidence_id FROM (SELECT *, sum(length(content)) OVER (PARTITION BY conv_id ORDER BY number) AS total FROM e) WHERE total + 200 <= 800""",
)
def evidence_for_prompt(spark, folder):
    hits = read_spread(spark, folder, "conversations", "conv_id").select("conv_id", "turn", F.when(F.col("turn") % 4 == 2, F.lit("   ")).otherwise(F.col("text")).alias("text"))
    built = evidence.build_evidence(hits, "conv_id", "turn", "text", 4, 400, 900)
    return evidence.trim_to_prompt(built, "conv_id", F.lit(200), 800).select("conv_id", "evidence_id")
