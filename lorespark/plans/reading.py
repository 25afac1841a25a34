"""Scans, lookups, filters and ordered pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations, cursors, mime, text
from ..model import SectionFilters
from ..operators import filters, graph, paging, scale
from ..sources.tables import read_spread, read_table
from .fixtures import SECTIONS, TIME, WIKI, archive_documents, document_versions, sections, text_of_time, wiki

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


SUMMARY = f"id, title, alias, array_to_string(tags, ',') AS tags, status, parent_id, {TIME.format('created_at')} AS created_at, {TIME.format('updated_at')} AS updated_at"


def summary(pages):
    return pages.select(
        "id", "title", "alias", F.array_join("tags", ",").alias("tags"), "status", "parent_id",
        text_of_time("created_at").alias("created_at"), text_of_time("updated_at").alias("updated_at"),
    )


@query("active_pages", f"WITH {WIKI} SELECT {SUMMARY} FROM wiki WHERE deleted_at IS NULL")
def active_pages(spark, folder):
    return summary(filters.active(wiki(spark, folder)).orderBy("id"))


@query("trash_pages", f"WITH {WIKI} SELECT id, title, deleted_alias, {TIME.format('deleted_at')} AS deleted_at FROM wiki WHERE deleted_at IS NOT NULL")
def trash_pages(spark, folder):
    return filters.deleted(wiki(spark, folder)).select("id", "title", "deleted_alias", text_of_time("deleted_at").alias("deleted_at")).orderBy("id")


@query("page_by_id", f"WITH {WIKI} SELECT {SUMMARY}, body FROM wiki WHERE deleted_at IS NULL AND id = 17")
def page_by_id(spark, folder):
    page = filters.page_by_id(wiki(spark, folder), 17)
    return page.select(*summary(page).columns[:3], F.array_join("tags", ",").alias("tags"), "status", "parent_id", text_of_time("created_at").alias("created_at"), text_of_time("updated_at").alias("updated_at"), "body")


@query("page_by_alias", f"WITH {WIKI} SELECT {SUMMARY} FROM wiki WHERE deleted_at IS NULL AND alias = 'doc-23'")
def page_by_alias(spark, folder):
    return summary(filters.page_by_alias(wiki(spark, folder), " Doc-23 "))


@query(
    "deleted_lookup",
    f"WITH {WIKI}, same AS (SELECT *, 'source-' || lower(replace(source, ' ', '-')) AS old_alias FROM wiki WHERE deleted_at IS NOT NULL) "
    "SELECT id, old_alias FROM same WHERE old_alias = 'source-src3' ORDER BY id DESC LIMIT 1",
)
def deleted_lookup(spark, folder):
    pages = wiki(spark, folder).withColumn("deleted_alias", F.concat(F.lit("source-"), F.substring(F.element_at("tags", 2), 8, 100)))
    return filters.deleted_by_alias(pages, "source-src3").select("id", F.col("deleted_alias").alias("old_alias"))


@query("status_filter", f"WITH {WIKI} SELECT id, status FROM wiki WHERE deleted_at IS NULL AND status = 'draft'")
def status_filter(spark, folder):
    return filters.with_status(filters.active(wiki(spark, folder)), "draft").select("id", "status")


@query("tag_and_filter", f"WITH {WIKI} SELECT id, title FROM wiki WHERE deleted_at IS NULL AND list_contains(tags, 'lang:en') AND list_contains(tags, 'source:src7')")
def tag_and_filter(spark, folder):
    return filters.with_all_tags(filters.active(wiki(spark, folder)), ["lang:en", " Source:SRC7"]).select("id", "title")


@query(
    "tag_and_filter_by_edges",
    f"WITH {WIKI}, page_tags AS (SELECT id AS page_id, unnest(tags) AS tag FROM wiki) SELECT id FROM wiki w WHERE EXISTS (SELECT 1 FROM page_tags t WHERE t.page_id = w.id AND t.tag = 'lang:fr') "
    "AND EXISTS (SELECT 1 FROM page_tags t WHERE t.page_id = w.id AND t.tag = 'source:src3')",
)
def tag_and_filter_by_edges(spark, folder):
    pages = wiki(spark, folder)
    return filters.with_all_tags_by_edges(pages.select("id"), filters.tag_rows(pages), ["lang:fr", "source:src3"])


@query(
    "property_filter",
    """SELECT event_id, user_id, event_type FROM events WHERE json_extract(props, '$.k')::VARCHAR = '42' AND event_type = 'click'""",
)
def property_filter(spark, folder):
    events = read_table(spark, folder, "events")
    pages = events.withColumn("properties", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("event_type"), F.concat(F.lit('"'), "event_type", F.lit('"')))))
    return filters.with_properties(pages, {"k": 42, "event_type": "click"}).select("event_id", "user_id", "event_type")


@query(
    "property_filter_by_rows",
    f"WITH {WIKI} SELECT id FROM wiki WHERE lang = 'de' AND n_chars = (SELECT max(n_chars) FROM wiki WHERE lang = 'de')",
)
def property_filter_by_rows(spark, folder):
    pages = wiki(spark, folder)
    rows = filters.property_rows(pages)
    longest = scale.one_row(pages.filter(F.array_contains("tags", "lang:de")).agg(F.max(F.col("properties")["chars"].cast("bigint")).alias("chars")))["chars"]
    wanted = rows.filter((F.col("key") == "lang") & (F.col("value_json") == '"de"')).join(
        rows.filter((F.col("key") == "chars") & (F.col("value_json").cast("bigint") == longest)).select("page_id"), "page_id", "left_semi"
    )
    return filters.with_properties_by_rows(pages.join(wanted.select(F.col("page_id").alias("id")), "id", "left_semi").select("id"), rows, {"lang": "de"})


@query(
    "property_rows",
    f"""WITH {WIKI} SELECT id AS page_id, 'chars' AS key, n_chars::VARCHAR AS value_json, n_chars::VARCHAR AS value_text FROM wiki
    UNION ALL SELECT id, 'lang', '"' || lang || '"', lang FROM wiki""",
)
def property_rows(spark, folder):
    return filters.property_rows(wiki(spark, folder))


@query(
    "facet_interval",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
)
def facet_interval(spark, folder):
    orders = read_table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    return filters.in_interval(orders, "o_orderdate", "1996-01-01 00:00:00", "1997-01-01 00:00:00").select("o_orderkey", "o_orderstatus")


def searchable(spark, folder):
    return filters.searchable_sections(sections(spark, folder), document_versions(spark, folder), archive_documents(spark, folder), wiki(spark, folder))


@query(
    "searchable_sections",
    f"WITH {WIKI}, {SECTIONS} SELECT section_id, document_id, ordinal, version, filename, format, kind, hidden, page_title, page_status FROM searchable",
)
def searchable_sections(spark, folder):
    return searchable(spark, folder).select("section_id", "document_id", "ordinal", "version", "filename", "format", "kind", "hidden", "page_title", "page_status")


@query(
    "section_facets",
    f"WITH {WIKI}, {SECTIONS} SELECT section_id, ordinal FROM searchable WHERE format = 'markdown' AND NOT hidden AND ocr_status = 'not_required' AND kind = 'heading' "
    "AND page_status = 'published' AND document_updated_at >= TIMESTAMP '2024-03-01 06:00:00' AND document_updated_at < TIMESTAMP '2024-03-05 00:00:00' AND list_contains(tags, 'lang:en')",
)
def section_facets(spark, folder):
    wanted = SectionFilters(format="markdown", hidden=False, ocr_status="not_required", kind="heading", updated_after="2024-03-01 06:00:00", updated_before="2024-03-05 00:00:00")
    return filters.with_facets(searchable(spark, folder), wanted, ["lang:en"], "published").select("section_id", "ordinal")


@query(
    "latest_version",
    "SELECT conv_id AS document_id, turn AS version, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
)
def latest_version(spark, folder):
    turns = read_spread(spark, folder, "conversations", "conv_id").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("version"), "role", "text")
    return filters.current_versions(turns)


@query("next_version", "SELECT conv_id AS document_id, max(turn) + 1 AS next_version, count(*) AS versions FROM conversations GROUP BY conv_id")
def next_version(spark, folder):
    turns = read_spread(spark, folder, "conversations", "conv_id")
    return turns.groupBy(F.col("conv_id").alias("document_id")).agg((F.max("turn") + 1).alias("next_version"), F.count("*").alias("versions"))


@query("keyset_page", f"WITH {WIKI} SELECT {SUMMARY}, replace(replace(rtrim(base64(encode(id::VARCHAR)), '='), '+', '-'), '/', '_') AS cursor FROM wiki WHERE deleted_at IS NULL AND status = 'published' AND id < 150 ORDER BY id DESC LIMIT 26")
def keyset_page(spark, folder):
    page = paging.list_pages(wiki(spark, folder), cursors.encode_id(150), 25)
    return summary(page).withColumn("cursor", cursors.id_cursor(F.col("id")))


@query("keyset_trash", f"WITH {WIKI} SELECT id, deleted_alias FROM wiki WHERE deleted_at IS NOT NULL ORDER BY id DESC LIMIT 11")
def keyset_trash(spark, folder):
    return paging.list_trash(wiki(spark, folder), None, 10).select("id", "deleted_alias")


@query("keyset_revisions", "SELECT event_id AS id, event_type FROM events WHERE user_id = 8 AND event_id < 9000 ORDER BY id DESC LIMIT 51")
def keyset_revisions(spark, folder):
    revisions = read_table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("page_id"), "event_type")
    return paging.list_revisions(revisions, 8, cursors.encode_id(9000)).select("id", "event_type")


@query("recent_pages", f"WITH {WIKI} SELECT id, {TIME.format('updated_at')} AS updated_at FROM wiki WHERE deleted_at IS NULL AND status = 'published' ORDER BY wiki.updated_at DESC, id DESC LIMIT 20")
def recent_pages(spark, folder):
    return paging.recent(wiki(spark, folder)).select("id", text_of_time("updated_at").alias("updated_at"))


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 21 OFFSET 40")
def offset_page(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return paging.offset_page(orders, cursors.encode_offset(40), 20, F.desc("o_totalprice"), "o_orderkey")


@query("section_page", "SELECT turn AS ordinal, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 4 OFFSET 2")
def section_page(spark, folder):
    turns = read_spread(spark, folder, "conversations", "conv_id").select(F.col("conv_id").alias("version_id"), F.col("turn").alias("ordinal"), "role", "text")
    return paging.section_page(turns, 3, 2, 3).select("ordinal", "role", "text")


@query("children_by_title", f"WITH {WIKI} SELECT id, title, status FROM wiki WHERE deleted_at IS NULL AND parent_id = 4")
def children_by_title(spark, folder):
    return graph.children(wiki(spark, folder), 4).select("id", "title", "status")


@query(
    "page_hydrate",
    f"""WITH {WIKI} SELECT w.id, w.title, w.alias, array_to_string(w.tags, ',') AS tags, w.status, w.body,
      (SELECT count(*) FROM wiki c WHERE c.parent_id = w.id AND c.deleted_at IS NULL) AS children,
      p.title AS parent_title FROM wiki w LEFT JOIN wiki p ON p.id = w.parent_id AND p.deleted_at IS NULL WHERE w.deleted_at IS NULL""",
)
def page_hydrate(spark, folder):
    pages = filters.active(wiki(spark, folder))
    counts = pages.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    parents = pages.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    joined = pages.join(counts, "id", "left").join(parents, "parent_id", "left")
    return joined.select("id", "title", "alias", F.array_join("tags", ",").alias("tags"), "status", "body", F.coalesce("children", F.lit(0)).alias("children"), "parent_title")


NAMES = """named AS (SELECT doc_id, lang,
  source || '-' || doc_id || CASE doc_id % 8 WHEN 0 THEN '.docx' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.pptx' WHEN 3 THEN '.Pdf' WHEN 4 THEN '.markdown' WHEN 5 THEN '.txt' WHEN 6 THEN '' ELSE '.bin' END AS filename,
  CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain; charset=utf-8' WHEN 2 THEN 'text/markdown' WHEN 3 THEN 'Image/PNG; q=1' ELSE 'not a type' END AS mime FROM documents)"""


def named_files(spark, folder):
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "lang", "source")
    endings = [".docx", ".XLSX", ".pptx", ".Pdf", ".markdown", ".txt", "", ".bin"]
    types = ["application/pdf", "text/plain; charset=utf-8", "text/markdown", "Image/PNG; q=1", "not a type"]
    pick = lambda values: F.element_at(F.array(*[F.lit(value) for value in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    return documents.select("doc_id", F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), pick(endings)).alias("filename"), pick(types).alias("mime"))


@query(
    "document_format",
    f"""WITH {NAMES}, found AS (SELECT doc_id, filename, mime, CASE
      WHEN filename ILIKE '%.docx' THEN 'docx' WHEN filename ILIKE '%.xlsx' THEN 'xlsx' WHEN filename ILIKE '%.pptx' THEN 'pptx'
      WHEN filename ILIKE '%.pdf' OR mime = 'application/pdf' THEN 'pdf'
      WHEN filename ILIKE '%.md' OR filename ILIKE '%.markdown' OR mime = 'text/markdown' THEN 'markdown'
      WHEN filename ILIKE '%.txt' OR mime LIKE 'text/plain%' THEN 'text' END AS format FROM named)
    SELECT doc_id, filename, format, CASE format WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
      WHEN 'xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 'pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation'
      WHEN 'pdf' THEN 'application/pdf' WHEN 'markdown' THEN 'text/markdown' WHEN 'text' THEN 'text/plain' END AS canonical_mime,
      CASE WHEN regexp_matches(lower(trim(string_split(mime, ';')[1])), '^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$') THEN lower(trim(string_split(mime, ';')[1])) ELSE 'application/octet-stream' END AS stored_mime FROM found""",
)
def document_format(spark, folder):
    found = named_files(spark, folder).withColumn("format", mime.document_format(F.col("filename"), F.col("mime")))
    return found.select("doc_id", "filename", "format", mime.canonical_mime(F.col("format")).alias("canonical_mime"), mime.normalize_mime(F.col("mime")).alias("stored_mime"))


@query(
    "name_and_path_checks",
    """SELECT page_id, CASE WHEN length(url) <= 255 AND NOT regexp_matches(url, '[\\\\/]') THEN url END AS filename,
      NOT regexp_matches(url, '^/') AND NOT list_contains(string_split(replace(url, '?', '/../'), '/'), '..') AS safe_path FROM pages""",
)
def name_and_path_checks(spark, folder):
    pages = read_spread(spark, folder, "pages", "page_id").select("page_id", "url")
    return pages.select(
        "page_id", mime.valid_filename(F.col("url")).alias("filename"), mime.safe_archive_path(F.replace("url", F.lit("?"), F.lit("/../"))).alias("safe_path")
    )


@query(
    "image_signature",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/bmp' WHEN 5 THEN 'image/avif' END AS image_mime FROM documents""",
)
def image_signature(spark, folder):
    heads = ["89504E470D0A1A0A", "FFD8FF", "474946383961", "524946460000000057454250", "424D", "000000206674797061766966", "25504446"]
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text")
    head = F.unhex(F.element_at(F.array(*[F.lit(value) for value in heads]), (F.col("doc_id") % len(heads) + 1).cast("int")))
    content = F.concat(head, F.encode(F.concat(F.lit("______"), F.col("text")), "UTF-8"))
    return documents.select("doc_id", mime.image_mime(content).alias("image_mime"))


@query(
    "excerpts",
    r"""WITH cleaned AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[`*_>#-]', ' ', 'g'), '\s+', ' ', 'g')) AS t, text FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 180 THEN substr(t, 1, 177) || '…' ELSE t END AS page_excerpt, substr(text, 1, 500) AS section_excerpt, substr(text, 1, 240) AS chunk_excerpt FROM cleaned""",
)
def excerpts(spark, folder):
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text")
    return documents.select(
        "doc_id", text.excerpt(F.col("text")).alias("page_excerpt"), F.substring("text", 1, 500).alias("section_excerpt"), F.substring("text", 1, 240).alias("chunk_excerpt")
    )


@query(
    "locators_and_citation_urls",
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Turn ' || turn ELSE 'page ' || (turn + 1) || ' · sheet ' || role || ' · ' || role END AS locator,
      '/documents/' || conv_id || '/content?offset=' || ((conv_id * 9 + turn) // 50) * 50 || '#section-' || (conv_id * 9 + turn) AS url FROM conversations""",
)
def locators(spark, folder):
    turns = read_spread(spark, folder, "conversations", "conv_id")
    shown = F.col("role") != "system"
    where = F.struct(
        F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("label"), F.when(shown, F.col("turn") + 1).cast("int").alias("page"), F.lit(None).cast("int").alias("slide"),
        F.when(shown, F.col("role")).alias("sheet"), F.lit(None).cast("string").alias("range"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("image"),
        F.when(shown, F.col("role")).alias("part"),
    )
    return turns.select("conv_id", "turn", citations.locator_text(where).alias("locator"), citations.section_url(F.col("conv_id"), F.col("conv_id") * 9 + F.col("turn")).alias("url"))


@query(
    "byte_sizes",
    """SELECT doc_id, CASE WHEN octet_length(encode(text)) < 1024 THEN octet_length(encode(text)) || ' B' ELSE printf('%.1f KiB', floor(octet_length(encode(text)) / 102.4 + 0.5) / 10) END AS size FROM documents""",
)
def byte_sizes(spark, folder):
    return read_spread(spark, folder, "documents", "doc_id").select("doc_id", text.byte_size_label(F.octet_length("text")).alias("size"))
