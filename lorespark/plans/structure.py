"""Links, tags and the page forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, graph, taxonomy, tree
from ..sources.tables import read_spread, read_table
from .fixtures import LINKS, TIME, WIKI, link_pages, order_links, text_of_time, wiki

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


STATES = f"""WITH {LINKS}, gone AS (SELECT deleted_alias, id, title FROM linkpages WHERE deleted_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY deleted_alias ORDER BY deleted_at DESC, id DESC) = 1)
    SELECT l.source_page_id, l.target_alias AS alias, coalesce(a.id, g.id) AS id, CASE WHEN a.id IS NOT NULL THEN a.title ELSE g.title END AS title,
      CASE WHEN a.id IS NOT NULL THEN 'active' WHEN g.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
    FROM links l LEFT JOIN linkpages a ON a.deleted_at IS NULL AND a.alias = l.target_alias LEFT JOIN gone g ON g.deleted_alias = l.target_alias"""


@query("link_state", STATES)
def link_state(spark, folder):
    return graph.link_states(order_links(spark, folder), link_pages(spark, folder))


@query("outgoing_links", f"SELECT * FROM ({STATES}) WHERE source_page_id = 1000000007")
def outgoing_links(spark, folder):
    return graph.outgoing_links(order_links(spark, folder), link_pages(spark, folder), 1_000_000_007)


BACKLINKS = "SELECT t.id AS page_id, s.id AS source_id, s.title AS source_title, s.alias AS source_alias FROM links l JOIN linkpages t ON t.alias = l.target_alias AND t.deleted_at IS NULL JOIN linkpages s ON s.id = l.source_page_id AND s.deleted_at IS NULL"


@query("backlinks", f"WITH {LINKS} {BACKLINKS}")
def backlinks(spark, folder):
    return graph.backlinks(order_links(spark, folder), link_pages(spark, folder))


@query("backlinks_count", f"WITH {LINKS}, b AS ({BACKLINKS}) SELECT page_id AS id, count(DISTINCT source_id) AS incoming_links FROM b GROUP BY page_id")
def backlinks_count(spark, folder):
    pages = link_pages(spark, folder)
    counts = graph.incoming_counts(order_links(spark, folder), pages)
    return filters.active(pages).join(counts, "alias").select("id", "incoming_links")


@query(
    "most_linked",
    f"""WITH {LINKS}, b AS ({BACKLINKS}), c AS (SELECT page_id, count(DISTINCT source_id) AS incoming_links FROM b GROUP BY page_id)
    SELECT id, title, incoming_links FROM linkpages p JOIN c ON c.page_id = p.id WHERE p.deleted_at IS NULL ORDER BY incoming_links DESC, updated_at DESC, lower(title), id LIMIT 10""",
)
def most_linked(spark, folder):
    return graph.explore(order_links(spark, folder), link_pages(spark, folder))["most_linked"].select("id", "title", "incoming_links")


@query(
    "unconnected",
    f"WITH {LINKS} SELECT id, alias FROM linkpages p WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM links l JOIN linkpages s ON s.id = l.source_page_id AND s.deleted_at IS NULL WHERE l.target_alias = p.alias)",
)
def unconnected(spark, folder):
    return graph.unconnected(order_links(spark, folder), link_pages(spark, folder)).select("id", "alias")


@query(
    "explore_unconnected_top",
    f"WITH {LINKS} SELECT id, title FROM linkpages p WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM links l JOIN linkpages s ON s.id = l.source_page_id AND s.deleted_at IS NULL WHERE l.target_alias = p.alias) ORDER BY updated_at DESC, lower(title), id LIMIT 10",
)
def explore_unconnected_top(spark, folder):
    return graph.explore(order_links(spark, folder), link_pages(spark, folder))["unconnected"].select("id", "title")


@query("explore_recent", f"WITH {WIKI} SELECT id, {TIME.format('updated_at')} AS updated_at FROM wiki WHERE deleted_at IS NULL ORDER BY wiki.updated_at DESC, id DESC LIMIT 15")
def explore_recent(spark, folder):
    pages = wiki(spark, folder)
    return graph.explore(graph.link_rows(pages), pages, 15)["recent"].select("id", text_of_time("updated_at").alias("updated_at"))


RELATED = f"""WITH {WIKI}, page_tags AS (SELECT id AS page_id, unnest(tags) AS tag FROM wiki),
    shared AS (SELECT o.page_id, count(*) AS shared_count, string_agg(o.tag, ',' ORDER BY o.tag) AS shared_tags FROM page_tags m JOIN page_tags o ON o.tag = m.tag WHERE m.page_id = 12 AND o.page_id <> 12 GROUP BY o.page_id)
    SELECT p.id, p.title, shared_count, shared_tags FROM shared s JOIN wiki p ON p.id = s.page_id WHERE p.deleted_at IS NULL ORDER BY shared_count DESC, updated_at DESC, lower(title), id LIMIT 30"""


@query("related_by_shared_tag", RELATED)
def related_by_shared_tag(spark, folder):
    found = graph.related(wiki(spark, folder), 12, 30)
    return found.select("id", "title", F.col("shared_count").cast("bigint").alias("shared_count"), F.array_join(F.array_sort("shared_tags"), ",").alias("shared_tags"))


@query("related_by_tag_rows", RELATED)
def related_by_tag_rows(spark, folder):
    pages = wiki(spark, folder)
    found = graph.related_by_edges(filters.tag_rows(pages), pages, 12, 30)
    return found.select("id", "title", "shared_count", F.array_join("shared_tags", ",").alias("shared_tags"))


@query("pages_for_tag", f"WITH {WIKI} SELECT id, title FROM wiki WHERE deleted_at IS NULL AND status = 'published' AND list_contains(tags, 'source:src5')")
def pages_for_tag(spark, folder):
    return graph.pages_for_tag(wiki(spark, folder), "Source:src5 ").select("id", "title")


CHAIN = "live AS (SELECT id, parent_id, title, alias, status FROM wiki WHERE deleted_at IS NULL)"


@query(
    "breadcrumbs",
    f"""WITH RECURSIVE {WIKI}, {CHAIN}, up AS (SELECT id, parent_id AS at_id, 1 AS n FROM live UNION ALL SELECT u.id, l.parent_id, n + 1 FROM up u JOIN live l ON l.id = u.at_id)
    SELECT l.id, coalesce(string_agg(p.id || ':' || p.title, ' > ' ORDER BY n DESC) FILTER (WHERE p.id IS NOT NULL), '') AS breadcrumbs FROM live l JOIN up u ON u.id = l.id LEFT JOIN live p ON p.id = u.at_id GROUP BY l.id""",
)
def breadcrumbs(spark, folder):
    walked = tree.breadcrumbs(wiki(spark, folder))
    steps = F.transform("breadcrumbs", lambda item: F.concat(item["id"].cast("string"), F.lit(":"), item["label"]))
    return walked.select("id", F.array_join(steps, " > ").alias("breadcrumbs"))


def tree_sql(shown: str) -> str:
    """Place and size come from paths here: lists of (title, id) sort in pre-order."""
    return f"""shown AS (SELECT id, parent_id, title, status FROM {shown}),
    walk AS (SELECT id, title, status, parent_id, 0 AS depth, id AS root_id, [{{'t': lower(title), 'i': id}}] AS path FROM shown s WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM shown)
      UNION ALL SELECT s.id, s.title, s.status, s.parent_id, depth + 1, w.root_id, list_append(w.path, {{'t': lower(s.title), 'i': s.id}}) FROM shown s JOIN walk w ON s.parent_id = w.id),
    sizes AS (SELECT i, count(*) AS size FROM (SELECT unnest(path).i AS i FROM walk) GROUP BY i)
    SELECT id, title, status, parent_id, CAST(depth AS BIGINT) AS depth, root_id, CAST(row_number() OVER (PARTITION BY root_id ORDER BY path) - 1 AS BIGINT) AS place, size FROM walk JOIN sizes ON i = id"""


def tree_rows(pages, status):
    return tree.tree(pages, status).select("id", "title", "status", "parent_id", "depth", "root_id", "place", "size")


@query("tree_preorder", f"WITH RECURSIVE {WIKI}, {tree_sql('(SELECT * FROM wiki WHERE deleted_at IS NULL)')}")
def tree_preorder(spark, folder):
    return tree_rows(wiki(spark, folder), "all")


@query("tree_published", f"WITH RECURSIVE {WIKI}, {tree_sql(chr(40) + 'SELECT * FROM wiki WHERE deleted_at IS NULL AND status = ' + chr(39) + 'published' + chr(39) + chr(41))}")
def tree_published(spark, folder):
    """A page below a draft becomes a root."""
    return tree_rows(wiki(spark, folder), "published")


GEOGRAPHY = """geo AS (SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, r_name AS title, 'published' AS status FROM region
    UNION ALL SELECT 1000 + n_nationkey, n_regionkey, n_name, 'published' FROM nation UNION ALL SELECT 1000000 + c_custkey, 1000 + c_nationkey, c_name, 'published' FROM customer)"""


def geography(spark, folder):
    """Regions, nations and customers as a forest of three levels."""
    none = F.lit(None)
    shape = lambda ident, parent, title: [
        ident.cast("bigint").alias("id"), parent.cast("bigint").alias("parent_id"), title.alias("title"), title.alias("alias"), F.lit("published").alias("status"), none.cast("timestamp_ntz").alias("deleted_at")
    ]
    regions = read_table(spark, folder, "region").select(*shape(F.col("r_regionkey"), none, F.col("r_name")))
    nations = read_table(spark, folder, "nation").select(*shape(F.col("n_nationkey") + 1000, F.col("n_regionkey"), F.col("n_name")))
    customers = read_table(spark, folder, "customer").select(*shape(F.col("c_custkey") + 1_000_000, F.col("c_nationkey") + 1000, F.col("c_name")))
    return regions.unionByName(nations).unionByName(customers)


@query("tree_of_places", f"WITH RECURSIVE {GEOGRAPHY}, {tree_sql('geo')}")
def tree_of_places(spark, folder):
    return tree_rows(geography(spark, folder), "all")


@query(
    "descendants",
    f"WITH RECURSIVE {GEOGRAPHY}, below AS (SELECT id FROM geo WHERE parent_id = 2 UNION ALL SELECT g.id FROM geo g JOIN below b ON g.parent_id = b.id) SELECT id FROM below",
)
def descendants(spark, folder):
    return tree.descendants(geography(spark, folder), 2)


@query(
    "parent_candidates",
    f"""WITH RECURSIVE {GEOGRAPHY}, below AS (SELECT id FROM geo WHERE id = 1003 UNION ALL SELECT g.id FROM geo g JOIN below b ON g.parent_id = b.id) SELECT id, title FROM geo WHERE id NOT IN (SELECT id FROM below)""",
)
def parent_candidates(spark, folder):
    return tree.parent_candidates(geography(spark, folder), 1003).select("id", "title")


@query(
    "parent_errors",
    f"""WITH RECURSIVE {WIKI}, {CHAIN}, proposals AS (SELECT id, CASE id % 4 WHEN 0 THEN id * 10 + 1 WHEN 1 THEN id WHEN 2 THEN id + 1 ELSE 5000000 + id END AS new_parent_id FROM live),
    up AS (SELECT id, new_parent_id AS at_id FROM proposals WHERE new_parent_id <> id UNION ALL SELECT u.id, l.parent_id FROM up u JOIN live l ON l.id = u.at_id WHERE u.at_id <> u.id)
    SELECT p.id, p.new_parent_id, CASE WHEN p.new_parent_id = p.id THEN 'a page cannot be its own parent' WHEN l.id IS NULL THEN 'parent page not found'
      WHEN EXISTS (SELECT 1 FROM up u WHERE u.id = p.id AND u.at_id = p.id) THEN 'parent relationship would create a cycle' END AS error FROM proposals p LEFT JOIN live l ON l.id = p.new_parent_id""",
)
def parent_errors(spark, folder):
    pages = wiki(spark, folder)
    ident = F.col("id")
    proposed = F.when(ident % 4 == 0, ident * 10 + 1).when(ident % 4 == 1, ident).when(ident % 4 == 2, ident + 1).otherwise(ident + 5_000_000)
    return tree.parent_errors(pages, filters.active(pages).select("id", proposed.alias("new_parent_id")))


@query("tag_counts", f"WITH {WIKI} SELECT tag, count(*) AS count FROM (SELECT unnest(tags) AS tag FROM wiki WHERE deleted_at IS NULL AND status = 'published') GROUP BY tag")
def tag_counts(spark, folder):
    return taxonomy.tag_counts(wiki(spark, folder))


def definitions(spark, folder):
    """Definitions from use, and one for every part type that nobody uses."""
    used = taxonomy.implicit_definitions(filters.tag_rows(wiki(spark, folder)))
    unused = read_table(spark, folder, "part").select(F.concat(F.lit("topic:"), F.lower("p_type")).alias("tag"), F.lit("topic").alias("kind"), F.col("p_type").alias("display_name")).distinct()
    return used.unionByName(unused)


def tag_aliases(spark, folder):
    """Each source is also known by its bare name."""
    tags = read_spread(spark, folder, "documents", "doc_id").select("source").distinct()
    return tags.select(F.col("source").alias("alias"), F.concat(F.lit("source:"), "source").alias("canonical_tag"))


@query(
    "tag_usage",
    f"""WITH {WIKI}, page_tags AS (SELECT id, unnest(tags) AS tag FROM wiki), defs AS (SELECT DISTINCT tag, CASE WHEN tag LIKE 'source:%' THEN 'source' ELSE 'custom' END AS kind FROM page_tags UNION ALL SELECT DISTINCT 'topic:' || lower(p_type), 'topic' FROM part)
    SELECT tag, kind, (SELECT count(*) FROM page_tags t WHERE t.tag = d.tag) AS usage_count, CASE WHEN kind = 'source' THEN substr(tag, 8) ELSE '' END AS aliases FROM defs d""",
)
def tag_usage(spark, folder):
    used = taxonomy.definition_usage(definitions(spark, folder), filters.tag_rows(wiki(spark, folder)), tag_aliases(spark, folder))
    return used.select("tag", "kind", "usage_count", F.array_join("aliases", ",").alias("aliases"))


@query(
    "tag_resolution",
    "SELECT DISTINCT doc_id AS page_id, 'source:' || source AS tag FROM documents UNION ALL SELECT doc_id, 'lang:' || lang FROM documents",
)
def tag_resolution(spark, folder):
    """Tag rows that use both the alias and the canonical tag come out once."""
    documents = read_spread(spark, folder, "documents", "doc_id")
    rows = documents.select(F.col("doc_id").alias("page_id"), F.explode(F.array(F.col("source"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang"))).alias("tag"))
    return taxonomy.resolve_tag_rows(rows, tag_aliases(spark, folder))


def proposed_tags(spark, folder):
    """Every part type as a topic with a brand as alias; types starting with S claim an alias of a source."""
    parts = read_table(spark, folder, "part").groupBy("p_type").agg(F.min("p_brand").alias("brand"))
    kind = F.lower("p_type")
    return parts.select(
        F.concat(F.lit("topic:"), kind).alias("tag"), F.lit("topic").alias("kind"), F.col("p_type").alias("display_name"), F.lit(None).cast("string").alias("description"),
        F.array(F.concat(kind, F.lit("-alias")), F.when(kind.startswith("s"), F.lit("src1")).otherwise(F.concat(F.lit("x-"), kind))).alias("aliases"), F.lit("human").alias("created_by"),
    )


@query(
    "define_tags",
    "SELECT DISTINCT 'topic:' || lower(p_type) AS tag, lower(p_type) LIKE 's%' AS refused, CASE WHEN lower(p_type) LIKE 's%' THEN '' ELSE lower(p_type) || '-alias,x-' || lower(p_type) END AS aliases FROM part",
)
def define_tags(spark, folder):
    proposed = proposed_tags(spark, folder)
    stored = definitions(spark, folder).select("tag", "kind", "display_name", F.lit(None).cast("string").alias("description"), F.lit("human").alias("created_by"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    result = taxonomy.define_tags(stored, tag_aliases(spark, folder), filters.tag_rows(wiki(spark, folder)), proposed, "2024-06-01 00:00:00")
    names = result["aliases"].groupBy(F.col("canonical_tag").alias("tag")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    refused = result["refused"].withColumn("refused", F.lit(True))
    joined = proposed.select("tag").join(names, "tag", "left").join(refused, "tag", "left")
    return joined.select("tag", F.coalesce("refused", F.lit(False)).alias("refused"), F.coalesce(F.array_join("aliases", ","), F.lit("")).alias("aliases"))


@query("delete_tag", f"WITH {WIKI} SELECT id, list_filter(tags, lambda t: t <> 'lang:es')[1] AS rest FROM wiki WHERE deleted_at IS NULL AND status = 'published' AND list_contains(tags, 'lang:es')")
def delete_tag(spark, folder):
    updates, _ = taxonomy.delete_tag(wiki(spark, folder), definitions(spark, folder), "Lang:ES")
    return updates.select("id", F.array_join("tags", ",").alias("rest"))


@query("implicit_definitions", f"WITH {WIKI} SELECT DISTINCT tag, CASE WHEN tag LIKE 'source:%' THEN 'source' ELSE 'custom' END AS kind FROM (SELECT unnest(tags) AS tag FROM wiki)")
def implicit_definitions(spark, folder):
    return taxonomy.implicit_definitions(filters.tag_rows(wiki(spark, folder))).select("tag", "kind")


GENERATED = """WITH human AS (SELECT DISTINCT doc_id AS page_id, 'lang:' || lang AS tag FROM documents), own AS (SELECT doc_id AS page_id, 'topic:' || source AS tag FROM documents WHERE n_chars % 5 = 0),
    old AS (SELECT doc_id AS page_id, 'topic:' || lang AS tag FROM documents WHERE n_chars % 4 < 3),
    topics AS (SELECT d.doc_id AS page_id, CASE WHEN p_brand = 'Brand#1' THEN 'topic:' || d.source ELSE 'topic:' || lower(p_type) END AS tag, (p_size % 40) / 40.0 AS confidence, 'topic:' || lower(p_type) AS proposed, p_type AS display_name
      FROM documents d JOIN part ON p_partkey = d.doc_id + 1 WHERE d.n_chars % 2 = 0),
    suppressed AS (SELECT page_id, tag FROM topics WHERE confidence < 0.2),
    fresh AS (SELECT page_id, tag, max(confidence) AS confidence FROM topics WHERE (page_id, tag) NOT IN (SELECT (page_id, tag) FROM suppressed) AND (page_id, tag) NOT IN (SELECT (page_id, tag) FROM own) GROUP BY ALL),
    rest AS (SELECT page_id, tag FROM old WHERE page_id NOT IN (SELECT page_id FROM topics) AND (page_id, tag) NOT IN (SELECT (page_id, tag) FROM fresh))"""


def generated_tags(spark, folder):
    """Part types proposed as topics for documents of even length; other pages keep what was generated."""
    documents = read_spread(spark, folder, "documents", "doc_id").select(F.col("doc_id").alias("page_id"), "lang", "source", "n_chars")
    named = lambda frame, column: frame.select("page_id", F.concat(F.lit("topic:"), column).alias("tag"))
    generated = named(documents.filter(F.col("n_chars") % 4 < 3), "lang")
    human = documents.select("page_id", F.concat(F.lit("lang:"), "lang").alias("tag")).unionByName(named(documents.filter(F.col("n_chars") % 5 == 0), "source"))
    parts = read_table(spark, folder, "part").select((F.col("p_partkey") - 1).alias("page_id"), "p_type", "p_brand", "p_size")
    joined = documents.filter(F.col("n_chars") % 2 == 0).join(parts, "page_id")
    aliased = F.when(F.col("p_brand") == "Brand#1", F.concat(F.lit("see-"), "source")).otherwise(F.concat(F.lit("topic:"), F.lower("p_type")))
    topics = joined.select("page_id", aliased.alias("tag"), ((F.col("p_size") % 40) / 40.0).alias("confidence"), F.col("p_type").alias("display_name"))
    aliases = documents.select(F.concat(F.lit("see-"), "source").alias("alias"), F.concat(F.lit("topic:"), "source").alias("canonical_tag")).distinct()
    suppressed = topics.filter(F.col("confidence") < 0.2).join(aliases, F.col("tag") == F.col("alias"), "left").select("page_id", F.coalesce("canonical_tag", "tag").alias("tag"))
    known = documents.select(F.concat(F.lit("topic:"), "lang").alias("tag"), F.lit("topic").alias("kind"), F.col("lang").alias("display_name")).distinct()
    known = known.select("*", F.lit(None).cast("string").alias("description"), F.lit("human").alias("created_by"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return taxonomy.apply_generated_tags(human.unionByName(generated), generated, suppressed, topics, aliases, known, "2024-06-01 00:00:00")


@query("apply_generated_tags", f"{GENERATED} SELECT page_id, tag FROM human UNION SELECT page_id, tag FROM own UNION SELECT page_id, tag FROM fresh UNION SELECT page_id, tag FROM rest")
def apply_generated_tags(spark, folder):
    return generated_tags(spark, folder)["page_tags"]


@query("generated_tags_after", f"{GENERATED} SELECT page_id, tag, confidence FROM fresh UNION ALL SELECT page_id, tag, NULL FROM rest")
def generated_tags_after(spark, folder):
    """All generated tags after the batch, those of untouched pages included."""
    return generated_tags(spark, folder)["generated"]


@query("generated_tag_definitions", f"{GENERATED} SELECT DISTINCT 'topic:' || lang AS tag, 'human' AS created_by FROM documents UNION ALL SELECT DISTINCT CASE WHEN tag <> proposed THEN 'see-' || substr(tag, 7) ELSE tag END, 'model' FROM topics")
def generated_tag_definitions(spark, folder):
    return generated_tags(spark, folder)["definitions"].select("tag", "created_by")


@query(
    "reconcile_tag_edits",
    """SELECT doc_id AS page_id, CASE WHEN n_chars % 3 = 0 OR lang <> 'en' THEN 'kept' ELSE 'suppressed' END AS state FROM documents WHERE n_chars % 2 = 0
    UNION ALL SELECT doc_id, 'kept' FROM documents WHERE n_chars % 2 = 1""",
)
def reconcile_tag_edits(spark, folder):
    """Every page has its source as a generated tag; pages of even length were edited, and those not in English kept it."""
    documents = read_spread(spark, folder, "documents", "doc_id").select(F.col("doc_id").alias("page_id"), "n_chars", "lang", "source")
    row = lambda frame: frame.select("page_id", F.concat(F.lit("topic:"), "source").alias("tag"))
    edited = documents.filter(F.col("n_chars") % 2 == 0)
    submitted = row(edited.filter((F.col("n_chars") % 3 == 0) | (F.col("lang") != "en")))
    result = taxonomy.reconcile_edits(row(documents), row(documents.filter((F.col("n_chars") % 6 == 0) & (F.col("lang") == "en"))), submitted, edited)
    return result["generated"].select("page_id", F.lit("kept").alias("state")).unionByName(result["suppressed"].select("page_id", F.lit("suppressed").alias("state")))
