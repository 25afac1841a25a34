"""Text conversion: web pages, Markdown, chunks, links, names, addresses, files."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from ..functions import html, mime, text, urls
from ..operators import chunks, graph
from ..session import own_folder
from ..sources import files, frontmatter, tables, transfer
from ..sources.tables import read_spread, read_table
from .fixtures import TIME, WIKI, text_of_time, wiki

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def captured(spark, folder):
    return read_spread(spark, folder, "pages", "page_id")


# Character references: known names first, unknown names to a blank, the ampersand last.
def entities(expression: str) -> str:
    text_sql = expression
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " ")):
        text_sql = f"replace({text_sql}, '&{name};', '{value}')"
    text_sql = f"replace(regexp_replace(replace({text_sql}, '&amp;', chr(1)), '&[a-zA-Z]+;', ' ', 'g'), chr(1), '&')"
    return rf"regexp_replace(replace({text_sql}, chr(13), ''), '[\t ]+', ' ', 'g')"


HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1))"
TITLE_INNER = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)"
TITLE = rf"substr(trim(regexp_replace({entities(TITLE_INNER)}, '\s+', ' ', 'g')), 1, 200)"


def markdown_sql(source: str) -> str:
    removed = source
    for element in ("script", "style", "noscript", "svg", "canvas", "template", "form", "nav", "header", "footer", "aside"):
        removed = rf"regexp_replace({removed}, '(?is)<{element}\b[^>]*>.*?</{element}\s*>', chr(10), 'g')"
    steps = [
        (r"(?i)<img\b[^>]*>", "chr(10)"), (r"(?i)<h1\b[^>]*>", "chr(10) || '# '"), (r"(?i)<h2\b[^>]*>", "chr(10) || '## '"), (r"(?i)<h[3-6]\b[^>]*>", "chr(10) || '### '"),
        (r"(?i)<li\b[^>]*>", "chr(10) || '- '"),
        (r"(?i)</?(?:p|div|section|article|main|figure|figcaption|br|tr|blockquote|pre|table|ul|ol|h[1-6])\b[^>]*>", "chr(10)"), (r"<[^>]+>", "' '"),
    ]
    for pattern, replacement in steps:
        removed = f"regexp_replace({removed}, '{pattern}', {replacement}, 'g')"
    clean = rf"trim(regexp_replace(regexp_replace({entities(removed)}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"
    return f"'# ' || {TITLE} || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || {clean}"


@query("html_title", f"SELECT page_id, {TITLE} AS title FROM pages")
def html_title(spark, folder):
    return captured(spark, folder).select("page_id", html.html_title(F.col("html"), F.col("url")).alias("title"))


@query("html_to_markdown", f"SELECT page_id, {markdown_sql('html')} AS markdown FROM pages")
def html_to_markdown(spark, folder):
    return captured(spark, folder).select("page_id", html.html_to_markdown(F.col("html"), F.col("url")).alias("markdown"))


@query("entity_decode", f"SELECT page_id, {entities('html')} AS decoded FROM pages")
def entity_decode(spark, folder):
    return captured(spark, folder).select("page_id", text.clean_text(F.col("html")).alias("decoded"))


@query(
    "numeric_entities",
    "SELECT doc_id, list_reduce(list_transform(string_split(text, ''), lambda c: c), lambda a, b: a || b) AS decoded FROM documents",
)
def numeric_entities(spark, folder):
    """Every character above ASCII is written as a reference and read back."""
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text")
    letters = F.split("text", "")
    encoded = F.array_join(F.transform(letters, lambda letter: F.when(F.ascii(letter) > 127, F.concat(F.lit("&#x"), F.hex(F.ascii(letter)), F.lit(";"))).when(letter == "&", F.lit("&#38;")).otherwise(letter)), "")
    return documents.select("doc_id", text.decode_entities(encoded).alias("decoded"))


IMAGES = r"""images AS (SELECT page_id, url, m.i AS position, m.target AS target, m.label AS label FROM (
    SELECT page_id, url, unnest(list_transform(range(1, len(targets) + 1), lambda i: {'i': i, 'target': replace(replace(url_encode(targets[i]), '%2F', '/'), '%2C', ','), 'label': labels[i]})) AS m FROM (
      SELECT page_id, url, regexp_extract_all(h, '<a href="([^"]*)">([^<]*)</a>', 1) AS targets, regexp_extract_all(h, '<a href="([^"]*)">([^<]*)</a>', 2) AS labels FROM (
        SELECT page_id, url, regexp_replace(html, '(?is)<footer\b.*?</footer>', '', 'g') AS h FROM pages))))"""


@query(
    "image_references",
    rf"""WITH {IMAGES} SELECT page_id, position - 1 AS ordinal, regexp_extract(url, '^(https?://[^/?#]+)', 1) || target AS source_url,
      substr(trim(regexp_replace({entities('label')}, '\s+', ' ', 'g')), 1, 500) AS alt FROM images""",
)
def image_references(spark, folder):
    """Navigation links rewritten as lazily loaded images, then read back."""
    rewritten = F.regexp_replace(F.regexp_replace("html", "(?i)</?nav>", ""), r'<a href="([^"]*)">([^<]*)</a>', '<img class="lazy" src="data:image/gif;base64,AA" data-src="$1" alt="$2">')
    pages = captured(spark, folder).withColumn("html", rewritten)
    images = pages.select("page_id", F.inline(html.image_references(F.col("html"), F.col("url"))))
    return images.withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(
    "image_placement",
    rf"""WITH {IMAGES}, listed AS (SELECT page_id, position, '![' || substr(trim(regexp_replace({entities('label')}, '\s+', ' ', 'g')), 1, 500) || '](/web-assets/' || sha256(target) || '/picture.png)' AS image FROM images)
    SELECT page_id, string_agg(image, ' ' ORDER BY position) AS images FROM listed GROUP BY page_id""",
)
def image_placement(spark, folder):
    """Image markers of every page replaced by content addresses, in one fold over the page's images."""
    rewritten = F.regexp_replace(F.regexp_replace("html", "(?i)</?nav>", ""), r'<a href="([^"]*)">([^<]*)</a>', '<img data-src="$1" alt="$2">')
    pages = captured(spark, folder).withColumn("html", rewritten)
    prepared = pages.select("page_id", html.html_to_markdown(F.col("html"), F.col("url")).alias("markdown"), html.image_references(F.col("html"), F.col("url")).alias("images"))
    path = lambda item: F.regexp_extract(item["source_url"], "^https?://[^/]+(.*)$", 1)
    placed = F.aggregate(
        "images", F.col("markdown"), lambda markdown, item: html.place_image(markdown, item["alt"], html.image_marker(item["ordinal"]), text.sha256_hex(path(item)), F.lit("picture.png"))
    )
    found = F.regexp_extract_all(placed, F.lit(r"!\[[^\]]*\]\(/web-assets/[^)]*\)"), F.lit(0))
    return prepared.select("page_id", F.array_join(found, " ").alias("images"))


# Most images a capture keeps; a fixed value of these two twins.
KEPT = 3
LABEL = r"trim(regexp_replace(" + entities("labels[i]") + r", '\s+', ' ', 'g'))"
CAPTURED = rf"""cleaned AS (SELECT page_id, url, html AS whole, regexp_replace(regexp_replace(html, '(?i)</?nav>', '', 'g'), '(?is)<footer\b.*?</footer>', chr(10), 'g') AS h FROM pages),
    cut AS (SELECT *, string_split_regex(h, '<a href="[^"]*">[^<]*</a>') AS pieces, regexp_extract_all(h, '<a href="([^"]*)">([^<]*)</a>', 1) AS targets, regexp_extract_all(h, '<a href="([^"]*)">([^<]*)</a>', 2) AS labels FROM cleaned),
    filled AS (SELECT page_id, url, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || CASE WHEN i > len(targets) THEN ''
        WHEN i <= {KEPT} THEN chr(10) || chr(10) || '![' || {LABEL} || '](/web-assets/' || sha256(regexp_extract(url, '^(https?://[^/?#]+)', 1) || replace(replace(url_encode(targets[i]), '%2F', '/'), '%2C', ',')) || '/picture.png)' || chr(10) || chr(10)
        WHEN {LABEL} = '' THEN chr(10) || chr(10) ELSE chr(10) || chr(10) || '*Image unavailable: ' || {LABEL} || '*' || chr(10) || chr(10) END), '') AS html FROM cut)"""


@query("capture_images", f"WITH {CAPTURED} SELECT page_id, {markdown_sql('html')} AS markdown FROM filled")
def capture_images(spark, folder):
    """Whole captured texts: the first images point to their stored copies, a note stands for each further one."""
    rewritten = F.regexp_replace(F.regexp_replace("html", "(?i)</?nav>", ""), r'<a href="([^"]*)">([^<]*)</a>', '<img data-src="$1" alt="$2">')
    pages = captured(spark, folder).withColumn("html", rewritten)
    prepared = pages.select("page_id", html.html_to_markdown(F.col("html"), F.col("url")).alias("markdown"), html.image_references(F.col("html"), F.col("url")).alias("images"))
    return prepared.select("page_id", html.settle_images(F.col("markdown"), F.col("images"), lambda item: F.when(item["ordinal"] < KEPT, text.sha256_hex(item["source_url"])), lambda item: F.lit("picture.png")).alias("markdown"))


LINKED = r"""linked AS (SELECT page_id, regexp_replace(html, '<a href="/([^"]*)">([^<]*)</a>', '[[\1|\2]]', 'g') AS body FROM pages),
    targets AS (SELECT page_id, list_transform(regexp_extract_all(body, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1), lambda t: lower(trim(t))) AS t FROM linked),
    kept AS (SELECT page_id, list_filter(t, lambda a: regexp_full_match(a, '[a-z0-9]+(-[a-z0-9]+)*')) AS t FROM targets)"""


def linked_pages(spark, folder):
    return captured(spark, folder).select(F.col("page_id").alias("id"), F.regexp_replace("html", r'<a href="/([^"]*)">([^<]*)</a>', "[[$1|$2]]").alias("body"))


@query("wiki_links", f"WITH {LINKED} SELECT DISTINCT page_id AS source_page_id, a AS target_alias FROM kept, unnest(t) AS u(a)")
def wiki_links(spark, folder):
    return graph.link_rows(linked_pages(spark, folder))


@query(
    "linked_excerpts",
    rf"""WITH {LINKED}, plain AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\[\[([^\]|]+)\|([^\]]+)\]\]', '\2', 'g'), '\[\[([^\]|]+)\]\]', '\1', 'g'), '[`*_>#-]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM linked)
    SELECT page_id AS id, CASE WHEN length(t) > 180 THEN substr(t, 1, 177) || '…' ELSE t END AS excerpt FROM plain""",
)
def linked_excerpts(spark, folder):
    return linked_pages(spark, folder).select("id", text.excerpt(F.col("body")).alias("excerpt"))


@query(
    "slugify",
    rf"""SELECT id, CASE WHEN s = '' THEN 'page' ELSE s END AS slug FROM (SELECT id, rtrim(substr(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 180), '-') AS s FROM (SELECT doc_id AS id, text FROM documents))""",
)
def slugify(spark, folder):
    """Slugs of whole texts."""
    return read_spread(spark, folder, "documents", "doc_id").select(F.col("doc_id").alias("id"), text.slugify(F.col("text")).alias("slug"))


@query(
    "normalize_tags",
    r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda t: lower(trim(t, ' ' || chr(10)))), lambda t: t <> ''))), '|') AS tags FROM documents""",
)
def normalize_tags(spark, folder):
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text")
    return documents.select("doc_id", F.array_join(text.normalize_tags(F.split("text", " ")), "|").alias("tags"))


@query(
    "valid_aliases",
    rf"""SELECT id, md5(a) AS alias, regexp_full_match(a, '[a-z0-9]+(-[a-z0-9]+)*') AND length(a) <= 200 AS valid FROM (SELECT doc_id AS id, lower(trim(replace(replace(replace(replace(text, chr(10), '-'), ' ', '-'), '.', ''), ',', ''))) AS a FROM documents)""",
)
def valid_aliases(spark, folder):
    """Whole texts as aliases: words joined by hyphens, without stops."""
    alias = text.normalize_alias(F.concat(F.lit("\t "), F.translate("text", " \n.,", "--"), F.lit(" \n")))
    rows = read_spread(spark, folder, "documents", "doc_id").select(F.col("doc_id").alias("id"), alias.alias("alias"))
    return rows.select("id", F.md5("alias").alias("alias"), text.is_valid_alias(F.col("alias")).alias("valid"))


PARAGRAPHS = "spaced AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"


def cutting_sql(source: str, size: int, earliest: int, overlap: int) -> str:
    window = f"substr(text, pos + 1, {size} + 2)"
    boundary = f"length({window}) - instr(reverse({window}), chr(10) || chr(10)) - 1"
    taken = f"(CASE WHEN pos + {size} >= length(text) THEN length(text) - pos WHEN instr(reverse({window}), chr(10) || chr(10)) > 0 AND {boundary} > {earliest} THEN {boundary} ELSE {size} END)::BIGINT"
    return f"""walk AS (
      SELECT doc_id, text, pos, 1 AS n, {taken} AS size FROM (SELECT *, 0::BIGINT AS pos FROM {source} WHERE length(text) > 0)
      UNION ALL SELECT doc_id, text, pos, n, {taken} FROM (SELECT doc_id, text, greatest(pos + 1, pos + size - {overlap}) AS pos, n + 1 AS n FROM walk WHERE pos + {size} < length(text)))"""


TRIM = "trim({}, ' ' || chr(10) || chr(13) || chr(9))"


@query(
    "plain_sections",
    f"""WITH RECURSIVE {PARAGRAPHS}, clean AS (SELECT doc_id, {TRIM.format("text")} AS text FROM spaced), {cutting_sql('clean', 20000, 10000, 0)}
    SELECT doc_id, n - 1 AS ordinal, 'Part ' || n AS label, {TRIM.format('substr(text, pos + 1, size)')} AS text FROM walk""",
)
def plain_sections(spark, folder):
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"))
    parts = chunks.explode_sections(documents, chunks.finish_sections(chunks.plain_parts(F.col("body"))), ["doc_id"])
    return parts.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("locator.label").alias("label"), "text")


CHUNKED = f"""WITH RECURSIVE {WIKI}, sources AS (SELECT id AS doc_id, {TRIM.format("title || chr(10) || alias || chr(10) || array_to_string(tags, ' ') || chr(10) || 'chars: ' || n_chars || chr(10) || 'lang: ' || lang || chr(10) || chr(10) || replace(body, chr(10), chr(10) || chr(10))")} AS text FROM wiki),
    {cutting_sql('sources', 1600, 960, 200)},
    pieces AS (SELECT doc_id, n, {TRIM.format('substr(text, pos + 1, size)')} AS content FROM walk),
    firsts AS (SELECT doc_id, content, min(n) AS n FROM pieces WHERE content <> '' GROUP BY ALL)"""


@query("page_chunks", f"{CHUNKED} SELECT doc_id AS page_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS ordinal, content, sha256(content) AS content_hash FROM firsts")
def page_chunks(spark, folder):
    pages = wiki(spark, folder).withColumn("body", F.replace("body", F.lit("\n"), F.lit("\n\n")))
    return chunks.page_chunks(pages).withColumn("ordinal", F.col("ordinal").cast("bigint"))


@query(
    "section_chunks",
    f"""WITH sources AS (SELECT conv_id * 1000 + turn AS section_id, 'talk.md' || chr(10) || 'MARKDOWN' || chr(10) || role || chr(10) || 'Turn ' || turn || CASE WHEN role = 'system' THEN chr(10) || 'hidden' ELSE '' END || chr(10) || chr(10) || text AS s FROM conversations),
    cuts AS (SELECT section_id, s, n FROM sources, range(0, 1000) AS r(n) WHERE n = 0 OR n * 1400 + 200 < length(s)),
    pieces AS (SELECT section_id, n, {TRIM.format('substr(s, n * 1400 + 1, 1600)')} AS content FROM cuts),
    firsts AS (SELECT section_id, content, min(n) AS n FROM pieces WHERE content <> '' GROUP BY ALL)
    SELECT section_id, row_number() OVER (PARTITION BY section_id ORDER BY n) - 1 AS ordinal, content FROM firsts""",
)
def section_chunks(spark, folder):
    turns = read_spread(spark, folder, "conversations", "conv_id")
    rows = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("section_id"), F.lit("talk.md").alias("filename"), F.lit("markdown").alias("format"), F.col("role").alias("kind"),
        F.struct(F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("label")).alias("locator"), (F.col("role") == "system").alias("hidden"), "text",
    )
    return chunks.section_chunks(rows).select("section_id", F.col("ordinal").cast("bigint").alias("ordinal"), "content")


@query(
    "stale_index_rows",
    f"WITH {WIKI} SELECT id FROM wiki WHERE id % 3 <> 0 OR lang = 'fr'",
)
def stale_index_rows(spark, folder):
    """Pages whose stored hash is missing (two of three) or was made of another title (French)."""
    pages = wiki(spark, folder)
    indexed = pages.filter(F.col("id") % 3 == 0).withColumn("title", F.when(F.array_contains("tags", "lang:fr"), F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    state = indexed.select(F.col("id").alias("page_id"), chunks.page_content_hash().alias("content_hash"))
    return chunks.stale_pages(pages, state).select("id")


@query(
    "markdown_sections",
    rf"""WITH md AS (SELECT page_id, {markdown_sql(chr(39) + '<h2>Start</h2>' + chr(39) + ' || html')} AS m FROM pages),
    lines AS (SELECT page_id, m, regexp_extract_all(m, '(?m)^#{{1,6}}\s+(.+)$', 0) AS heads FROM md),
    split AS (SELECT page_id, regexp_split_to_array(m, '(?m)^#{{1,6}}\s+.+$') AS bodies, heads FROM lines)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ordinal, 'Heading: ' || trim(regexp_extract(heads[i], '^#{{1,6}}\s+(.+)$', 1)) AS label, {TRIM.format('bodies[i + 1]')} AS text
    FROM split, range(1, 1000) AS r(i) WHERE i <= len(heads) AND {TRIM.format('bodies[i + 1]')} <> ''""",
)
def markdown_sections(spark, folder):
    pages = captured(spark, folder)
    markdown = html.html_to_markdown(F.concat(F.lit("<h2>Start</h2>"), F.col("html")), F.col("url"))
    rows = pages.select("page_id", markdown.alias("markdown"))
    found = chunks.explode_sections(rows, chunks.finish_sections(chunks.markdown_sections(F.col("markdown"))), ["page_id"])
    return found.select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("locator.label").alias("label"), "text")


@query(
    "long_section_parts",
    """WITH long AS (SELECT doc_id, repeat(text || ' ', 4) || 'end' AS t FROM documents)
    SELECT doc_id, n AS ordinal, CASE WHEN length(t) > 50000 THEN 'All (part ' || (n + 1) || ')' ELSE 'All' END AS label, substr(t, n * 50000 + 1, 50000) AS text
    FROM long, range(0, 1000) AS r(n) WHERE n = 0 OR n * 50000 < length(t)""",
)
def long_section_parts(spark, folder):
    """Every text four times over as one section; the long ones are split."""
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", F.concat(F.repeat(F.concat("text", F.lit(" ")), F.lit(4)), F.lit("end")).alias("body"))
    whole = F.struct(
        F.lit("text").alias("kind"), F.lit(None).cast("string").alias("title"), chunks.locator(label=F.lit("All")).alias("locator"), F.col("body").alias("text"),
        F.lit(False).alias("hidden"), F.lit(False).alias("needs_ocr"),
    )
    parts = chunks.explode_sections(documents, chunks.finish_sections(F.array(whole)), ["doc_id"])
    return parts.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("locator.label").alias("label"), "text")


@query(
    "text_decode",
    "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE text END AS text FROM documents",
)
def text_decode(spark, folder):
    """Every text in one of three encodings, or broken."""
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text")
    kind = F.col("doc_id") % 4
    content = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(kind == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .otherwise(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3"))))
    )
    return documents.select("doc_id", files.decode_text(content).alias("text"))


@query(
    "url_parts",
    rf"""SELECT page_id, 'Web capture: ' || {HOST} || CASE WHEN p IN ('', '/') THEN '' ELSE regexp_replace(p, '/$', '') END AS title, 
      CASE WHEN regexp_matches(regexp_replace(url, '#.*$', ''), '^https?://[^/?]+$') THEN regexp_replace(url, '#.*$', '') || '/' ELSE regexp_replace(url, '#.*$', '') END AS canonical
      FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages)""",
)
def url_parts(spark, folder):
    pages = captured(spark, folder).select("page_id", "url")
    return pages.select("page_id", urls.capture_title(F.col("url")).alias("title"), urls.normalize_url(F.col("url")).alias("canonical"))


@query(
    "safe_urls",
    r"""WITH built AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE page_id % 8
      WHEN 0 THEN CASE WHEN regexp_matches(bare, '^https?://[^/?]+$') THEN bare || '/' ELSE bare END
      WHEN 3 THEN 'http://8.8.' || page_id % 256 || '.8/x' WHEN 5 THEN 'https://' || host || '/a' || path || '%20%C3%A9?q=%27%20' WHEN 6 THEN 'http://xn--bcher-kva.example' || CASE WHEN path = '' THEN '/' ELSE path END
      WHEN 7 THEN 'http://8.8.8.8:8080/' END AS url FROM built""",
)
def safe_urls(spark, folder):
    """Addresses as they are, with credentials, private and public literals, local, with dot segments and blanks, beyond ASCII, and as one number."""
    pages = captured(spark, folder).select("page_id", "url")
    ident, rest = F.col("page_id"), F.substring(F.col("url"), F.lit(9), F.length("url"))
    host, path = F.regexp_extract("url", "^https?://([^/?#]+)", 1), F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1)
    octet = (ident % 256).cast("string")
    forms = [
        F.col("url"), F.concat(F.lit("http://user:pw@"), rest), F.concat(F.lit("http://10.0."), octet, F.lit(".1/x")), F.concat(F.lit("http://8.8."), octet, F.lit(".8/x#y")),
        F.concat(F.lit("http://localhost:8080/"), ident.cast("string")), F.concat(F.lit("HTTPS://"), F.upper(host), F.lit(":443/a/./b/.."), path, F.lit(" é?q=' #z")),
        F.concat(F.lit("http://BÜCHER.example"), path), F.lit("http://134744072:8080"),
    ]
    return pages.select("page_id", urls.normalize_url(F.get(F.array(*forms), (ident % len(forms)).cast("int"))).alias("url"))


V4 = ", ".join(f"({int(ipaddress.ip_network(network).network_address)}, {ipaddress.ip_network(network).prefixlen})" for network in urls.BLOCKED_V4)


@query(
    "public_ipv4",
    f"""WITH blocked(network, bits) AS (VALUES {V4}), addresses AS (SELECT event_id, (event_id * 429497 + user_id * 7919) % 4294967296 AS n FROM events)
    SELECT event_id, (n >> 24) || '.' || ((n >> 16) & 255) || '.' || ((n >> 8) & 255) || '.' || (n & 255) AS address,
      NOT EXISTS (SELECT 1 FROM blocked WHERE n BETWEEN network::BIGINT AND network::BIGINT + (1::BIGINT << (32 - bits)) - 1) AS public FROM addresses""",
)
def public_ipv4(spark, folder):
    """One address per event, judged by integer arithmetic."""
    events = read_table(spark, folder, "events").select("event_id", "user_id")
    number = (F.col("event_id") * 429497 + F.col("user_id") * 7919) % 4294967296
    octet = lambda shift: F.shiftright(number, shift).bitwiseAND(255).cast("string")
    addresses = events.select("event_id", F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)).alias("address"))
    return addresses.withColumn("public", urls.is_public_ip(F.col("address")))


# Networks as (32 hexadecimal digits, bits).
V6 = ", ".join(f"('{int(network.network_address):032x}', {network.prefixlen})" for network in map(ipaddress.ip_network, urls.BLOCKED_V6))


@query(
    "public_ipv6",
    f"""WITH blocked(network, bits) AS (VALUES {V6}), numbered AS (SELECT *, row_number() OVER (ORDER BY network, bits) - 1 AS n FROM blocked),
    made AS (SELECT event_id, substr(substr(network, 1, (bits - event_id % 9)::INT // 4) || md5((event_id * 31 + user_id)::VARCHAR), 1, 32) AS h FROM events JOIN numbered ON n = event_id % 18),
    halves AS (SELECT event_id, h, ('0x' || substr(h, 1, 16))::UBIGINT AS hi, ('0x' || substr(h, 17, 16))::UBIGINT AS lo FROM made),
    networks AS (SELECT bits::INT AS bits, ('0x' || substr(network, 1, 16))::UBIGINT AS hi, ('0x' || substr(network, 17, 16))::UBIGINT AS lo FROM blocked)
    SELECT event_id, concat_ws(':', substr(h, 1, 4), substr(h, 5, 4), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 4), substr(h, 25, 4), substr(h, 29, 4)) AS address,
      NOT EXISTS (SELECT 1 FROM networks n WHERE CASE WHEN n.bits <= 64 THEN (a.hi >> (64 - n.bits)::UBIGINT) = (n.hi >> (64 - n.bits)::UBIGINT) ELSE a.hi = n.hi AND (a.lo >> (128 - n.bits)::UBIGINT) = (n.lo >> (128 - n.bits)::UBIGINT) END) AS public FROM halves a""",
)
def public_ipv6(spark, folder):
    """Addresses that agree with a blocked network in all its bits or in some fewer."""
    networks = sorted((f"{int(network.network_address):032x}", network.prefixlen) for network in map(ipaddress.ip_network, urls.BLOCKED_V6))
    events = read_table(spark, folder, "events").select("event_id", "user_id")
    chosen = F.get(F.array(*[F.struct(F.lit(digits).alias("digits"), F.lit(bits).alias("bits")) for digits, bits in networks]), (F.col("event_id") % len(networks)).cast("int"))
    head = F.substring(chosen["digits"], F.lit(1), F.floor((chosen["bits"] - F.col("event_id") % 9) / 4).cast("int"))
    digits = F.substring(F.concat(head, F.md5((F.col("event_id") * 31 + F.col("user_id")).cast("string"))), 1, 32)
    address = F.concat_ws(":", *[F.substring(digits, place, 4) for place in range(1, 33, 4)])
    return events.select("event_id", address.alias("address")).withColumn("public", urls.is_public_ip(F.col("address")))


@query(
    "search_result_urls",
    r"""SELECT doc_id // 8 AS query, string_agg('https://example.com/' || doc_id, ' ' ORDER BY doc_id) AS urls FROM documents WHERE doc_id % 8 < 5 GROUP BY doc_id // 8""",
)
def search_result_urls(spark, folder):
    """Result pages of eight documents each: plain results, redirects, and private addresses that are dropped; five are kept."""
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id")
    ident = F.col("doc_id").cast("string")
    line = F.concat(
        F.lit("TITLE: result\nURL: "),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://example.com/"), ident)).otherwise(F.concat(F.lit("//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2F"), ident, F.lit("&amp;rut=x"))),
        F.lit("\nURL: http://127.0.0.1/secret\n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line"))))
    outputs = documents.groupBy(F.floor(F.col("doc_id") / 8).alias("query")).agg(F.array_join(F.transform(ordered, lambda item: item["line"]), "\n").alias("output"))
    return outputs.select("query", F.array_join(urls.search_result_urls(F.col("output"), 5), " ").alias("urls"))


@query(
    "delegated_envelopes",
    f"SELECT page_id, url AS source_url, 'text/html' AS content_type, {TRIM.format('html')} AS body FROM pages WHERE page_id % 9 <> 8",
)
def delegated_envelopes(spark, folder):
    """Pages wrapped as tool output, a ninth of them without end line, then unwrapped."""
    pages = captured(spark, folder)
    end = F.when(F.col("page_id") % 9 == 8, F.lit("")).otherwise(F.lit("\nEND_UNTRUSTED_WEB_CONTENT\n"))
    output = F.concat(F.lit("noise\nBEGIN_UNTRUSTED_WEB_CONTENT\nSOURCE_URL: "), "url", F.lit("\nCONTENT_TYPE: old\nCONTENT_TYPE: text/html\n\n"), "html", end)
    read = pages.select("page_id", html.envelope_metadata(output).alias("m"), html.envelope_body(output).alias("body"))
    return read.filter(F.col("body").isNotNull()).select("page_id", F.col("m")["SOURCE_URL"].alias("source_url"), F.col("m")["CONTENT_TYPE"].alias("content_type"), "body")


@query(
    "pdf_names",
    r"""SELECT page_id, CASE WHEN n ILIKE '%.pdf' THEN n ELSE n || '.pdf' END AS filename, CASE WHEN page_id % 3 = 0 THEN 'abcdefghijk' END AS video FROM (
      SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'report ' || page_id || '_.pdf' ELSE regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1) END AS n FROM pages)""",
)
def pdf_names(spark, folder):
    pages = captured(spark, folder).select("page_id", "url")
    header = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('attachment; filename="report%20'), F.col("page_id").cast("string"), F.lit('%3F.pdf"')))
    address = F.when(F.col("page_id") % 3 == 0, F.lit("https://www.youtube.com/watch?list=1&v=abcdefghijk")).otherwise(F.col("url"))
    return pages.select("page_id", urls.pdf_filename(F.col("url"), header).alias("filename"), urls.youtube_id(address).alias("video"))


@query(
    "front_matter_round_trip",
    f"""WITH {WIKI} SELECT w.id, w.title, coalesce(w.deleted_alias, w.alias) AS alias, array_to_string(w.tags, ',') AS tags, w.status, w.lang, w.n_chars::VARCHAR AS chars, w.body, coalesce(p.id, -1) AS parent_id
    FROM wiki w LEFT JOIN wiki p ON w.parent_id = p.id AND p.deleted_at IS NULL""",
)
def front_matter_round_trip(spark, folder):
    """Pages exported as Markdown with a header and imported again, parents by their aliases."""
    pages = wiki(spark, folder).withColumn("alias", F.coalesce("deleted_alias", "alias"))
    exported = frontmatter.export_pages(pages)
    files = exported.select(F.col("id").alias("no"), "content")
    back = frontmatter.import_pages(files, pages)
    lang = F.get_json_object(F.concat(F.lit('{"v":'), F.col("properties")["lang"], F.lit("}")), "$.v")
    return back.select(F.col("no").alias("id"), "title", "alias", F.array_join("tags", ",").alias("tags"), "status", lang.alias("lang"), F.col("properties")["chars"].alias("chars"), "body", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"))


@query(
    "export_manifest",
    f"""WITH {WIKI}, files AS (SELECT id, CASE WHEN deleted_at IS NULL THEN 'pages/' ELSE 'trash/' END || id || '-' || coalesce(deleted_alias, alias) || '.md' AS path FROM wiki) SELECT id, path FROM files""",
)
def export_manifest(spark, folder):
    exported = frontmatter.export_pages(wiki(spark, folder))
    listed = frontmatter.manifest(exported)
    checked = exported.join(listed, "path").filter(F.col("size") == F.octet_length("content"))
    return checked.select("id", "path")


@query(
    "archive_round_trip",
    f"""WITH {WIKI} SELECT w.id, w.title, w.alias, array_to_string(w.tags, ',') AS tags, w.status, coalesce(w.parent_id, -1) AS parent_id, w.lang, w.n_chars::VARCHAR AS chars, w.body,
      {TIME.format('w.updated_at')} AS updated_at, {TIME.format('w.deleted_at')} AS deleted_at, coalesce(a.files, 0) AS files, coalesce(a.bytes, 0) AS bytes
    FROM wiki w LEFT JOIN (SELECT conv_id, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations GROUP BY conv_id) a ON a.conv_id = w.id""",
)
def archive_round_trip(spark, folder):
    """All pages and turns (as attached files) written as an archive, restored into an empty store, and read with their files."""
    place = own_folder(spark)
    pages = wiki(spark, folder)
    turns = read_spread(spark, folder, "conversations", "conv_id").select("conv_id", "turn", F.encode("text", "UTF-8").alias("content")).withColumn("sha256", F.sha2("content", 256))
    owned = turns.join(pages.select(F.col("id").alias("conv_id")), "conv_id", "left_semi")
    attached = owned.select(F.col("conv_id").alias("page_id"), "turn", F.col("sha256").alias("blob_sha256"))
    transfer.write_archive(f"{place}/archive", {"pages": pages, "attachments": attached}, lambda kept: frontmatter.export_pages(kept["pages"]), lambda kept: owned.select("sha256", "content"))
    rules = {"keys": {"pages": ["id"], "attachments": ["page_id", "turn"]}, "references": [("attachments", "page_id", "pages", "id")], "blob_columns": [("attachments", "blob_sha256")]}
    version = transfer.restore_archive(spark, f"{place}/archive", f"{place}/store", **rules)
    back, files = (tables.open_version(spark, f"{place}/store", name, version) for name in ("pages", "attachments"))
    sizes = transfer.archive_manifest(spark, f"{place}/archive").filter("path like 'blobs/%'").select(F.substring_index("path", "/", -1).alias("blob_sha256"), "size")
    counted = files.join(sizes, "blob_sha256").groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    lang = F.get_json_object(F.concat(F.lit('{"v":'), F.col("properties")["lang"], F.lit("}")), "$.v")
    return back.join(counted, "id", "left").select(
        "id", "title", "alias", F.array_join("tags", ",").alias("tags"), "status", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), lang.alias("lang"), F.col("properties")["chars"].alias("chars"), "body",
        text_of_time("updated_at").alias("updated_at"), text_of_time("deleted_at").alias("deleted_at"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
    )


@query(
    "mime_of_bytes",
    "SELECT page_id, page_id % 3 = 0 AS pdf, CASE WHEN page_id % 3 = 1 THEN 'image/gif' END AS image FROM pages",
)
def mime_of_bytes(spark, folder):
    """Pages behind a PDF mark some way in, behind an image signature, or as they are."""
    pages = captured(spark, folder)
    content = F.encode(F.concat(F.element_at(F.array(F.lit("\n %PDF-1.7\n"), F.lit("GIF89a"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")), "html"), "UTF-8")
    return pages.select("page_id", mime.has_pdf_signature(content).alias("pdf"), mime.image_mime(content).alias("image"))
