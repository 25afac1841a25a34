import ipaddress

from pyspark.sql import functions as F

from lorespark.functions import html, mime, urls

HARBOUR = (
    "<html><head><title>Harbour &amp; Pier</title><script>track()</script></head><body><header>Site map</header><article><h2>Ferries</h2><p>Three boats leave at dawn.</p>"
    '<img class="wide" data-src="../plans/pier.svg" alt="Plan of the pier"><p>North side first</p><aside>Adverts</aside><ol><li>Blue line</li></ol></article></body></html>'
)


def read(spark, source, address):
    frame = spark.createDataFrame([(source, address)], "html string, url string")
    html_column, url_column = F.col("html"), F.col("url")
    return frame.select(html.html_title(html_column, url_column).alias("title"), html.html_to_markdown(html_column, url_column).alias("markdown"), html.image_references(html_column, url_column).alias("images")).first()


def test_a_page_becomes_markdown(spark):
    row = read(spark, HARBOUR, "https://port.example/city/ferries")
    lines = [line for line in row["markdown"].split("\n") if line.strip()]
    assert row["title"] == "Harbour & Pier" and lines[:2] == ["# Harbour & Pier", "Source: https://port.example/city/ferries"]
    assert [line for line in lines if line.startswith(("## ", "- "))] == ["## Ferries", "- Blue line"]
    assert not any(word in row["markdown"] for word in ("track()", "Site map", "Adverts"))
    assert [tuple(image) for image in row["images"]] == [(0, "https://port.example/plans/pier.svg", "Plan of the pier")]
    places = [row["markdown"].index(part) for part in ("Three boats", "WEB_ASSET_0_PLACEHOLDER", "North side")]
    assert places == sorted(places)


def test_image_attributes(spark):
    tags = [
        ('<img src="data:x" data-srcset="/a.png 1x, /b.png 2x">', "https://e.org/b.png"),
        ("<img src='//cdn.e.org/c.png?x=1#y'>", "https://cdn.e.org/c.png?x=1"),
        ("<img src=d.png alt='[x]  y'>", "https://e.org/dir/d.png"),
        ('<img src="http://127.0.0.1/a.png">', None),
        ('<img src="blob:1">', None),
    ]
    frame = spark.createDataFrame([(n, tag) for n, (tag, _) in enumerate(tags)], "n int, html string")
    rows = frame.select("n", html.image_references(F.col("html"), F.lit("https://e.org/dir/page")).alias("i")).orderBy("n").collect()
    assert [row["i"][0]["source_url"] if row["i"] else None for row in rows] == [expected for _, expected in tags]
    assert rows[2]["i"][0]["alt"] == "x y"


def test_ordinals_skip_unusable_images(spark):
    body = '<p><img src="blob:1"><img src="/a.png" alt="A"><img src="/b.png" alt="B"></p>'
    frame = spark.createDataFrame([(body,)], "html string")
    markdown = frame.select(html.html_to_markdown(F.col("html"), F.lit("https://e.org/")).alias("m")).first()["m"]
    assert "![A](WEB_ASSET_0_PLACEHOLDER)" in markdown and "![B](WEB_ASSET_1_PLACEHOLDER)" in markdown
    dropped = frame.select(html.drop_image(F.lit(markdown), F.lit("A"), F.lit("WEB_ASSET_0_PLACEHOLDER")).alias("m")).first()["m"]
    assert "*Image unavailable: A*" in dropped


def test_markdown_images(spark):
    text = '![One](/a.png "title") ![Two](ftp://x/y) ![Th[ree](https://e.org/c.png)'
    rows = spark.range(1).select(html.markdown_images(F.lit(text), F.lit("https://e.org/")).alias("i")).first()["i"]
    assert [(row["ordinal"], row["source_url"], row["alt"]) for row in rows] == [(0, "https://e.org/a.png", "One"), (1, "https://e.org/c.png", "Th ree")]


ADDRESSES = [
    ("HTTPS://Port.Example:443", "https://port.example/"), ("http://port.example:080/a?b#c", "http://port.example/a?b"), ("http://port.example:8443/x", "http://port.example:8443/x"),
    ("https://e.org/d/../a.png", "https://e.org/a.png"), ("https://e.org/../../x/./y/%2E%2e/z/.", "https://e.org/x/z/"), ("https://e.org/a b\"<c>/é?q='ü x'", "https://e.org/a%20b%22%3Cc%3E/%C3%A9?q=%27%C3%BC%20x%27"),
    ("http://8.8.8.8/i.png", "http://8.8.8.8/i.png"), ("http://0x8.8.2056", "http://8.8.8.8/"), ("http://010.1", "http://8.0.0.1/"), ("http://0178.1", None), ("http://256.1.1.1/", None), ("http://1.2.3.4.5/", None), ("http://[2606:4700:0:0:0:0:0:0001]/", "http://[2606:4700::1]/"),
    ("https://münchen.example/", "https://xn--mnchen-3ya.example/"), ("  https:\\\\e.org\\p\n  ", "https://e.org/p"), ("https://e.org:70000/", None), ("https://e.org:x/", None), ("https://me@e.org/", None), ("https:///", None), ("gopher://e.org/", None),
    ("http://LOCALHOST./", None), ("http://shop.localhost/", None), ("http://3232235521/", None), ("http://0xA9FE0101/", None), ("http://[fd12::9]/", None), ("http://[::ffff:8.8.8.8]/", None), ("http://[1::2::3]/", None), ("https://a%20b.example/", None), (" ", None), ("https://e.org/" + "x" * 5000, None), (None, None),
]


def test_addresses_become_canonical_or_are_refused(spark):
    frame = spark.createDataFrame([(n, url) for n, (url, _) in enumerate(ADDRESSES)], "n int, u string")
    found = [row["p"] for row in frame.select("n", urls.normalize_url(F.col("u")).alias("p")).orderBy("n").collect()]
    assert list(zip([url for url, _ in ADDRESSES], found)) == ADDRESSES


def test_references_are_resolved(spark):
    pairs = [("../a.png", "https://e.org/a.png"), ("a b.png", "https://e.org/d/a%20b.png"), ("//cdn.example/x", "https://cdn.example/x"), ("/ä", "https://e.org/%C3%A4"), ("?q", "https://e.org/d/p?q"), ("", "https://e.org/d/"), ("mailto:x@y", None), ("http://127.1/", None)]
    frame = spark.createDataFrame([(n, ref) for n, (ref, _) in enumerate(pairs)], "n int, r string")
    assert [row["u"] for row in frame.select("n", urls.resolve_url(F.col("r"), F.lit("https://e.org/d/p")).alias("u")).orderBy("n").collect()] == [url for _, url in pairs]


def test_public_addresses_at_the_edges_of_the_blocked_networks(spark):
    cases = []
    for text in (*urls.BLOCKED_V4, *urls.BLOCKED_V6):
        network = ipaddress.ip_network(text)
        for number in (int(network.network_address) - 1, int(network.network_address), int(network.broadcast_address), int(network.broadcast_address) + 1):
            if 0 <= number < 2**network.max_prefixlen:
                address = type(network.network_address)(number)
                blocked = any(address in ipaddress.ip_network(other) for other in (urls.BLOCKED_V4 if network.version == 4 else urls.BLOCKED_V6))
                cases += [(str(address), not blocked), (address.exploded, not blocked)]
    cases += [("9.9.9.9%eth0", True), ("1.2.3", False), ("01.2.3.4", False), ("12345::", False), ("1:2:3:4:5:6:7:8:9", False), ("::1::", False), ("g::", False), ("", False), (None, False), ("2606:4700::1.2.3.4", True), ("2606:4700::1.2.3", False)]
    frame = spark.createDataFrame([(n, address) for n, (address, _) in enumerate(cases)], "n int, a string")
    found = [row["p"] for row in frame.select("n", urls.is_public_ip(F.col("a")).alias("p")).orderBy("n").collect()]
    assert [(address, public) for (address, _), public in zip(cases, found)] == cases


def test_result_lists_of_a_search_tool(spark):
    lines = ["url: https://one.example/x/../y", "NOTE: skipped", "URL: //duckduckgo.com/l/?kl=de&amp;uddg=http%3A%2F%2Ftwo.example%2Fb%3Fc&amp;rut=7", "URL: http://192.168.4.4/", "URL: https://one.example/y", "URL: http://9.9.9.9/dns", "URL: https://bücher.example"]
    found = spark.range(1).select(urls.search_result_urls(F.lit("\n".join(lines)), 9).alias("u"), urls.search_result_urls(F.lit("\n".join(lines)), 1).alias("one")).first()
    assert found["u"] == ["https://one.example/y", "http://two.example/b?c", "http://9.9.9.9/dns", "https://xn--bcher-kva.example/"] and found["one"] == ["https://one.example/y"]


def test_envelope(spark):
    output = "x\nBEGIN_UNTRUSTED_WEB_CONTENT\nSOURCE_URL: https://a/b\nTITLE: Del: gated\n\n# Body\n\ntext\nEND_UNTRUSTED_WEB_CONTENT\n"
    row = spark.range(1).select(html.envelope_metadata(F.lit(output)).alias("m"), html.envelope_body(F.lit(output)).alias("b"), html.envelope_body(F.lit("nothing")).alias("none")).first()
    assert row["m"] == {"SOURCE_URL": "https://a/b", "TITLE": "Del: gated"} and row["b"] == "# Body\n\ntext" and row["none"] is None


def test_formats_and_signatures(spark):
    names = [("A.DOCX", "", "docx"), ("a.bin", "application/pdf", "pdf"), ("a.MD", "", "markdown"), ("a", "text/plain; x", "text"), ("legacy.doc", "application/msword", None)]
    frame = spark.createDataFrame([(name, kind) for name, kind, _ in names], "n string, m string")
    assert [row["f"] for row in frame.select(mime.document_format(F.col("n"), F.col("m")).alias("f")).collect()] == [expected for *_, expected in names]
    contents = [(b"\x89PNG\r\n\x1a\n\0", "image/png"), (b"RIFF1234WEBPVP8", "image/webp"), (b"....ftypavif", "image/avif"), (b"BM", "image/bmp"), (b"plain", None)]
    frame = spark.createDataFrame([(bytearray(content),) for content, _ in contents], "c binary")
    assert [row["f"] for row in frame.select(mime.image_mime(F.col("c")).alias("f")).collect()] == [expected for _, expected in contents]
    frame = spark.createDataFrame([("../bad",), ("ok.txt",), (" ",), ("..",)], "n string")
    assert [row["f"] for row in frame.select(mime.valid_filename(F.col("n")).alias("f")).collect()] == [None, "ok.txt", None, None]


def test_names_from_urls(spark):
    row = spark.range(1).select(
        urls.youtube_id(F.lit("https://youtu.be/abcdefghijk?x")).alias("a"), urls.youtube_id(F.lit("https://www.youtube.com/shorts/abcdefghijk")).alias("b"),
        urls.youtube_id(F.lit("https://www.youtube.com/watch?v=short")).alias("c"), urls.capture_title(F.lit("https://Example.com/a/b/")).alias("d"),
        urls.pdf_filename(F.lit("https://e.org/x/report"), F.lit(None).cast("string")).alias("e"), urls.pdf_filename(F.lit("https://e.org/"), F.lit("attachment; filename=\"a b?.pdf\"")).alias("f"),
    ).first()
    assert tuple(row) == ("abcdefghijk", "abcdefghijk", None, "Web capture: example.com/a/b", "report.pdf", "a b_.pdf")
