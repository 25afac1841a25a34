"""Web addresses: canonical form, safety, and what can be read from them."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bind

# Networks that are never fetched.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
)
BLOCKED_V6 = (
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/32", "2001:2::/48",
    "2001:10::/28", "2001:20::/28", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10",
    "fec0::/10", "ff00::/8",
)
MAX_URL_CHARS = 4096


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _ipv4_number(address: Column) -> Column:
    """Dotted decimal text as a number, null for anything else."""
    parts = F.split(address, r"\.")
    valid = address.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$") & ~address.endswith(".")
    number = F.lit(0).cast("bigint")
    for index in range(4):
        number = number * 256 + F.try_element_at(parts, F.lit(index + 1)).try_cast("bigint")
    return F.when(valid, number)


def _public_number(number: Column) -> Column:
    blocked = F.lit(False)
    for network in map(ipaddress.ip_network, BLOCKED_V4):
        blocked = blocked | number.between(int(network.network_address), int(network.broadcast_address))
    return ~blocked


def is_public_ipv4(address: Column) -> Column:
    """Dotted IPv4 text outside every blocked network; pure integer arithmetic."""
    return bind(_ipv4_number(address), lambda number: F.coalesce(_public_number(number), F.lit(False)))


def ipv6_groups(address: Column) -> Column:
    """The eight numbers of an IPv6 text, null for anything else."""

    def spell_tail(text: Column) -> Column:
        # A dotted tail is two groups.
        tail = F.regexp_extract(text, r":([0-9.]+\.[0-9.]+)$", 1)
        head = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        spelled = bind(_ipv4_number(tail), lambda number: F.concat(head, F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(65535)))))
        return F.when(tail == "", text).otherwise(spelled)

    def groups(text: Column) -> Column:
        split = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
        # The mark for zeros stands once at most.
        sides = F.split(text, "::")
        left, right = split(F.get(sides, F.lit(0))), split(F.get(sides, F.lit(1)))
        short = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
        parts = F.when(F.size(sides) == 1, F.split(text, ":")).when((F.size(sides) == 2) & (F.size(left) + F.size(right) < 8), short)
        return bind(parts, lambda found: F.when((F.size(found) == 8) & F.forall(found, lambda part: part.rlike("^[0-9a-f]{1,4}$")), F.transform(found, lambda part: F.conv(part, 16, 10).cast("int"))))

    return bind(F.lower(address), lambda text: F.when(text.rlike("^[0-9a-f:.]+$"), bind(spell_tail(text), groups)))


def _public_groups(groups: Column) -> Column:
    blocked = F.lit(False)
    for network in map(ipaddress.ip_network, BLOCKED_V6):
        inside = F.lit(True)
        for place in range(8):
            bits = min(16, max(0, network.prefixlen - 16 * place))
            if bits:
                wanted = int(network.network_address) >> (112 - 16 * place) & 0xFFFF
                inside = inside & (F.shiftright(F.get(groups, F.lit(place)), 16 - bits) == wanted >> (16 - bits))
        blocked = blocked | inside
    return ~blocked


def is_public_ip(address: Column) -> Column:
    """IPv4 or IPv6 text (a zone is left out of account) outside every blocked network."""

    def judge(plain: Column) -> Column:
        six = bind(ipv6_groups(plain), lambda groups: F.coalesce(_public_groups(groups), F.lit(False)))
        return F.when(plain.contains(":"), six).otherwise(is_public_ipv4(plain))

    return bind(F.substring_index(address, "%", 1), lambda plain: F.coalesce(judge(plain), F.lit(False)))


def _numeric_host(host: Column) -> Column:
    """Number of a host made of decimal, octal and hexadecimal parts; null if it overflows or is spelled wrongly."""

    def value(part: Column) -> Column:
        hexadecimal = F.when(part.rlike("^0x[0-9a-f]{0,12}$"), F.conv(F.concat(F.lit("0"), F.substring(part, F.lit(3), F.length(part))), 16, 10))
        octal = F.when(part.rlike("^0[0-7]{0,14}$"), F.conv(part, 8, 10))
        decimal = F.when(part.rlike("^[1-9][0-9]{0,14}$"), part)
        return F.coalesce(hexadecimal, octal, decimal).try_cast("bigint")

    def whole(values: Column) -> Column:
        count = F.size(values)
        last = F.element_at(values, -1)
        fits = F.forall(F.slice(values, F.lit(1), count - 1), lambda one: one < 256) & (last < F.pow(F.lit(256.0), 5 - count))
        total = F.aggregate(
            F.slice(F.transform(values, lambda one, place: F.struct(one.alias("one"), place.alias("place"))), F.lit(1), count - 1),
            last, lambda sum_, item: sum_ + item["one"] * F.pow(F.lit(256.0), 3 - item["place"]).cast("bigint"),
        )
        return F.when((count <= 4) & ~F.exists(values, lambda one: one.isNull()) & fits, total)

    return bind(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), value), whole)


def _dotted(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)])


def _shown_groups(groups: Column) -> Column:
    """IPv6 text with the first longest run of zeros left out."""

    def shorten(text: Column) -> Column:
        shown = text
        for run in range(2, 9):  # the longest run is tried last and so wins
            zeros = rf"^(.*?)(?:^|:)0(?::0){{{run - 1}}}(?::|$)(.*)$"
            shown = F.when(text.rlike(zeros), F.concat(F.regexp_extract(text, zeros, 1), F.lit("::"), F.regexp_extract(text, zeros, 2))).otherwise(shown)
        return shown

    return bind(F.array_join(F.transform(groups, lambda group: F.lower(F.hex(group))), ":"), shorten)


def canonical_host(host: Column) -> Column:
    """A host as it is asked for: lower case, ASCII, numbers dotted; null when it is local, blocked or not a host."""

    def bracketed(inner: Column) -> Column:
        return bind(ipv6_groups(inner), lambda groups: F.when(_public_groups(groups), F.concat(F.lit("["), _shown_groups(groups), F.lit("]"))))

    def numeric(name: Column) -> Column:
        return bind(_numeric_host(name), lambda number: F.when(_public_number(number), _dotted(number)))

    def named(name: Column) -> Column:
        # A host whose last label is a number is an address.
        is_number = name.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")
        local = name.rlike(r"(?:^|\.)localhost\.?$")
        usable = ~local & (F.length(name) > 0) & ~name.rlike(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]") & ~name.rlike(r"[^\x00-\x7f]")
        return F.when(is_number, numeric(name)).when(usable, name)

    decoded = F.lower(F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host))
    # Non-ASCII names are spelled in ASCII by the JVM; a name that it refuses is none.
    ascii_name = F.when(decoded.rlike(r"^[\x00-\x7f]*$"), decoded).otherwise(F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), decoded)))
    return F.when(host.rlike(r"^\[.*\]$"), bracketed(F.regexp_extract(host, r"^\[(.*)\]$", 1))).otherwise(bind(ascii_name, named))


def percent_encoded(text: Column, kept: str) -> Column:
    """Characters outside the class `kept` as the bytes they have in UTF-8."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    spelled = F.transform(letters, lambda letter: F.when(letter.rlike(f"^{kept}$"), letter).otherwise(F.regexp_replace(F.hex(F.encode(letter, "UTF-8")), "(..)", "%$1")))
    return F.when(text.rlike(f"^{kept}*$"), text).otherwise(F.array_join(spelled, ""))


# The characters that paths and queries of web addresses hold as they are.
PATH_CHARACTERS = r"[!$-;=@-\]_a-z|~]"
QUERY_CHARACTERS = r"[!$-&(-;=?-~]"


def without_dots(path: Column) -> Column:
    """A path that starts with a slash without its . and .. segments."""
    single, double = [".", "%2e"], ["..", ".%2e", "%2e.", "%2e%2e"]
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")

    def step(kept: Column, item: Column) -> Column:
        end = F.when(item["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        name = F.lower(item["segment"])
        return (
            F.when(name.isin(*double), F.concat(F.slice(kept, F.lit(1), F.greatest(F.lit(0), F.size(kept) - 1)), end))
            .when(name.isin(*single), F.concat(kept, end))
            .otherwise(F.concat(kept, F.array(item["segment"])))
        )

    def fold(parts: Column) -> Column:
        marked = F.transform(parts, lambda segment, place: F.struct(segment.alias("segment"), (place == F.size(parts) - 1).alias("last")))
        return F.concat(F.lit("/"), F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/"))

    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), bind(segments, fold)).otherwise(path)


def normalize_url(url: Column) -> Column:
    """Canonical public http(s) address without fragment; null when it is refused.

    Dot segments go, what may not stand in an address is percent-encoded, names
    beyond ASCII and numeric hosts are spelled out, default ports are left out.
    Credentials, local names and blocked networks are refused.
    """
    # Groups: scheme, authority, path, query. A backslash counts as a slash before the query.
    form = r"(?is)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"

    def rebuild(bare: Column) -> Column:
        scheme = F.lower(F.regexp_extract(bare, form, 1))
        authority = F.regexp_extract(bare, form, 2)
        path = F.translate(F.regexp_extract(bare, form, 3), "\\", "/")
        query = F.regexp_extract(bare, form, 4)
        port = F.regexp_extract(authority, r":([0-9]*)$", 1)
        host = F.regexp_replace(authority, r":[0-9]*$", "")
        number = F.when(port == "", F.lit(None)).otherwise(port).try_cast("int")
        default = F.when(scheme == "http", 80).otherwise(443)
        shown_port = F.when((port == "") | (number == default), F.lit("")).when(number <= 65535, F.concat(F.lit(":"), number.cast("string")))
        rooted = F.when(path == "", F.lit("/")).otherwise(path)
        spelled = F.concat(
            scheme, F.lit("://"), canonical_host(host), shown_port,
            percent_encoded(without_dots(rooted), PATH_CHARACTERS), F.when(query == "?", F.lit("?")).otherwise(percent_encoded(query, QUERY_CHARACTERS)),
        )
        return F.when(bare.rlike(form) & ~authority.contains("@"), spelled)

    trimmed = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")
    return F.when(F.length(url) <= MAX_URL_CHARS, bind(trimmed, rebuild))


def resolve_url(reference: Column, base: Column) -> Column:
    """Absolute canonical form of a reference found at `base`; null unless it is a public web address."""
    return bind(F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), lambda target: normalize_url(_absolute(target, base)))


def _absolute(reference: Column, base: Column) -> Column:
    scheme = F.lower(F.substring_index(base, "://", 1))
    origin = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?i)^https?://[^/]+", "")
    folder = F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit("/"))
    return (
        F.when(reference.rlike("(?i)^https?://"), reference)
        .when(reference.startswith("//"), F.concat(scheme, F.lit(":"), reference))
        .when(reference.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(reference.startswith("/"), F.concat(origin, reference))
        .when(reference.startswith("?"), F.concat(origin, path, reference))
        .when(reference.startswith("#"), F.regexp_replace(base, "#.*$", ""))
        .otherwise(F.concat(origin, folder, reference))
    )


def capture_title(url: Column) -> Column:
    """Title of a page that waits for its first capture."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    suffix = F.when(path.isin("", "/"), F.lit("")).otherwise(F.regexp_replace(path, "/$", ""))
    return F.substring(F.concat(F.lit("Web capture: "), url_host(url), suffix), 1, 200)


def search_result_urls(output: Column, maximum: int) -> Column:
    """Safe result addresses listed by a search tool, redirects unwrapped, distinct, the first `maximum`."""
    lines = F.regexp_extract_all(output, F.lit(r"(?im)^URL:\s*(\S+)\s*$"), F.lit(1))
    # Fixed value: the redirect prefix of the search service.
    unwrapped = F.transform(
        lines,
        lambda url: F.when(
            url.startswith("//duckduckgo.com/l/"),
            F.url_decode(F.regexp_extract(F.replace(url, F.lit("&amp;"), F.lit("&")), "[?&]uddg=([^&#]*)", 1)),
        ).otherwise(url),
    )
    return F.slice(F.array_distinct(F.array_compact(F.transform(unwrapped, normalize_url))), 1, maximum)


def youtube_id(url: Column) -> Column:
    host = url_host(url)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    candidate = (
        F.when(host == "youtu.be", F.substring_index(F.substring(path, F.lit(2), F.length(path)), "/", 1))
        .when(
            host.isin("youtube.com", "www.youtube.com", "m.youtube.com"),
            F.when(path == "/watch", F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))).otherwise(F.regexp_extract(path, r"^(?:/shorts|/embed)/([^/?#]+)", 1)),
        )
    )
    return F.when(candidate.rlike("^[A-Za-z0-9_-]{11}$"), candidate)


def pdf_filename(url: Column, disposition: Column) -> Column:
    """File name of a captured PDF from the response header, else from the address."""
    suggested = F.regexp_extract(F.coalesce(disposition, F.lit("")), r"""(?i)filename\*?=(?:UTF-8''|"?)([^";]+)""", 1)
    path_name = F.element_at(F.split(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", ""), "/"), -1)
    fallback = F.when(path_name == "", F.lit("web-capture.pdf")).otherwise(path_name)
    chosen = F.when(suggested == "", fallback).otherwise(suggested)
    decoded = F.coalesce(F.try_url_decode(F.replace(chosen, F.lit("+"), F.lit("%2B"))), fallback)
    name = F.element_at(F.split(decoded, "/"), -1)
    clean = F.substring(F.regexp_replace(name, r"[^\w.() -]", "_"), 1, 240)
    named = F.when(clean == "", F.lit("web-capture.pdf")).otherwise(clean)
    return F.when(F.lower(named).endswith(".pdf"), named).otherwise(F.concat(named, F.lit(".pdf")))
