"""URL functions as Column expressions."""

from __future__ import annotations

import shlex
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import count_of

# Fixed values.
RELEVANCE_KEYWORDS = (
    "documentation", "guide", "tutorial", "api", "reference", "manual", "developer", "usage", "examples", "concepts", "getting started",
)
IGNORED_PATTERNS = (
    r"/__(.*?)__/",
    r"/(cdn|static|assets|media|images|img|css|js|fonts|font)/",
    r"/node_modules/",
    r"/\.git/",
    r"/\.well-known/",
    r"(/|\.)(login|signin|signup|register|auth|account|profile|user|admin|dashboard)($|/|\?|#)",
    r"/search(\?|$|/)",
    r"/(cart|checkout|order|wishlist)($|/|\?|#)",
    r"/(tag|tags|category|categories|author|authors)/",
    r"\?replytocom=",
    r"#",
    r"^(mailto|tel|javascript|ftp|irc):",
    r"/(feed|rss|atom|xmlrpc)(\.php)?($|/|\?|#)",
    r"/(wp-content|wp-admin|wp-includes|wp-json)/",
    r"/(_next|_nuxt|_svelte)/",
    r"/(cgi-bin|plesk-stat|webmail)/",
    r"/ajax/",
)
API_WORDS = ("doc", "reference", "guide", "manual", "example", "spec", "v1", "v2", "v3")
API_ENDINGS = (".html", ".htm", "/")
API_VERBS = r"/api/.*?/(get|post|put|delete|patch|resource)"
IGNORED_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "ico", "webp", "svg", "css", "js", "json", "xml", "mp3", "mp4", "avi", "mov", "wmv", "flv", "mkv", "webm",
    "woff", "woff2", "ttf", "eot", "otf", "pdf", "zip", "tar", "gz", "rar", "7z", "exe", "dmg", "iso", "bin", "msi", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "csv", "rtf", "odt", "ods", "odp", "txt", "log", "ini", "cfg", "sql", "db", "bak", "conf", "yaml", "yml", "toml",
)

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
_PARTS = r"^(?i:(https?)):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value made once.  Plain nesting repeats it wherever ``then`` names it, so that a few steps make expressions of thousands of parts."""
    return F.element_at(F.transform(F.array(value), then), 1)


def is_web_url(url: Column) -> Column:
    """What may be typed in as a crawl's root."""
    return F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))


def parsed_keywords(typed: str) -> list[str]:
    """Keywords as a command line splits them: blanks separate, quotes keep together; with an open quote, blanks alone."""
    try:
        return shlex.split(typed)
    except ValueError:
        return typed.split()


def page_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def is_page_file(name: Column) -> Column:
    """The file name of a stored page: 16 hexadecimal digits and ``.md``."""
    return name.rlike(r"^[0-9a-fA-F]{16}\.md$")


def url_part(url: Column, group: int) -> Column:
    """1 scheme, 2 host and port, 3 path, 4 query of an http or https url; empty for others."""
    return F.regexp_extract(url, _PARTS, group)


def normalize_url(url: Column) -> Column:
    """One spelling a page: scheme added, slashes squeezed, query sorted, fragment gone, a slash after a bare last segment.

    Other schemes than http and https give the empty string, as does null.
    """

    def joined(p: Column) -> Column:
        last = F.element_at(F.split(p["path"], "/"), -1)
        open_end = (p["query"] == "") & ~(F.contains(last, F.lit(".")) & ~F.endswith(last, F.lit("."))) & ~F.endswith(p["path"], F.lit("/"))
        ends = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).when(open_end, F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lower(p["scheme"]), F.lit("://"), p["host"], p["path"], ends)

    def normal(full: Column) -> Column:
        path, query = F.regexp_replace(url_part(full, 3), "/+", "/"), F.array_join(F.sort_array(F.split(url_part(full, 4), "&")), "&")
        path = F.when(path == "", F.lit("/")).otherwise(path)
        query = F.when(F.startswith(query, F.lit("&")), F.lit("")).otherwise(query)
        return _bound(F.struct(url_part(full, 1).alias("scheme"), url_part(full, 2).alias("host"), path.alias("path"), query.alias("query")), joined)

    def by_scheme(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, _SCHEME, 1))
        full = F.when(scheme == "", F.concat(F.lit("https://"), u)).otherwise(u)
        return F.when(u.isNull() | ~scheme.isin("", "http", "https"), F.lit("")).otherwise(_bound(full, normal))

    return _bound(url, by_scheme)


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its segments ``.`` and ``..`` applied; ``..`` at the root goes."""

    def applied(p: Column) -> Column:
        segments = F.split(p, "/")
        step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.array_append(kept, s))
        kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("")), step)
        ends = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
        return F.when(p.rlike(r"/\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), ends)).otherwise(p)

    return _bound(path, applied)


def absolute_link(base: Column, href: Column) -> Column:
    """A link on a page as a full url: absolute, scheme-relative, root-relative, query-only, fragment-only or relative.

    Segments ``.`` and ``..`` of the latter kinds' paths are applied; a link with a host of its own is left as it is.
    """

    def resolved(link: Column) -> Column:
        base, href = link["base"], link["href"]
        origin = F.concat(url_part(base, 1), F.lit("://"), url_part(base, 2))
        path, rest = F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 2)
        folder = F.regexp_replace(F.when(url_part(base, 3) == "", F.lit("/")).otherwise(url_part(base, 3)), "[^/]*$", "")
        return (
            F.when(href.rlike(_SCHEME), href)
            .when(F.startswith(href, F.lit("//")), F.concat(url_part(base, 1), F.lit(":"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(origin, without_dots(path), rest))
            .when(F.startswith(href, F.lit("?")), F.concat(origin, url_part(base, 3), href))
            .when((href == "") | F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
            .otherwise(F.concat(origin, without_dots(F.concat(folder, path)), rest))
        )

    return _bound(F.struct(base.alias("base"), href.alias("href")), resolved)


def page_base(url: Column, base: Column) -> Column:
    """What relative links of a page start from: its own url, or the base that it names."""
    return F.when(base.isNotNull(), absolute_link(url, base)).otherwise(url)


def file_slug(text: Column, max_length: int = 40) -> Column:
    """A text as part of a file name; ``default`` where nothing is left."""
    bare = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"^(?i:www\.)", "")
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r'[/:\\?*"<>|=]+', "_"), r"\s+", "_"), "_+", "_")
    cut = F.substring(F.regexp_replace(joined, "^_+|_+$", ""), 1, max_length)
    return F.when(cut == "", F.lit("default")).otherwise(cut)


def keyword_hits(text: Column, keywords: tuple[str, ...] = RELEVANCE_KEYWORDS) -> Column:
    words = F.array(*(F.lit(k) for k in keywords))
    # The text is bound first: inside the inner function it would be made anew for every keyword.
    hits = F.transform(F.array(text), lambda t: F.aggregate(words, F.lit(0), lambda total, word: total + count_of(t, word)))
    return F.element_at(hits, 1)


def link_priority(url: Column, text: Column, keywords: tuple[str, ...] = RELEVANCE_KEYWORDS) -> Column:
    """Smaller is better: the inverse of the keywords in a link's path, query and text."""
    low = F.lower(url)
    path = F.concat(url_part(low, 3), F.when(url_part(low, 4) != "", F.concat(F.lit("?"), url_part(low, 4))).otherwise(F.lit("")))
    score = keyword_hits(path, keywords) + keyword_hits(F.lower(F.coalesce(text, F.lit(""))), keywords)
    return F.greatest(F.lit(1.0) / (score + F.lit(0.01).cast("double")), F.lit(1e-6).cast("double"))


def is_content_page(url: Column) -> Column:
    """Whether a url looks like a page with content, wherever it lies."""
    low = F.lower(url)
    is_http = F.regexp_extract(url, _SCHEME, 1).isin("http", "https")
    api = F.contains(low, F.lit("/api/"))
    documented = low.rlike(API_VERBS)
    for word in API_WORDS:
        documented = documented | F.contains(low, F.lit(word))
    for end in API_ENDINGS:
        documented = documented | F.endswith(low, F.lit(end))
    ignored = F.lit(False)
    for pattern in IGNORED_PATTERNS:
        ignored = ignored | low.rlike(pattern)
    ignored = ignored | F.lower(url_part(url, 3)).rlike(rf"\.({'|'.join(IGNORED_EXTENSIONS)})$")
    return F.coalesce(is_http & (url_part(url, 2) != "") & ~(api & ~documented) & ~ignored, F.lit(False))


def host_within(host: Column, root: Column) -> Column:
    return (host == root) | F.endswith(host, F.concat(F.lit("."), root))


def is_valid_content_url(url: Column, root_hosts: list[str]) -> Column:
    """``is_content_page`` on a root host or one of its subdomains."""
    host = F.lower(url_part(url, 2))
    inside = F.lit(False)
    for root in root_hosts:
        inside = inside | host_within(host, F.lit(root.lower()))
    return is_content_page(url) & inside
