"""Text functions as Column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MARKDOWN_EXTENSIONS = (".md", ".markdown", ".txt")
HTML_EXTENSIONS = (".html", ".htm")
BOILERPLATE_LINES = ("available for this page:", "[ back to top ▲ ]", "back to top ▲", "[ back to top ]", "back to top")
BOILERPLATE_PATTERNS = (
    r"^\[[^\]]+\]\([^)]+\)$",
    r"^\[\*\*?[^*]+\*\*?\]\([^)]+\)$",
    r"^uid\s+\[\s*unknown\s*\]",
    r"^(\[[a-z-]+\]\s+\[[^\]]+\]\([^)]+\)\s*)+$",
)
LINK = r"\[([^\]]+)\]\([^)]+\)"
PREVIEW_CHARS = 150
EMBED_CHARS_PER_TOKEN = 6


def strip_links(text: Column) -> Column:
    """Markdown links reduced to their text."""
    return F.regexp_replace(text, LINK, "$1")


def effective_length(text: Column) -> Column:
    """Code points, not counting the targets of Markdown links."""
    return F.length(strip_links(text))


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n")


def extension(name: Column) -> Column:
    """Lower-cased suffix with its dot, of the last path segment; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1))


def processing_mode(name: Column) -> Column:
    ext = extension(name)
    return (
        F.when(ext.isin(*MARKDOWN_EXTENSIONS), F.lit("markdown/text"))
        .when(ext.isin(*HTML_EXTENSIONS), F.lit("html"))
        .otherwise(F.lit("unknown_fallback_raw"))
    )


def is_boilerplate_line(line: Column) -> Column:
    bare = F.trim(line)
    found = F.lower(bare).isin(*BOILERPLATE_LINES)
    for pattern in BOILERPLATE_PATTERNS:
        found = found | bare.rlike(pattern)
    return found


def clean_lines(text: Column) -> Column:
    """The text without its boilerplate lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~is_boilerplate_line(line)), "\n")


def count_of(text: Column, part: Column) -> Column:
    """Places of a part, not overlapping; 0 for an empty part."""
    removed = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, F.floor(removed / F.greatest(F.length(part), F.lit(1)))).otherwise(0).cast("int")


def is_repetitive(chunk: Column) -> Column:
    """The first line has at most two kinds of characters and makes up over four fifths of the chunk."""
    line = F.trim(F.substring_index(chunk, "\n", 1))
    kinds = F.size(F.array_distinct(F.split(line, "")))
    return (F.length(line) > 1) & (kinds <= 2) & (count_of(chunk, line) * F.length(line) > F.length(chunk) * 0.8)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the code points, 1 at least; 0 for an empty text or null."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("int")


def embed_input(text: Column, max_tokens: int = 512) -> Column:
    return F.substring(text, 1, max_tokens * EMBED_CHARS_PER_TOKEN)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 8)


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    return F.concat_ws("_", short_hash(source), index.cast("string"), short_hash(text))


def display_source(original_url: Column, source_path: Column) -> Column:
    trimmed = F.trim(original_url)
    return F.when(F.length(trimmed) > 0, trimmed).otherwise(F.trim(F.coalesce(source_path, F.lit("Unknown"))))


def escape_html(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def html_paragraph(text: Column) -> Column:
    return F.concat(F.lit("<p>"), F.replace(escape_html(text), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))


def preview(text: Column, n: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def similarity_of_distance(distance: Column) -> Column:
    return F.lit(1.0) - distance / 2
