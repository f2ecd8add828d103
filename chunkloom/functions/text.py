"""Text as Column functions: sentences, tokens, names, URLs, markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip takes it.
_STRIP = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A sentence ends at a CJK terminator or a line end; of a run of terminators only the first is kept.
SENTENCE_CJK = "[^。！？…\n]+[。！？…\n]?"
#: A sentence ends at a run of Latin terminators or a line end.
SENTENCE_LATIN = "[^.!?\n]+[.!?]*"
WORD = r"\S+"
#: For text without spaces: each Han or kana character is a token, other runs are one.
WORD_CJK = r"[぀-ヿ㐀-䶿一-鿿]|[^\s぀-ヿ㐀-䶿一-鿿]+"

#: Extensions and their MIME types.
MIME_TYPES = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword", ".txt": "text/plain", ".md": "text/markdown",
    ".html": "text/html", ".htm": "text/html", ".json": "application/json", ".csv": "text/csv", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tiff": "image/tiff",
}
#: Image formats and the bytes that their files begin with.
IMAGE_MAGIC = (
    ("jpg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("jp2", "0000000C6A5020200D0A870A"), ("gif", "47494638"), ("bmp", "424D"),
    ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("tiff", "49492B00"), ("tiff", "4D4D002B"),
)


def strip(text: Column) -> Column:
    """Without white space at both ends, as Python's str.strip; SQL's trim removes spaces only."""
    return F.btrim(text, F.lit(_STRIP))


def sentences(text: Column, pattern: str = SENTENCE_CJK) -> Column:
    """Stripped matches of a sentence pattern, in order, empty ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), strip), lambda s: F.length(s) > 0)


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_count(text: Column, pattern: str = WORD) -> Column:
    return F.size(tokens(text, pattern))


def suffix(path: Column) -> Column:
    """The last extension in lower case with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def mime_type(path: Column) -> Column:
    """The MIME type of a name's extension, or null."""
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.element_at(known, suffix(path))


def extension_of_mime(content_type: Column) -> Column:
    """The first extension with a MIME type, whose parameters are ignored, or null."""
    first: dict[str, str] = {}
    for extension, kind in MIME_TYPES.items():
        first.setdefault(kind, extension)
    return F.element_at(F.create_map(*[F.lit(x) for pair in first.items() for x in pair]), F.lower(strip(F.regexp_extract(content_type, "^[^;]*", 0))))


def image_format(content: Column) -> Column:
    """The image format that binary content begins as, or null."""
    out = F.lit(None).cast("string")
    for name, magic in reversed(IMAGE_MAGIC):
        out = F.when(F.startswith(content, F.unhex(F.lit(magic))), name).otherwise(out)
    return out


def valid_url(url: Column) -> Column:
    """Whether a URL has a scheme and a host."""
    return F.coalesce(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+"), F.lit(False))


def is_web(path: Column) -> Column:
    return path.startswith("http://") | path.startswith("https://")


def urls(text: Column, compat: bool = False) -> Column:
    """All web addresses in a text. compat keeps an old pattern's quirks: http needs a trailing //, + ends a URL."""
    return F.regexp_extract_all(text, F.lit(r"http://[^\s+]+//|https://[^\s+]+" if compat else r'https?://[^\s"<>]+'), F.lit(0))


def markdown_link(text: Column, url: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")"))


def markdown_image(base_url: Column, key: Column) -> Column:
    return F.concat(F.lit("![image]("), F.regexp_replace(base_url, "/+$", ""), F.lit("/files/"), key, F.lit("/file-preview)"))


def with_image_markers(text: Column, images: Column, marker: str = "[image]") -> Column:
    """Page text with one marker a non-empty image, each on a line of its own."""
    lines = F.array_join(F.array_repeat(F.lit(marker), images.cast("int")), "\n")
    return F.when(images > 0, F.concat_ws("\n", text, lines)).otherwise(text)


def indent(text: Column, by: str = "  ") -> Column:
    return F.regexp_replace(text, "(?m)^", by)


def byte_pieces(content: Column, size: int = 4096) -> Column:
    """Binary content cut into pieces of size bytes, the last one shorter; empty content has none."""
    count = F.ceil(F.octet_length(content) / F.lit(size)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.substring(content, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<binary>"))
