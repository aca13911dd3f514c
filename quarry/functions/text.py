"""Column functions on names, titles, URLs and texts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space with the token that follows, or what is left at the end: joining the tokens gives the text back.
TOKEN = "[ \\t\\n\\r\\f]*[^ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$"


def tokens(text: Column) -> Column:
    """Lossless split of a text; null gives an empty list."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def decode_bytes(content: Column) -> Column:
    """Bytes as UTF-8 text, else as Latin-1, with all line ends as ``\\n``."""
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path part, with its dot; empty if there is none (``.txt``, ``a.``)."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def display_name(path: Column, metadata: Column) -> Column:
    """The uploader's file name if one was stored, else the last path part."""
    return F.coalesce(F.nullif(F.try_element_at(metadata, F.lit("originalfilename")), F.lit("")), base_name(path))


def preview(text: Column, limit: int = 50) -> Column:
    """At most ``limit`` characters, with ``...`` if cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_")


def upload_object_name(name: Column, key: Column) -> Column:
    """``uploads/{id}-{safe name}``; the id is a digest of ``key``, so a repeated task names it alike. Null without a name."""
    return F.when(F.length(name) > 0, F.concat(F.lit("uploads/"), F.md5(key.cast("string")), F.lit("-"), safe_file_name(name)))


def pasted_file_name(title: Column) -> Column:
    """File name of a pasted text: 50 safe characters of its title."""
    safe = F.substring(F.regexp_replace(F.trim(title), "[^a-zA-Z0-9_-]", "_"), 1, 50)
    return F.concat(F.when(safe == "", "pasted-text").otherwise(safe), F.lit(".txt"))


def url_lines(text: Column) -> Column:
    """Non-empty trimmed lines of a pasted list, in order, repeats kept."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x != "")


def scraped_file_name(url: Column) -> Column:
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit(".html"), F.lit(".txt"))


def is_web_url(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#\s]+([/?#]\S*)?$"), F.lit(False))


def file_type(name: Column) -> Column:
    """Text after the last dot in upper case; the whole name if it has none."""
    return F.upper(F.element_at(F.split(name, "[.]"), -1))


def embedding_to_text(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ", "), F.lit("]"))


def embedding_from_text(text: Column) -> Column:
    """``[1.0, 2.5]`` as floats; null where the text is no list of numbers."""
    return F.from_json(text, "array<float>")
