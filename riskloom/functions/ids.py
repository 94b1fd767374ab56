"""Identities and names: hashes of stable JSON, id parts, file names, media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import web

# Media types by extension, extensions by media type, and those that are read.
MIME_TYPES = {
    "html": "text/html", "htm": "text/html", "pdf": "application/pdf", "txt": "text/plain", "csv": "text/csv", "json": "application/json",
    "md": "text/markdown", "xml": "text/xml", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel",
}
EXTENSIONS = {
    "text/html": ".html", "application/xhtml+xml": ".html", "application/pdf": ".pdf", "application/json": ".json", "text/csv": ".csv", "application/csv": ".csv",
}

ID_PART = r"^[A-Za-z0-9][A-Za-z0-9_.-]*$"


def text_of(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def json_string(c: Column) -> Column:
    """A text as a JSON string, or null."""
    return F.regexp_extract(F.to_json(F.array(c.cast("string")), {"ignoreNullFields": "false"}), r"^\[(.*)\]$", 1)


def json_object(fields: dict[str, Column]) -> Column:
    """Texts as a JSON object with sorted keys; nulls stay."""
    members = [F.concat(F.lit(f'"{k}": '), json_string(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def stable_hash(c: Column, length: int = 64) -> Column:
    """SHA-256 of a text's JSON string (its quotes included), cut to `length`."""
    return F.substring(F.sha2(json_string(c), 256), 1, length)


def source_id(canonical: Column) -> Column:
    return F.concat(F.lit("src_"), stable_hash(canonical, 16))


def document_id(source: Column) -> Column:
    """Null for what is no id."""
    return F.when(is_id_part(source), F.concat(F.lit("doc_"), stable_hash(source, 16)))


def artifact_id(*parts: Column, prefix: str = "art") -> Column:
    """Prefix and hash of the parts as a JSON list."""
    joined = F.concat(F.lit("["), F.concat_ws(", ", *(json_string(p) for p in parts)), F.lit("]"))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))


def row_source_id(given: Column, source: Column, canonical: Column, local: Column) -> Column:
    """The id given, else a hash of where the row comes from."""
    payload = json_object({"source": source, "canonical_source": canonical, "local_path": local})
    return F.coalesce(F.nullif(text_of(given), F.lit("")), F.concat(F.lit("src_"), F.substring(F.sha2(payload, 256), 1, 20)))


def merge_decision_id(incoming: Column, url: Column, entity: Column, name: Column, kind: Column) -> Column:
    payload = json_object({"incoming_key": incoming, "source_url": url, "entity_id": entity, "name": name, "type": kind})
    return F.concat(F.lit("entity_merge_decision_"), F.substring(F.sha2(payload, 256), 1, 20))


def id_part(c: Column) -> Column:
    """Other characters become _, marks at the ends go; null if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(text_of(c), r"[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.nullif(kept, F.lit(""))


def is_id_part(c: Column) -> Column:
    return F.coalesce(text_of(c).rlike(ID_PART), F.lit(False))


def safe_name(c: Column, fallback: str = "unknown") -> Column:
    """Letters, digits and -_. of any language stay, each other character becomes _."""
    text = F.coalesce(F.nullif(text_of(c), F.lit("")), F.lit(fallback))
    kept = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def base_name(c: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1)


def suffix(c: Column) -> Column:
    """The extension with its dot, in lower case; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(c), r"[^.](\.[^.]+)$", 1))


def stem(c: Column) -> Column:
    name = base_name(c)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def safe_filename(c: Column, fallback: str = "file") -> Column:
    raw = F.coalesce(F.nullif(c, F.lit("")), F.lit(fallback))
    name = F.regexp_replace(F.regexp_replace(stem(raw), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    end = F.substring(F.regexp_replace(suffix(raw), r"[^A-Za-z0-9.]", ""), 1, 16)
    return F.concat(F.substring(F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback)), 1, 90), end)


def source_path(source: Column) -> Column:
    """A URL's path, or the source itself."""
    return F.when(web.is_url(source), F.regexp_extract(F.trim(source), web.PARTS, 3)).otherwise(source)


def filename_title(source: Column) -> Column:
    """The file name without extension, with blanks for _ and -; null if there is none."""
    return F.nullif(F.trim(F.translate(stem(source_path(source)), "_-", "  ")), F.lit(""))


def _choose(c: Column, table: dict[str, str], rest: Column) -> Column:
    out = rest
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def mime_type(source: Column) -> Column:
    """The media type that the extension stands for, or null."""
    return _choose(F.substring(suffix(source_path(source)), 2, 20), MIME_TYPES, F.lit(None).cast("string"))


def extension_for(mime: Column, source: Column) -> Column:
    """The extension a fetched file is kept under: the source's own if it is one that is read, else by media type."""
    own, kind = suffix(source_path(source)), F.lower(text_of(mime))
    by_mime = _choose(kind, EXTENSIONS, F.when(F.startswith(kind, F.lit("text/plain")), F.lit(".txt")).otherwise(F.lit(".bin")))
    return F.when(own == ".htm", F.lit(".html")).when(own.isin(web.SUPPORTED), own).otherwise(by_mime)


def charset(content_type: Column) -> Column:
    found = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=([A-Za-z0-9_.-]+)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("utf-8"))


def decoded(content: Column, content_type: Column) -> Column:
    """Bytes as text by the declared character set, where it is one that Spark knows, else as UTF-8."""
    declared = F.upper(charset(content_type))
    out = F.decode(F.try_validate_utf8(content.cast("string")).cast("binary"), "UTF-8")
    lenient = F.make_valid_utf8(content.cast("string"))
    out = F.coalesce(out, lenient)
    for name in ("ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        aliases = {"ISO-8859-1": ["ISO-8859-1", "LATIN-1", "LATIN1"], "US-ASCII": ["US-ASCII", "ASCII"]}.get(name, [name])
        # ASCII bytes above 127 are not decodable; Latin-1 reads them all
        out = F.when(declared.isin(aliases), F.decode(content, "ISO-8859-1" if name == "US-ASCII" else name)).otherwise(out)
    return out


def fingerprint(source: Column, content_hash: Column, size: Column, modified: Column) -> Column:
    """What is known of a source: a URL by its address, a file read by its bytes, another path by its name."""
    url = web.is_url(source)
    canonical = F.when(url, web.canonicalize_url(source)).otherwise(F.trim(source))
    there = ~url & content_hash.isNotNull()
    kind = F.when(url, F.lit("url")).when(there, F.lit("file_sha256")).otherwise(F.lit("unresolved_path"))
    return F.struct(
        kind.alias("fingerprint_type"), canonical.alias("canonical_source"), F.when(there, content_hash).alias("content_hash"),
        stable_hash(canonical).alias("source_hash"), F.when(there, size).alias("size_bytes"), F.when(there, modified).alias("mtime"),
    )


def base_metadata(source: Column, extra: dict[str, Column]) -> dict[str, Column]:
    """Title, author, publisher, date, URLs, domain and media type of a source, from what is given of it first."""

    def first(*keys: str) -> Column:
        return F.coalesce(*(F.nullif(extra[k], F.lit("")) for k in keys if k in extra), F.lit(None).cast("string"))

    url = F.coalesce(first("source_url", "original_url", "url"), F.when(web.is_url(source), source))
    canonical = F.coalesce(first("canonical_url"), web.canonicalize_url(url))
    return {
        "title": F.coalesce(first("title"), filename_title(source)),
        "author": first("author", "byline", "creator"),
        "publisher": first("publisher", "site_name", "publication"),
        "published_at": first("published_at", "date", "publication_date"),
        "source_url": url,
        "canonical_url": canonical,
        "domain": F.coalesce(web.domain(canonical), web.domain(url), web.domain(source)),
        "mime_type": F.coalesce(first("mime_type"), mime_type(source)),
    }
