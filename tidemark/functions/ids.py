"""Content-derived identifiers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_part(col: Column) -> Column:
    """A part of a key: text trimmed and in lower case, null as empty."""
    return F.lower(F.trim(F.coalesce(col.cast("string"), F.lit(""))))


def source_key(*parts: Column) -> Column:
    """SHA-256 over the parts joined by ``|``; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def short_hash(col: Column, length: int = 16) -> Column:
    """The first hex digits of the SHA-256 of a text."""
    return F.left(F.sha2(col, 256), F.lit(length))


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name in a namespace UUID (RFC 4122); null names give null."""
    space = namespace.replace("-", "")
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    hexes = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))
    return F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def content_sha(text: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text, or of the text itself where it is no JSON."""
    return F.sha2(F.coalesce(canonical_json(text), text), 256)
