"""Keyed, domain-separated identifiers (hex SHA-256)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, MANIFEST, PATH = "chunk", "manifest", "path"
CONFLICT_FILE, CONFLICT_REVISION = "conflict-file", "conflict-revision"
NEW_FILE, NEW_REVISION = "new-file", "new-revision"


def content_id(data: Column, domain: str, key: str) -> Column:
    """Identifier of bytes or text under a group key; domains never share identifiers."""
    prefix = F.encode(F.concat(F.lit(key), F.lit(domain), F.lit("\0")), "UTF-8")
    return F.sha2(F.concat(prefix, data.cast("binary")), 256)


def path_id(path_key: Column, key: str) -> Column:
    """Identifier of a path, taken from its comparison key."""
    return content_id(path_key, PATH, key)


def joined_id(domain: str, key: str, *parts: Column) -> Column:
    """Identifier of several text parts."""
    return content_id(F.concat_ws("\0", *[p.cast("string") for p in parts]), domain, key)


def uuid_from_digest(digest: Column) -> Column:
    """32 hex characters with the version-5 and variant bits set."""
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 12),
        F.lit("5"),
        F.substring(digest, 14, 3),
        variant,
        F.substring(digest, 18, 15),
    )


def change_tag(tag_key: Column, group: Column, author: Column, revision: Column, content: Column) -> Column:
    """Shared-key tag that binds a change to its group, author, revision and content."""
    return F.sha2(F.concat_ws("|", tag_key, group.cast("string"), author.cast("string"), revision, content), 256)
