"""Portable relative paths: normal form, validation, names and conflict-copy names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.common import first_status, let

# Limits and reserved names of portable paths.
MAX_COMPONENT_BYTES = 255
MAX_PATH_BYTES = 4096
MAX_LABEL_BYTES = 48
FORBIDDEN = r'[\p{Cc}<>:"\\|?*]'
FORBIDDEN_IN_LABEL = r'[\p{Cc}<>:"/\\|?*]'
RESERVED = r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
ASCII_ONLY = r"^[\x00-\x7F]*$"


_FORMS = T.StructType([T.StructField("display", T.StringType()), T.StructField("key", T.StringType())])


@F.pandas_udf(_FORMS)
def _unicode_forms(paths: pd.Series) -> pd.DataFrame:
    def forms(path):
        if path is None:
            return None, None
        shown = [unicodedata.normalize("NFC", part) for part in path.split("/")]
        keys = [unicodedata.normalize("NFC", part.casefold()) for part in shown]
        return "/".join(shown), "/".join(keys)

    return pd.DataFrame([forms(p) for p in paths], columns=["display", "key"])


def normalize_paths(df: DataFrame, path: str, display: str = "display", key: str = "path_key") -> DataFrame:
    """Add the NFC display form and the case-folded comparison key.

    ASCII paths stay in the JVM: the Python function gets NULL for them. No shuffle.
    """
    ascii_only = F.col(path).rlike(ASCII_ONLY)
    forms = df.withColumn("_forms", _unicode_forms(F.when(~ascii_only, F.col(path))))
    return (
        forms.withColumn(display, F.when(ascii_only, F.col(path)).otherwise(F.col("_forms.display")))
        .withColumn(key, F.when(ascii_only, F.lower(path)).otherwise(F.col("_forms.key")))
        .drop("_forms")
    )


def _component_error(part: Column) -> Column:
    stem = F.upper(F.substring_index(part, ".", 1))
    return first_status(
        (part == "", "EMPTY_COMPONENT"),
        (part.isin(".", ".."), "TRAVERSAL"),
        (F.octet_length(part) > MAX_COMPONENT_BYTES, "COMPONENT_TOO_LONG"),
        (part.rlike(r"[. ]\z"), "TRAILING_DOT_OR_SPACE"),
        (stem.rlike(RESERVED), "RESERVED_NAME"),
        (part.rlike(FORBIDDEN), "FORBIDDEN_CHAR"),
    )


def path_error(path: Column) -> Column:
    """First failing rule of an NFC path, NULL for a valid one."""
    broken = F.filter(F.transform(F.split(path, "/"), _component_error), lambda e: e.isNotNull())
    return (
        F.when(path.isNull() | (path == ""), F.lit("EMPTY"))
        .when(path.startswith("/") | path.endswith("/"), F.lit("NOT_RELATIVE"))
        .otherwise(
            F.coalesce(
                F.get(broken, F.lit(0)),
                F.when(F.octet_length(path) > MAX_PATH_BYTES, F.lit("PATH_TOO_LONG")),
            )
        )
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Everything before the last separator, NULL for a bare name."""
    cut = F.char_length(path) - F.char_length(file_name(path)) - 1
    return F.when(cut >= 0, F.substring(path, F.lit(1), cut))


def file_extension(path: Column) -> Column:
    """Text after the last dot when name and extension are both non-empty, else NULL."""
    found = F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]+)$", 1)
    return F.when(found != "", found)


def file_stem(path: Column) -> Column:
    name, ext = file_name(path), file_extension(path)
    cut = F.char_length(name) - F.char_length(ext) - 1
    return F.when(ext.isNotNull(), F.substring(name, F.lit(1), cut)).otherwise(name)


def truncate_bytes(text: Column, limit: Column) -> Column:
    """Longest prefix of at most ``limit`` UTF-8 bytes that ends on a character."""

    def cut(given: Column) -> Column:
        raw, most = given["raw"], given["most"]

        def continues(at: Column) -> Column:
            octet = F.hex(F.substring(raw, at + F.lit(1), F.lit(1)))
            return (octet >= "80") & (octet <= "BF")

        end = (
            F.when(F.octet_length(raw) <= most, F.octet_length(raw))
            .when(~continues(most), most)
            .when(~continues(most - 1), most - 1)
            .when(~continues(most - 2), most - 2)
            .otherwise(most - 3)
        )
        return F.substring(raw, F.lit(1), end).cast("string")

    return let(F.struct(F.encode(text, "UTF-8").alias("raw"), limit.cast("int").alias("most")), cut)


def portable_label(label: Column) -> Column:
    """Device label that is safe inside a file name."""
    safe = F.regexp_replace(label, FORBIDDEN_IN_LABEL, "_")
    trimmed = F.regexp_replace(safe, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")
    trimmed = F.regexp_replace(trimmed, r"[. ]+\z", "")
    named = F.when(trimmed == "", F.lit("device")).otherwise(trimmed)
    return truncate_bytes(named, F.lit(MAX_LABEL_BYTES))


def conflict_path(
    path: Column, label: Column, timestamp_ms: Column, revision: Column, tag: str = "conflict"
) -> Column:
    """``parent/stem (tag label timestamp revision8).ext`` with a name of at most 255 bytes."""
    suffix = F.concat(
        F.lit(f" ({tag} "),
        portable_label(label),
        F.lit(" "),
        timestamp_ms.cast("string"),
        F.lit(" "),
        F.substring(F.replace(revision, F.lit("-"), F.lit("")), 1, 8),
        F.lit(")"),
    )
    ending = F.concat(suffix, F.coalesce(F.concat(F.lit("."), file_extension(path)), F.lit("")))

    def name(end: Column) -> Column:
        room = F.greatest(F.lit(MAX_COMPONENT_BYTES) - F.octet_length(end), F.lit(0))
        return F.concat(truncate_bytes(file_stem(path), room), end)

    parent = F.coalesce(F.concat(parent_path(path), F.lit("/")), F.lit(""))
    return F.concat(parent, let(ending, name))
