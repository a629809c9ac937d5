"""Sealed payloads: authenticated encryption bound to group, version, kind and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.common import first_status

FORMAT_VERSION = 1


def associated_data(group: Column, version: Column, kind: Column, content_id: Column) -> Column:
    return F.concat_ws("|", group.cast("string"), version.cast("string"), kind, content_id)


def seal(df: DataFrame, payload: str, group: Column, kind: Column, secret: str, id_key: str) -> DataFrame:
    """Replace ``payload`` by its envelope ``version, kind, content_id, ciphertext``.

    Spark draws a new IV for every row. Drop ids that are stored already before sealing.
    """
    version = F.lit(FORMAT_VERSION)
    identified = df.withColumn("kind", kind).withColumn(
        "content_id",
        F.when(F.col("kind") == "MANIFEST", ids.content_id(F.col(payload), ids.MANIFEST, id_key))
        .otherwise(ids.content_id(F.col(payload), ids.CHUNK, id_key)),
    )
    aad = associated_data(group, version, F.col("kind"), F.col("content_id"))
    return identified.withColumn("version", version).withColumn(
        "ciphertext",
        F.aes_encrypt(
            F.col(payload).cast("binary"), F.lit(secret), F.lit("GCM"), F.lit("DEFAULT"),
            F.lit("").cast("binary"), aad,
        ),
    ).drop(payload)


def open_sealed(df: DataFrame, group: Column, expected_kind: Column, expected_id: Column, secret: str, id_key: str) -> DataFrame:
    """Add ``status`` and, when it is ``OK``, the opened ``payload``."""
    aad = associated_data(group, F.col("version"), F.col("kind"), F.col("content_id"))
    plain = F.try_aes_decrypt(
        F.col("ciphertext"), F.lit(secret), F.lit("GCM"), F.lit("DEFAULT"), aad
    )
    opened = df.withColumn("_expected_kind", expected_kind).withColumn("_expected_id", expected_id)
    opened = opened.withColumn("_plain", plain)
    recheck = F.when(
        F.col("_expected_kind") == "MANIFEST", ids.content_id(F.col("_plain"), ids.MANIFEST, id_key)
    ).otherwise(ids.content_id(F.col("_plain"), ids.CHUNK, id_key))
    return (
        opened.withColumn(
            "status",
            first_status(
                (F.col("version") != FORMAT_VERSION, "BAD_VERSION"),
                (F.col("kind") != F.col("_expected_kind"), "BAD_KIND"),
                (F.col("content_id") != F.col("_expected_id"), "BAD_ID"),
                (F.col("_plain").isNull(), "AUTH_FAILED"),
                (recheck != F.col("_expected_id"), "ID_MISMATCH"),
                otherwise="OK",
            ),
        )
        .withColumn("payload", F.when(F.col("status") == "OK", F.col("_plain")))
        .drop("_plain", "_expected_kind", "_expected_id")
    )


def verify_objects(df: DataFrame, group: Column, expected_kind: Column, expected_id: Column, secret: str, id_key: str) -> DataFrame:
    """Audit of stored envelopes; ``available`` is what the catalog should say afterwards."""
    opened = open_sealed(df, group, expected_kind, expected_id, secret, id_key)
    return opened.drop("payload", "ciphertext").withColumn("available", F.col("status") == "OK")
