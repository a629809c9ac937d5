"""Lines that many documents share are dropped, with DataFrame operations only.

Texts are exploded into lines and each line's key is hashed. One grouping by hash alone finds the
hashes of enough lines to matter; only lines with such a hash are looked at again: their distinct
documents are counted under 128 bits of hash, and those over the threshold give positions to drop.
Texts are never exploded through a shuffle: they meet the positions of their dropped lines once,
and are put together again from the runs of lines between those.

Both groupings by hash combine before they shuffle. A hash that a third of all rows hold is one
row on the other side of each join, so Spark splits the hot side.

Defined cases: a NULL or empty text is one empty line; a row is a document of its own, but rows of
one ``doc_id`` count as one document towards the threshold, and if it is the largest all of them
keep the line; NULL ids count together as one document, smaller than all others; a text all of whose lines
are dropped becomes empty; line ends other than ``\\n`` belong to the line; an empty table gives an
empty result; extra columns are kept unless the result has one of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored

MIN_CHARS = 40
MIN_DOCUMENTS = 5
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # In ASCII lower() changes A-Z alone, and is much faster.
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_shared_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A key of at least ``min_chars`` code points that at least ``min_documents`` documents hold
    loses all its lines except those of the largest id.
    """
    # Rows of one id are told apart by their text; rows equal in both lose the same lines.
    body = F.coalesce(F.col(text), F.lit(""))
    lines = (
        docs.select(F.col(doc_id).alias("_id"), F.xxhash64(body).alias("_text"), F.posexplode(_lines(F.col(text))).alias("_at", "_line"))
        .where(F.char_length(F.btrim("_line", F.lit(BLANKS))) >= min_chars)
        .select("_id", "_text", "_at", line_key(F.col("_line")).alias("_key"))
        .select("_id", "_text", "_at", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit("second"), "_key").alias("_h2"))
    )
    often = lines.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_documents).select("_h")
    again = stored(lines.join(often, "_h"), "line-hashes")
    shared = (
        again.select("_h", "_h2", "_id")
        .distinct()
        .groupBy("_h", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last"))
        .where(F.col("_n") >= min_documents)
        .select("_h", "_h2", "_last")
    )
    dropped = (
        again.join(shared, ["_h", "_h2"])
        .where(F.col("_id").isNull() | (F.col("_id") < F.col("_last")))
        .groupBy("_id", "_text")
        .agg(F.sort_array(F.collect_set("_at")).alias("_out"))  # positions of one text
    )
    dropped = dropped.select(F.col("_id").alias("_of"), F.col("_text").alias("_as"), "_out")
    made = {"n_lines", "n_dropped", "kept_text"}
    rest = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in made and c not in ("_out", "_of", "_as")]
    )
    same = F.col(doc_id).eqNullSafe(F.col("_of")) & (F.xxhash64(body) == F.col("_as"))
    found = rest.join(dropped, same, "left").drop("_of", "_as")

    parts = _lines(F.col(text))
    # Runs of lines between dropped positions; the last run ends with the text.
    ends = F.concat(F.col("_out"), F.array(F.size(parts)))
    begins = F.concat(F.array(F.lit(0)), F.transform("_out", lambda p: p + 1))
    runs = F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("begin"), (e - b).alias("length")))
    kept = F.array_join(
        F.flatten(F.transform(runs, lambda r: F.slice(F.col("_lines"), r["begin"] + 1, r["length"]))), "\n"
    )
    return (
        found.withColumn("n_lines", F.size(parts).cast("bigint"))
        .withColumn("n_dropped", F.coalesce(F.size("_out"), F.lit(0)).cast("bigint"))
        .withColumn("_lines", F.when(F.col("_out").isNotNull(), parts))
        .withColumn("kept_text", F.when(F.col("_out").isNull(), body).otherwise(kept))
        .drop("_out", "_lines")
    )


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, n, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS n, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.last_id AS out
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT out), '')) AS kept_sha256
FROM marked GROUP BY doc_id, n
"""
