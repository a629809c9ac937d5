"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band: neither found nearly
everywhere nor nearly nowhere. Terms are known by 22 bits of their hash, so the lexicon is a bit set
of half a megabyte at any corpus size; the frequencies are counted over distinct texts, so copies
of a text do not move its terms out of the band. A
fingerprint has one hash per lexicon subset, of the sorted distinct terms of the text in that
subset. The subsets are drawn at random in five sizes, a quarter to a thousandth; one in four is drawn
from all terms, not from the lexicon, so texts outside the lexicon still meet in those:
large subsets tell apart texts that differ little, small ones still agree where texts share a
part. The likeness of two fingerprints is the share of equal hashes among the subsets in
which either text has terms.

Defined cases: a NULL text counts as empty; a text without a term in the lexicon has hashes in the
subsets of all terms only; a text without words, or with none in any subset, has the fingerprint of the
empty set and is like another of its kind;
equal ids are ordered by text; NULL ids come last; a single document is its own next; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shingles import word_hashes, words
from tidemark.llm.store import small_batches, stored

TERM_BITS = 22
SLICE_BITS = 12
#: (bits, subsets): so many subsets, each with one in 2**bits of the lexicon's terms.
SUBSETS = ((2, 4), (4, 8), (6, 16), (8, 16), (10, 16))
#: Every so many-th subset is drawn from all terms.
FROM_ALL = 4
#: Repeated texts up to which their digests are broadcast.
_FEW_REPEATED = 1 << 16
#: Shares of the documents between which a term's frequency lies.
LEAST_SHARE, MOST_SHARE = 1e-4, 0.1
_SEED = np.uint64(0x9E3779B97F4A7C15)
_DIGITS = 4
_EMPTY = "0" * _DIGITS


def terms(text: str) -> np.ndarray:
    """Sorted distinct 64-bit term hashes."""
    return np.unique(word_hashes(words(text)))


def term_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every text once. Only texts that repeat are shuffled, and one of each per task."""
    digested = docs.select(F.coalesce(F.col(text), F.lit("")).alias(text)).withColumn("_digest", F.md5(text))
    repeated = stored(
        digested.groupBy("_digest").count().where("count > 1").select("_digest", F.lit(True).alias("_again")),
        "imatch-repeated",
    )
    few = repeated.count() <= _FEW_REPEATED
    marked = digested.join(F.broadcast(repeated) if few else repeated, "_digest", "left")
    once = marked.where(F.col("_again").isNull()).select(text)
    return once.unionByName(marked.where("_again").groupBy("_digest").agg(F.first(text).alias(text)).select(text))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, text: str = "text") -> np.ndarray:
    """One bit per term slot, set where the document frequency lies in the band."""
    small_batches(docs.sparkSession)
    docs = distinct_texts(docs, text)
    documents = docs.count()
    width = 1 << SLICE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << TERM_BITS, np.int64)
        for batch in batches:
            found = [np.unique(term_slots(terms(t or ""))) for t in batch.column(0).to_pylist()]
            if found:
                total += np.bincount(np.concatenate(found), minlength=len(total))
        slices = np.flatnonzero(total.reshape(-1, width).any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slices, pa.int32()),
                pa.array([np.flatnonzero(total[s * width : (s + 1) * width]).astype("<u2").tobytes() for s in slices], pa.binary()),
                pa.array([(lambda c: c[c > 0])(total[s * width : (s + 1) * width]).tobytes() for s in slices], pa.binary()),
            ],
            names=["slice", "places", "counts"],
        )

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                held = sums.setdefault(s, np.zeros(width, np.int64))
                held[np.frombuffer(places, "<u2")] += np.frombuffer(counts, np.int64)
        bits = [np.packbits((c > 0) & (c >= least * documents) & (c <= max(1.0, most * documents))).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["slice", "bits"]
        )

    counted = docs.select(text).mapInArrow(count, "slice int, places binary, counts binary")
    rows = counted.repartition("slice").mapInArrow(band, "slice int, bits binary").collect()
    inside = np.zeros(1 << TERM_BITS, bool)
    for r in rows:
        inside[r["slice"] * width : (r["slice"] + 1) * width] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    return np.packbits(inside)


def fingerprint(found: np.ndarray, inside: np.ndarray) -> str:
    """Hashes of the terms in each subset, four hexadecimal digits each; zeros for no terms."""
    from xxhash import xxh3_64_intdigest

    slots = term_slots(found)
    within = (inside[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1
    mixed = (found ^ (found >> np.uint64(31))) * _SEED
    mixed ^= mixed >> np.uint64(29)
    digests = []
    for bits, subsets in SUBSETS:
        drawn = mixed & np.uint64((1 << bits) - 1)
        mixed = mixed >> np.uint64(bits)
        for k in range(subsets):
            chosen = found[drawn == k] if k % FROM_ALL == 0 else found[(drawn == k) & within]
            digests.append(f"{xxh3_64_intdigest(chosen.tobytes()) % 0xFFFF + 1:04x}" if len(chosen) else _EMPTY)
    return "".join(digests)


def likeness(one: str, other: str) -> float:
    pairs = [(one[k : k + _DIGITS], other[k : k + _DIGITS]) for k in range(0, len(one), _DIGITS)]
    held = [a == b for a, b in pairs if a != _EMPTY or b != _EMPTY]
    return sum(held) / len(held) if held else 1.0


def edited_text(text: str, following: str) -> str:
    """The last half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RESULT_NAMES = [f.split()[0] for f in _RESULT.split(", ")]
_RESULT_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_DONE, _FIRST, _LAST = 0, 1, 2


def edited_fingerprints(docs: DataFrame, inside: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Texts are dealt by ranges of descending ids and walked in order, so each is shuffled once.
    The last text of a range meets the first of the next range in a second, small step.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()

    def results(pairs: list[tuple[str, str, str, str]]) -> list[tuple]:
        rows = []
        for mine, own, theirs, other in pairs:
            changed = edited_text(mine, theirs)
            print_ = fingerprint(terms(changed), inside)
            rows.append(
                (len(mine), sha256(changed.encode()).hexdigest(), own, print_, likeness(own, print_), likeness(own, other))
            )
        return rows

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def out(state: int, keys: pa.Array, rows: list[tuple], texts: list[str | None]) -> pa.RecordBatch:
            n = len(texts)
            columns = [pa.array([state] * n, pa.int32()), pa.array([part] * n, pa.int32()), keys]
            columns += [pa.array([r[k] for r in rows] if rows else [None] * n, t) for k, t in enumerate(_RESULT_KINDS)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.string())], names=["state", "part", "doc_id", *_RESULT_NAMES, "text"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [fingerprint(terms(t), inside) for t in texts]
            keys = batch.column(0)
            if held is None:
                yield out(_FIRST, keys.slice(0, 1), [], texts[:1])
            else:
                keys = pa.concat_arrays([held[0], keys])
                texts, prints = [held[1], *texts], [held[2], *prints]
            rows = results(list(zip(texts, prints, texts[1:], prints[1:])))
            if rows:
                yield out(_DONE, keys.slice(0, len(rows)), rows, [None] * len(rows))
            held = (keys.slice(len(keys) - 1, 1), texts[-1], prints[-1])
        if held is not None:
            yield out(_LAST, held[0], [], [held[1]])

    ordered = (
        docs.select(F.col(doc_id), F.col(text))
        .repartitionByRange(F.col(doc_id).desc_nulls_last())
        .sortWithinPartitions(F.col(doc_id).desc_nulls_last(), F.col(text))
    )
    walked = stored(
        ordered.mapInArrow(walk, f"state int, part int, doc_id {kind}, {_RESULT}, text string"), "imatch-walk"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = results(
                [(a, fingerprint(terms(a), inside), b, fingerprint(terms(b), inside)) for a, b in zip(mine, theirs)]
            )
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(_RESULT_KINDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_RESULT_NAMES])

    # One row per range that has documents.
    firsts = walked.where(F.col("state") == _FIRST)
    around = Window.partitionBy(F.lit(0)).orderBy("part")
    order = firsts.select("part").select(
        "part", F.coalesce(F.lead("part").over(around), F.first("part").over(around)).alias("_next")
    )
    lasts = walked.where(F.col("state") == _LAST).select("part", "doc_id", "text")
    met = (
        lasts.join(order, "part")
        .join(firsts.select(F.col("part").alias("_next"), F.col("text").alias("_following")), "_next")
        .select("doc_id", "text", "_following")
        .mapInArrow(meet, f"doc_id {kind}, {_RESULT}")
    )
    return walked.where(F.col("state") == _DONE).select("doc_id", *_RESULT_NAMES).unionByName(met)
