"""Stupid-backoff scores of texts by the bigrams of all other texts.

    S(w | v) = c(v w) / c(v)      if another text has the bigram
             = 0.4 * c(w) / N     otherwise

A text's score is the mean of log S over its words, the first one by its count alone. Counts are
taken over all documents, less those of the text itself.

Word and bigram counts are tables partitioned by hash. A batch of documents sends every partition its
distinct words (all 64 bits of hash) and bigrams (five bytes of hash beside the partition's number)
with their totals in the batch. The partition counts them and sends the counts back, in the order they
came. The batch's words travel along as places in its list of distinct words, so the scores are
put together where the counts arrive. A word or bigram found everywhere costs one entry per batch.

Defined cases: a NULL or wordless text has no words, log_score 0 and a NULL score; words in no
other text count half; repeated rows are texts of their own and so count for each other; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shingles import word_hashes, words
from tidemark.llm.store import small_batches, stored

BACKOFF = 0.4
#: Bits of hash by which words are told apart: all of them.
SLOT_BITS = 64
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HEAD, _WORDS, _BIGRAMS = 0, 1, 2
#: Bits of hash that are not sent; the partition's number has some of them.
_DROPPED = {_WORDS: 64 - SLOT_BITS, _BIGRAMS: 24}


def _packed(values: np.ndarray) -> bytes:
    """Compressed byte planes of numbers, as many planes as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _bigrams(keys: np.ndarray, places: np.ndarray, owner: np.ndarray):
    """Distinct bigrams of a batch, and of every word that has one before it in its text its place and bigram."""
    second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    hashes = keys[places[second - 1]] * _LEFT + keys[places[second]] * _RIGHT
    distinct, which = np.unique(hashes, return_inverse=True)
    return distinct, second, which


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which keys are sent, and where each partition's begin."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _own(owner: np.ndarray, which: np.ndarray, distinct: int) -> np.ndarray:
    """How often the text of each occurrence has the same."""
    _, inverse, times = np.unique(owner * max(distinct, 1) + which, return_inverse=True, return_counts=True)
    return times[inverse]


_DEALT = "part int, batch bigint, kind int, a binary, b binary, ids array<{kind}>"
_NAMES = ["part", "batch", "kind", "a", "b", "ids"]


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_counts, n_missing) of every document.

    ``log_counts`` is the score without the logarithms of N, of which there are ``n_missing``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            name = (task << 32) | number
            found = [word_hashes(words(t)) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(f) for f in found], "<i8")
            keys, places, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(found)), sizes)
            pairs, _, which = _bigrams(keys, places, owner)
            # Frequent words get small numbers, which take less room.
            rank = np.empty(len(keys), np.int64)
            rank[np.argsort(-times, kind="stable")] = np.arange(len(keys))
            heads = [_packed(x) for x in (sizes, rank[places], times, _steps(keys))]
            lengths = np.array([len(h) for h in heads], "<i8").tobytes()
            rows = [(name % parts, name, _HEAD, lengths + b"".join(heads), None, batch.column(0).to_pylist())]
            for sort, sent, often in ((_WORDS, keys, times), (_BIGRAMS, pairs, np.bincount(which, minlength=len(pairs)))):
                order, cuts = _by_part(sent, parts)
                # Ascending in each partition: the keys are, and the order keeps that.
                sent, often = sent[order] >> np.uint64(_DROPPED[sort]), often[order]
                for p in np.flatnonzero(np.diff(cuts)):
                    low, high = cuts[p], cuts[p + 1]
                    rows.append((int(p), name, sort, _packed(_steps(sent[low:high])), _packed(often[low:high]), None))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(batch.schema.field(0).type)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=_NAMES)

    def count(table: pa.Table) -> pa.Table:
        """The counts of one partition's words and bigrams, for each batch that sent them."""
        columns = [table.column(n).to_pylist() for n in ("part", "batch", "kind", "a", "b")]
        rows = list(zip(*columns))
        out = []
        for sort in (_WORDS, _BIGRAMS):
            sent = [r for r in rows if r[2] == sort]
            if not sent:
                continue
            keys = [np.cumsum(_unpacked(r[3]), dtype=np.uint64) for r in sent]
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.concatenate([_unpacked(r[4]) for r in sent])
            total = np.bincount(inverse, times)[inverse].astype(np.uint64)
            at = 0
            for (part, batch, *_), mine in zip(sent, keys):
                out.append((part, batch, sort, _packed(total[at : at + len(mine)])))
                at += len(mine)
        answers = pa.table(
            {
                "part": pa.array([o[0] for o in out], pa.int32()),
                "batch": pa.array([o[1] for o in out], pa.int64()),
                "kind": pa.array([o[2] for o in out], pa.int32()),
                "a": pa.array([o[3] for o in out], pa.binary()),
                "b": pa.nulls(len(out), pa.binary()),
                "ids": pa.nulls(len(out), table.schema.field("ids").type),
            }
        )
        heads = table.select(_NAMES).take(pa.array([i for i, r in enumerate(rows) if r[2] == _HEAD], pa.int64()))
        return pa.concat_tables([heads, answers.cast(heads.schema)])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores per document; rows come batch by batch, the documents first, then counts by partition."""
        held: dict = {}
        id_type = None

        def totals(keys: np.ndarray, answers: list[bytes]) -> np.ndarray:
            order, _ = _by_part(keys, parts)
            out = np.empty(len(keys))
            if answers:
                out[order] = np.concatenate([_unpacked(a) for a in answers])
            return out

        def finish() -> pa.RecordBatch:
            size = len(held["ids"])
            ends = 32 + np.cumsum(np.frombuffer(held["head"][:32], "<i8"))
            sizes, ranks, times, steps = (_unpacked(held["head"][a:b]) for a, b in zip([32, *ends], ends))
            sizes, times = sizes.astype(np.int64), times.astype(np.int64)
            keys = np.cumsum(steps, dtype=np.uint64)
            places = np.argsort(-times, kind="stable")[ranks.astype(np.int64)]
            owner = np.repeat(np.arange(size), sizes)
            alone = totals(keys, held[_WORDS])[places] - _own(owner, places, len(keys))
            alone = np.log(np.maximum(alone, 0.5))
            pairs, second, which = _bigrams(keys, places, owner)
            others = totals(pairs, held[_BIGRAMS])[which] - _own(owner[second], which, len(pairs))
            hit = others > 0
            gains = alone.copy()
            gains[second] += np.log(BACKOFF)
            gains[second[hit]] = np.log(others[hit]) - alone[second[hit] - 1]
            missing = sizes - np.bincount(owner[second[hit]], minlength=size)
            return pa.RecordBatch.from_arrays(
                [pa.array(held["ids"], id_type), pa.array(sizes), pa.array(np.bincount(owner, gains, size)), pa.array(missing)],
                names=["doc_id", "n_words", "log_counts", "n_missing"],
            )

        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for r in batch.to_pylist():
                if r["kind"] == _HEAD:
                    if held:
                        yield finish()
                    held = {"ids": r["ids"], "head": r["a"], _WORDS: [], _BIGRAMS: []}
                else:
                    held[r["kind"]].append(r["a"])
        if held:
            yield finish()

    dealt = docs.select(F.col(doc_id), F.col(text)).mapInArrow(deal, _DEALT.format(kind=kind))
    return (
        dealt.groupBy("part")
        .applyInArrow(count, _DEALT.format(kind=kind))
        .repartition("batch")
        .sortWithinPartitions("batch", "kind", "part")
        .mapInArrow(combine, f"doc_id {kind}, n_words bigint, log_counts double, n_missing bigint")
    )


def score_by_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, score) of every document by the counts of all others."""
    found = stored(counted(docs, doc_id, text), "lm-counts")
    n_all = found.agg(F.sum("n_words")).first()[0] or 0
    others = F.greatest(F.lit(n_all) - F.col("n_words"), F.lit(1)).cast("double")
    log_score = F.col("log_counts") - F.col("n_missing") * F.log(others)
    return found.select(
        "doc_id",
        "n_words",
        log_score.alias("log_score"),
        F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("score"),
    )
