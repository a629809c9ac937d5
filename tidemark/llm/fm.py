"""A quality classifier: a factorisation machine over hashed words and structure.

A document's features are its distinct lower-cased words hashed to ``WORD_SLOTS``, one step
of a scale per structure statistic, and its length. The score is the logistic of

    bias + sum(w_i x_i) + 1/2 sum_k ((sum_i v_ik x_i)**2 - sum_i (v_ik x_i)**2)

which costs time linear in the features. Ids, sources, languages and labels are no features.

The model is fitted on the driver on at most ``per_label`` labelled rows of each label, those
whose ids hash lowest among the ids that are not held out; each gives at most ``SLOTS`` numbers.

Defined cases: a NULL or empty text has only structure features and gets a score too; labels
other than 0 and 1 and labels without a document are ignored; without both labels every score
is 0.5; repeated rows get equal scores; an empty table gives an empty result; other columns are
carried by ``reject`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.measures import base_counts, repeated_words
from tidemark.llm.shingles import word_hashes
from tidemark.llm.store import small_batches

WORD_SLOTS = 1 << 13
STEPS = 12
RATES = 10
SLOTS = WORD_SLOTS + STEPS * (RATES + 2)
FACTORS = 8
PER_LABEL = 3000
HELD_OUT = 5
THRESHOLD = 0.3
_SCALE = np.array([0.001, 0.005, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def structure(text: str, found: list[bytes]) -> list[int]:
    """The steps of all statistics, each from 0 to ``STEPS`` - 1."""
    n, word_chars, symbols, dup_lines, repeats = base_counts(text, found, repeated_words(found))
    words, chars = max(n, 1), max(word_chars, 1)
    lines = text.count("\n") + 1
    rates = [
        symbols / words / 2,
        repeats / words,
        dup_lines / lines,
        sum(map(bytes.isupper, found)) / words,
        sum(map(eq, found, found[1:])) / words,
        text.count("!") / words / 2,
        sum(map(text.count, "0123456789")) / chars,
        (text.count(".") + text.count(",")) / words,
        1 - len(set(found)) / words,
        min(1.0, chars / words / 20),
    ]
    steps = np.searchsorted(_SCALE, rates).tolist()
    sizes = [min(STEPS - 1, n.bit_length()), min(STEPS - 1, lines.bit_length())]
    return steps + sizes


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values; the words' part and the structure's part have length 1 each."""
    text = text or ""
    found = text.encode().split()
    slots = np.empty(0, np.int64)
    values = np.empty(0, np.float32)
    if found:
        hashed = word_hashes([w.lower() for w in found]) % np.uint64(WORD_SLOTS)
        counts = np.bincount(hashed.astype(np.int64), minlength=WORD_SLOTS)
        slots = np.flatnonzero(counts)
        values = np.log1p(counts[slots]).astype(np.float32)
        values /= np.float32(np.sqrt((values**2).sum()))
    steps = structure(text, found)
    places = WORD_SLOTS + np.arange(len(steps)) * STEPS + np.array(steps)
    flat = np.full(len(steps), 1 / np.sqrt(len(steps)), np.float32)
    return np.concatenate([slots, places]), np.concatenate([values, flat])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic, of documents whose features begin at ``starts``."""
        weighted = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat(weighted**2, starts, axis=0)
        return (
            self.bias
            + np.add.reduceat(self.linear[slots] * values, starts)
            + 0.5 * (sums**2 - squares).sum(axis=1)
        )


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(
    rows: list[tuple[int, np.ndarray, np.ndarray]],
    epochs: int = 12,
    batch: int = 128,
    rate: float = 0.03,
    decay: float = 1e-4,
    seed: int = 11,
) -> Machine:
    """Adam on the logistic loss, both labels weighing the same."""
    random = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(SLOTS), random.normal(0, 0.05, (SLOTS, FACTORS)))
    labels = np.array([r[0] for r in rows], float)
    if len(set(labels.tolist())) < 2:
        return Machine(0.0, np.zeros(SLOTS), np.zeros((SLOTS, FACTORS)))
    share = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    theta = np.concatenate([[0.0], machine.linear, machine.factors.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for low in range(0, len(rows), batch):
            chosen = order[low : low + batch]
            sizes = np.array([len(rows[i][1]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            slots = np.concatenate([rows[i][1] for i in chosen])
            values = np.concatenate([rows[i][2] for i in chosen]).astype(float)
            machine = Machine(theta[0], theta[1 : 1 + SLOTS], theta[1 + SLOTS :].reshape(SLOTS, FACTORS))
            error = (logistic(machine.margins(slots, values, starts)) - labels[chosen]) * share[chosen] / len(chosen)
            each = np.repeat(error, sizes)
            held = machine.factors[slots]
            sums = np.repeat(np.add.reduceat(held * values[:, None], starts, axis=0), sizes, axis=0)
            pull = each[:, None] * (values[:, None] * sums - held * values[:, None] ** 2)
            gradient = np.concatenate(
                [
                    [error.sum()],
                    np.bincount(slots, each * values, SLOTS),
                    np.stack([np.bincount(slots, pull[:, k], SLOTS) for k in range(FACTORS)], axis=1).ravel(),
                ]
            )
            gradient[1:] += decay * theta[1:]
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(
        float(theta[0]),
        theta[1 : 1 + SLOTS].astype(np.float32),
        theta[1 + SLOTS :].reshape(SLOTS, FACTORS).astype(np.float32),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % HELD_OUT == 0, F.lit(False))


def training_ids(labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """At most ``per_label`` ids of each label (label, doc_id): those that hash lowest."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("quality").alias("label"))
    chosen = [
        known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        for label in (0, 1)
    ]
    return reduce(DataFrame.unionByName, chosen)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, text: str = "text") -> Machine:
    """Fit on a bounded sample. Only the sample's features reach the driver."""
    small_batches(docs.sparkSession)
    ids = training_ids(labels, per_label).dropDuplicates(["doc_id"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(batch.column(1).cast(pa.int32())),
                    pa.array([s.astype("<i4").tobytes() for s, _ in found], pa.binary()),
                    pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()),
                ],
                names=["doc_id", "label", "slots", "values"],
            )

    # At most twice per_label rows, so the smaller side is bounded.
    chosen = docs.select("doc_id", text).join(F.broadcast(ids), "doc_id").select("doc_id", "label", text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.mapInArrow(scan, f"doc_id {kind}, label int, slots binary, values binary")
    found = rows.dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda r: r["doc_id"])
    return fit(
        [(r["label"], np.frombuffer(r["slots"], "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4")) for r in found]
    )


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """``docs`` with score; every whole text."""
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            scores = np.empty(0)
            if found:
                starts = np.concatenate([[0], np.cumsum([len(s) for s, _ in found])[:-1]])
                scores = logistic(
                    machine.margins(
                        np.concatenate([s for s, _ in found]), np.concatenate([v for _, v in found]), starts
                    ).astype(float)
                )
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*columns, "score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns).mapInArrow(scan, f"{schema}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def reject(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    scored = score(docs.withColumnRenamed("score", "_own_score") if "score" in docs.columns else docs, machine)
    kept = scored.where(F.col("score") >= threshold).drop("score")
    return kept.withColumnRenamed("_own_score", "score") if "score" in docs.columns else kept
