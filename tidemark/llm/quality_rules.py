"""Quality rules by line sequence labelling.

A linear-chain conditional random field has two labels for a line, content and boilerplate. Each
line is described by a few yes-or-no features; Viterbi decoding finds the likeliest labels of all
lines of a text together, and the share of words in content lines decides whether it is kept.

The field is fitted on the driver on lines of at most ``per_label`` labelled documents of each quality.
Labels of lines are latent. The quality of a document is a noisy sight of each of its lines (``SEEN``): bad
documents hold content too, good ones some boilerplate. A line of licence, navigation or account words
(``_NOTICE``) is seen as boilerplate in any document. The chances of each line's label come from the
likelihood of the sights, lines apart, so that a document's one label does not pass for likeness of its
neighbouring lines; the field is then the maximum likelihood for these chances. Only each line's feature bits reach the driver: of a text of more than ``WINDOWS`` times ``SEQUENCE`` lines the
``WINDOWS`` runs of ``SEQUENCE`` lines with the lowest hash, chosen in the scan, so that every label and
document has a budget of its own.

Defined cases: a NULL or empty text has no words, fails the base rules and is not kept; a text
without a content line is not kept; without labels of both kinds every line is content; repeated
rows get equal verdicts; of repeated ids the lowest label and the lowest feature bits are fitted; an empty table gives an empty result; ``keep`` carries other columns.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.fm import training_ids
from tidemark.llm.measures import base_counts, repeated_words
from tidemark.llm.store import small_batches

FEATURES = 13
NOTICE = 12
PER_LABEL = 1000
SEQUENCE = 100
WINDOWS = 2
# SEEN[sight, label]: the chance that a line of a label is seen as boilerplate (0) or as content (1).
SEEN = np.array([[0.95, 0.25], [0.05, 0.75]])
CONTENT_SHARE = 0.5
LEAST_WORDS = 50
_SYMBOL = re.compile(rb"[#*$%&|<>]")
_DIGIT = re.compile(rb"[0-9]")
_NOTICE = re.compile(
    rb"licen[sc]ed?\b|copyright|all rights reserved|terms of (use|service)|privacy policy|cookies?\b"
    rb"|subscribe|newsletter|click here|sign (in|up)\b|log ?in\b|javascript|share this|read more",
    re.IGNORECASE,
)


@dataclass
class Field:
    """Weights: ``lines[label, feature]``, ``steps[label, next label]``, ``starts[label]``.

    Label 1 is content.
    """

    lines: np.ndarray
    steps: np.ndarray
    starts: np.ndarray


def line_features(text: str) -> tuple[list[int], list[int], list[bytes], np.ndarray]:
    """Per line with words its feature bits and its number of words; the words; repeated ones."""
    raw = text.encode().split(b"\n")
    split = [line.split() for line in raw]
    found = [w for line in split for w in line]
    covered = repeated_words(found)
    before = np.concatenate([[0], np.cumsum(covered)]).tolist()
    times = Counter(line for line, words in zip(raw, split) if words)
    bits, sizes, at = [], [], 0
    for line, words in zip(raw, split):
        n = len(words)
        if not n:
            continue
        repeats = before[at + n] - before[at]
        at += n
        symbols = len(_SYMBOL.findall(line))
        doubled = sum(map(eq, words, words[1:]))
        bits.append(
            1
            | (symbols > 0) << 1
            | (symbols * 4 >= n) << 2
            | line.isupper() << 3
            | (line.count(b"!!") * 4 >= n) << 4
            | (times[line] > 1) << 5
            | (repeats * 2 >= n) << 6
            | (doubled * 4 >= n) << 7
            | (line.count(b"|") * 4 >= n) << 8
            | (n <= 2) << 9
            | (n >= 40) << 10
            | (len(_DIGIT.findall(line)) >= n) << 11
            | (n < 40 and _NOTICE.search(line) is not None) << NOTICE
        )
        sizes.append(n)
    return bits, sizes, found, covered


def unpacked(bits: list[int] | np.ndarray) -> np.ndarray:
    return (np.asarray(bits, np.int64)[:, None] >> np.arange(FEATURES)) & 1


def viterbi(field: Field, bits: list[int]) -> list[int]:
    """The likeliest labels of a sequence of lines; on a tie content."""
    if not bits:
        return []
    scores = (unpacked(bits) @ field.lines.T).tolist()
    (s00, s01), (s10, s11) = field.steps.tolist()
    a, b = scores[0][0] + field.starts[0], scores[0][1] + field.starts[1]
    back = []
    for e0, e1 in scores[1:]:
        stay0, from1 = a + s00, b + s10
        from0, stay1 = a + s01, b + s11
        back.append((from1 >= stay0, stay1 >= from0))
        a, b = max(stay0, from1) + e0, max(from0, stay1) + e1
    label = int(b >= a)
    labels = [label]
    for choice in reversed(back):
        label = int(choice[label])
        labels.append(label)
    labels.reverse()
    return labels


def _expected(emit, moves, starts, lengths, active, inside) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each line's label and of each pair of neighbouring labels, by forward and backward sums."""
    n, longest = emit.shape[:2]
    forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
    forward[:, 0] = starts + emit[:, 0]
    for t in range(1, longest):
        m = active[t]
        forward[:m, t] = np.logaddexp.reduce(forward[:m, t - 1, :, None] + moves, axis=1) + emit[:m, t]
    for t in range(longest - 2, -1, -1):
        m = active[t + 1]
        ahead = backward[:m, t + 1] + emit[:m, t + 1]
        backward[:m, t] = np.logaddexp.reduce(moves + ahead[:, None, :], axis=2)
    total = np.logaddexp.reduce(forward[np.arange(n), lengths - 1], axis=1)
    chance = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * inside[..., None]
    joint = forward[:, :-1, :, None] + moves + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]
    return chance, np.exp(np.minimum(joint, 0)) * inside[:, 1:, None, None]


def _adam(gradient, size: int, steps: int, rate: float = 0.1, decay: float = 2e-5) -> np.ndarray:
    theta, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        found = gradient(theta) + decay * theta
        first = 0.9 * first + 0.1 * found
        second = 0.999 * second + 0.001 * found**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta


def sighted(bits: np.ndarray, labels: np.ndarray, steps: int = 400) -> np.ndarray:
    """Chance that each line is content, given its bits and its document's label, both labels weighing the same.

    The likelihood of the sights is summed over the line's own two labels. Equal lines are counted first.
    """
    sights = np.where((bits >> NOTICE) & 1 > 0, 0, labels).astype(np.int64)
    weights = (0.5 / np.bincount(labels, minlength=2))[labels]
    kinds, place = np.unique(bits.astype(np.int64) << 1 | sights, return_inverse=True)
    mass = np.bincount(place, weights)
    x, seen = unpacked(kinds >> 1).astype(float), SEEN[kinds & 1]

    def content(theta):
        chance = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        given = chance * seen[:, 1] / (chance * seen[:, 1] + (1 - chance) * seen[:, 0])
        return chance, given

    def gradient(theta):
        chance, given = content(theta)
        return x.T @ (mass * (chance - given))

    return content(_adam(gradient, FEATURES, steps))[1][place]


def fit(sequences: list[tuple[int, np.ndarray]], steps: int = 200) -> Field:
    """The field for (quality of the document, bits of its lines)."""
    sequences = [(label, bits) for label, bits in sequences if len(bits)]
    if len({label for label, _ in sequences}) < 2:
        return Field(np.zeros((2, FEATURES)), np.zeros((2, 2)), np.zeros(2))
    sequences = sorted(sequences, key=lambda s: -len(s[1]))
    n, longest = len(sequences), len(sequences[0][1])
    lengths = np.array([len(s) for _, s in sequences])
    labels = np.array([label for label, _ in sequences])
    inside = np.arange(longest)[None, :] < lengths[:, None]
    active = inside.sum(axis=0)  # sequences are sorted, so the first ``active[t]`` reach line t
    bits = np.concatenate([b for _, b in sequences])
    x, given = np.zeros((n, longest, FEATURES)), np.zeros((n, longest, 2))
    x[inside] = unpacked(bits)
    given[inside, 1] = sighted(bits, np.repeat(labels, lengths))
    given[inside, 0] = 1 - given[inside, 1]
    # Both labels weigh the same per line.
    weight = (0.5 / np.array([lengths[labels == k].sum() for k in (0, 1)], float))[labels]
    pairs = given[:, :-1, :, None] * given[:, 1:, None, :]

    def parts(theta):
        return theta[: 2 * FEATURES].reshape(2, -1), theta[-6:-2].reshape(2, 2), theta[-2:]

    def gradient(theta):
        lines, moves, starts = parts(theta)
        free, steps = _expected(x @ lines.T, moves, starts, lengths, active, inside)
        excess = (free - given) * weight[:, None, None]
        stepped = ((steps - pairs) * weight[:, None, None, None]).sum(axis=(0, 1))
        return np.concatenate([np.einsum("ntk,ntf->kf", excess, x).ravel(), stepped.ravel(), excess[:, 0].sum(axis=0)])

    return Field(*parts(_adam(gradient, 2 * FEATURES + 6, steps)))


def chosen_runs(bits: list[int]) -> bytes:
    """The bits of a text's lines, or of ``WINDOWS`` whole runs of lines of a text that has more."""
    runs = [np.array(bits[low : low + SEQUENCE], "<i2").tobytes() for low in range(0, len(bits), SEQUENCE)]
    if len(runs) > WINDOWS:
        whole = [k for k, run in enumerate(runs) if len(run) == 2 * SEQUENCE]
        lowest = sorted(whole, key=lambda k: (zlib.crc32(b"%d:" % k + runs[k]), k))[:WINDOWS]
        runs = [runs[k] for k in sorted(lowest)]
    return b"".join(runs)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, text: str = "text") -> Field:
    small_batches(docs.sparkSession)
    ids = training_ids(labels, per_label).groupBy("doc_id").agg(F.min("label").alias("label"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [chosen_runs(line_features(t or "")[0]) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array(bits, pa.binary())],
                names=["doc_id", "label", "bits"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # At most twice per_label rows, each of at most WINDOWS * SEQUENCE lines.
    chosen = docs.select("doc_id", text).join(F.broadcast(ids), "doc_id").select("doc_id", "label", text)
    rows = chosen.mapInArrow(scan, f"doc_id {kind}, label int, bits binary")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("bits").alias("bits"))
    sequences = []
    for r in sorted(rows.collect(), key=lambda r: r["doc_id"]):
        bits = np.frombuffer(r["bits"], "<i2")
        sequences += [(r["label"], bits[low : low + SEQUENCE]) for low in range(0, len(bits), SEQUENCE)]
    return fit(sequences)


_VERDICT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, content_words bigint, content_share double, kept boolean"
)
VERDICT_COLUMNS = [field.split()[0] for field in _VERDICT.split(", ")]


def verdict(text: str | None, field: Field, share: float = CONTENT_SHARE) -> tuple:
    text = text or ""
    bits, sizes, found, covered = line_features(text)
    counts = base_counts(text, found, covered)
    n, repeats = counts[0], counts[4]
    failed = n < LEAST_WORDS or 100 * repeats > 50 * n
    content = sum(size for size, label in zip(sizes, viterbi(field, bits)) if label)
    return (*counts, failed, content, content / n if n else 0.0, bool(not failed and content >= share * n))


def judge(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the verdict; columns of the same names are replaced."""
    small_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in VERDICT_COLUMNS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.bool_()]
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [verdict(t, field) for t in batch.column(at).to_pylist()]
            added = [pa.array([v[k] for v in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*columns, *VERDICT_COLUMNS])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns).mapInArrow(scan, f"{schema}, {_VERDICT}")


def keep(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    own = {c: f"_own_{c}" for c in docs.columns if c in VERDICT_COLUMNS}
    judged = judge(docs.withColumnsRenamed(own), field).where("kept").drop(*VERDICT_COLUMNS)
    return judged.withColumnsRenamed({v: k for k, v in own.items()})
