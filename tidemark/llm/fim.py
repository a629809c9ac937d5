"""Fill-in-middle texts, cut at tokens that are counted per content-defined chunk.

A token is a word with the blanks before it, or the blanks at the end of a text. A rolling hash
over 32 bytes cuts texts into chunks of about a kilobyte, so texts that share a passage share its
chunks. What a chunk adds to a text's count is a summary of its own bytes: how often a word ends
inside it, its characters, and whether it begins and ends in a word. A worker keeps the summaries
of the chunks it has met, and takes one again only for a chunk of the very same bytes. Sums of the
summaries place each cut in one chunk, and only that chunk is read once more.

Only texts go to Python and only counts come back; output and restored text are columns.

Defined cases: a NULL text is empty; an empty text is plain with no tokens; a NULL id is cut as
the empty id; repeated rows get equal results; an empty table gives an empty result; extra columns are kept
unless the result has one of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80

WINDOW = 32
CHUNK_BITS = 10
LONGEST_CHUNK = 1 << 16
#: Bytes of chunks in each of a worker's two generations.
KEPT_BYTES = 24 << 20

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """A hash of the last 32 bytes at every byte; each step doubles the bytes it spans."""
    total = _GEAR[data]
    span = 1
    while span < WINDOW:
        total[span:] = total[span:] + (total[:-span] << np.uint32(span))
        span *= 2
    return total


def chunk_ends(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all texts ``data[begins:ends]``, in order.

    A chunk ends where the top bits of the hash are 0, at a text's end, or after LONGEST_CHUNK bytes.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    found = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    # The window of a cut lies in the text itself, so equal texts have equal chunks.
    text = np.searchsorted(ends, found, "left")
    found = found[found - begins[text] >= WINDOW]
    found = np.union1d(found, ends[ends > begins])
    long = np.flatnonzero(np.diff(found, prepend=0) > LONGEST_CHUNK)
    more = [np.arange((found[k - 1] if k else 0) + LONGEST_CHUNK, found[k], LONGEST_CHUNK) for k in long]
    return np.union1d(found, np.concatenate(more)) if more else found


class ChunkCounts:
    """Summaries (word ends inside, characters, begins in a word, ends in a word) by content."""

    def __init__(self, kept_bytes: int = KEPT_BYTES):
        self.kept_bytes, self.size = kept_bytes, 0
        self.young: dict[int, tuple[bytes, tuple]] = {}
        self.old: dict[int, tuple[bytes, tuple]] = {}
        self.hits = 0

    def _keep(self, key: int, chunk: bytes, summary: tuple) -> None:
        if self.size > self.kept_bytes:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = (chunk, summary)
        self.size += len(chunk) + 200

    def of(self, chunks: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        keys = list(map(xxh3_64_intdigest, chunks))
        rows: list[tuple | None] = [None] * len(chunks)
        fresh: dict[bytes, list[int]] = {}
        for k, (key, chunk) in enumerate(zip(keys, chunks)):
            found = self.young.get(key) or self.old.get(key)
            if found is not None and found[0] == chunk:
                self.hits += 1
                rows[k] = found[1]
                if key not in self.young:
                    self._keep(key, chunk, found[1])
            else:
                fresh.setdefault(chunk, []).append(k)
        if fresh:
            for (chunk, places), summary in zip(fresh.items(), self._count(list(fresh))):
                for k in places:
                    rows[k] = summary
                self._keep(keys[places[0]], chunk, summary)
        return np.array(rows, np.int64).reshape(-1, 4)

    @staticmethod
    def _count(chunks: list[bytes]) -> Iterator[tuple]:
        data = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum([len(c) for c in chunks])
        begins = np.concatenate([[0], ends[:-1]])
        word = ~_BLANK[data]
        closed = np.zeros(len(data) + 1, np.int64)
        np.cumsum(np.concatenate([[False], word[:-1] & ~word[1:]]), out=closed[1:])
        # The transition into a chunk's first byte belongs to the sums, not to the chunk.
        inside = closed[ends] - closed[begins + 1]
        leads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
        return zip(inside.tolist(), (leads[ends] - leads[begins]).tolist(), word[begins].tolist(), word[ends - 1].tolist())


def _word_ends(chunk: np.ndarray, after_word: bool) -> np.ndarray:
    """Places in a chunk where a word ends that began before the place."""
    word = ~_BLANK[chunk]
    return np.flatnonzero(np.concatenate([[after_word], word[:-1]]) & ~word)


def locate(data: np.ndarray, bounds: np.ndarray, draws: np.ndarray, counts: ChunkCounts) -> tuple[np.ndarray, ...]:
    """(tokens, prefix characters, middle characters) of texts ``data[bounds[i]:bounds[i + 1]]``.

    ``draws`` has two numbers per text, taken modulo its tokens plus one.
    """
    begins, ends = bounds[:-1], bounds[1:]
    stops = chunk_ends(data, begins, ends)
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    raw = data.tobytes()
    summary = counts.of([raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
    inside, chars, first_word, last_word = summary.T
    # Per text: chunks low[i] to high[i].
    low, high = np.searchsorted(stops, begins, "right"), np.searchsorted(stops, ends, "right")
    heads = np.isin(starts, begins)
    after_word = np.concatenate([[0], last_word[:-1]]).astype(bool) & ~heads if len(stops) else np.zeros(0, bool)
    ended = np.concatenate([[0], np.cumsum(inside + (after_word & (first_word == 0)))])
    passed = np.concatenate([[0], np.cumsum(chars)])

    filled = high > low
    # One more token: the word at the end, or the blanks there.
    tokens = ended[high] - ended[low] + filled
    cuts = np.sort(draws % (tokens[:, None] + 1), axis=1)
    places = np.zeros(cuts.shape, np.int64)
    for side in (0, 1):
        unit = cuts[:, side]
        places[:, side] = np.where(unit == tokens, passed[high] - passed[low], 0)
        within = np.flatnonzero((unit > 0) & (unit < tokens))
        wanted = ended[low[within]] + unit[within]
        chunk = np.searchsorted(ended, wanted, "left") - 1
        for text, k, nth in zip(within.tolist(), chunk.tolist(), (wanted - ended[chunk]).tolist()):
            piece = data[starts[k] : stops[k]]
            place = _word_ends(piece, bool(after_word[k]))[nth - 1]
            lead = int(np.count_nonzero((piece[:place] & 0xC0) != 0x80))
            places[text, side] = passed[k] - passed[low[text]] + lead
    return tokens, places[:, 0], places[:, 1] - places[:, 0]


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the bounds between them, without a Python object per text."""
    large = texts.cast(pa.large_binary())
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    if not len(large) or large.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(large) + 1, np.int64)
    data = np.frombuffer(large.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


#: Bytes of texts that are cut side by side; one longer text is a group of its own.
GROUP_BYTES = 4 << 20
_KEPT: list[ChunkCounts] = []


def _groups(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(bounds) - 1:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + GROUP_BYTES, "right")) - 1)
        yield low, high
        low = high


def _cut_texts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    if not _KEPT:
        _KEPT.append(ChunkCounts())
    data, bounds = _joined(texts)
    draws = np.stack([first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False)], axis=1)
    found = [
        locate(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], draws[a:b], _KEPT[0])
        for a, b in _groups(bounds)
    ]
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "prefix_chars", "middle_chars"])


def _draws(doc_id: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transform(
    docs: DataFrame,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` (NULL if plain), ``output``."""
    cut_texts = F.arrow_udf(_cut_texts, "n bigint, prefix_chars bigint, middle_chars bigint")
    body = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = _draws(doc_id, seed)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(body, F.lit(mark))
    form = (
        F.when((body == "") | marked | (h3 % 100 >= fim_percent), PLAIN)
        .when(h4 % 100 < spm_percent, SPM)
        .otherwise(PSM)
    )
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in made and c != "_cut"]
    # The counts are taken once and used by all columns after them.
    cut = docs.select(*others, form.alias("form"), cut_texts(body, h1, h2).alias("_cut"))
    shaped = F.col("form") != PLAIN
    prefix, middle = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    before = F.substring(body, F.lit(1), prefix)
    between = F.substring(body, prefix + 1, middle)
    after = F.substring(body, prefix + middle + 1, F.char_length(body))
    return (
        cut.withColumn("n", F.col("_cut.n"))
        .withColumn("prefix_chars", F.when(shaped, F.col("_cut.prefix_chars")))
        .withColumn("middle_chars", F.when(shaped, F.col("_cut.middle_chars")))
        .drop("_cut")
        .withColumn(
            "output",
            F.when(F.col("form") == PSM, F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), between))
            .when(F.col("form") == SPM, F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), between))
            .otherwise(body),
        )
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form.

    A shaped text holds no mark of its own, and no mark can arise across a cut, as every mark is
    ``<`` to ``>`` with neither inside.
    """
    def between(left: str, right: str) -> Column:
        return F.split_part(F.split_part(output, F.lit(left), F.lit(2)), F.lit(right), F.lit(1))

    middle = F.split_part(output, F.lit(MIDDLE), F.lit(2))
    return (
        F.when(form == PSM, F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == SPM, F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )


FIM_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
drawn AS (
  SELECT *, len(tokens) AS n, CAST('0x' || digest[1:8] AS BIGINT) % (len(tokens) + 1) AS c1,
         CAST('0x' || digest[9:16] AS BIGINT) % (len(tokens) + 1) AS c2,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
                OR CAST('0x' || digest[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || digest[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(tokens[1:least(c1, c2)], '') AS p,
         array_to_string(tokens[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(tokens[greatest(c1, c2) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
