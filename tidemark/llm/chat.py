"""Chat formatting at the level of tokens.

Role and text of a turn are encoded on their own and spliced between reserved ids:

    <|im_start|> role <|im_sep|> text <|im_end|>

The loss mask covers the texts of the assistant. It is the running sum of +1 where such a text
begins and -1 where it ends. Reserved ids lie behind the vocabulary, so no text can give one;
control strings inside a text are escaped too, by one backslash more behind the ``<`` of
every ``<``, backslashes, ``|``, which reading takes away again.

Turns are rows, so a conversation of any length is formatted and read as a stream.

Defined cases: NULL roles and texts are empty; turns with equal numbers are ordered by role and
text; repeated rows are turns of their own; NULL ids form one conversation; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.store import small_batches, stored
from tidemark.llm.tokens import encoder

CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def reserved_ids(tokenizer: str) -> list[int]:
    size = encoder(tokenizer).tokenizer.get_vocab_size()
    return [size + k for k in range(len(CONTROLS))]


def assemble(roles: list[str], texts: list[str], tokenizer: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of all turns, one behind the other, and each turn's number of ids."""
    encode = encoder(tokenizer).encode
    start, sep, end = ([np.array([i], "<u4")] for i in reserved_ids(tokenizer))
    heads, bodies = encode([escape(r) for r in roles]), encode([escape(t) for t in texts])
    pieces = [p for head, body in zip(heads, bodies) for p in (*start, head, *sep, body, *end)]
    lengths = np.array([len(p) for p in pieces], np.int64).reshape(-1, 5)
    ids = np.concatenate(pieces) if pieces else np.empty(0, "<u4")
    ends = np.cumsum(lengths).reshape(-1, 5)
    step = np.zeros(len(ids) + 1, np.int8)
    spoken = np.array([r == "assistant" for r in roles], bool)
    np.add.at(step, ends[spoken, 2], 1)
    np.add.at(step, ends[spoken, 3], -1)
    return ids, np.cumsum(step[:-1], dtype=np.int8), lengths.sum(axis=1)


def format_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, turn, input_ids, loss_mask), a row per turn."""
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    number = turns.schema["turn"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = ([v or "" for v in batch.column(k).to_pylist()] for k in (2, 3))
            ids, mask, lengths = assemble(roles, texts, tokenizer)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(mask)),
                ],
                names=["conv_id", "turn", "input_ids", "loss_mask"],
            )

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(
        scan, f"conv_id {kind}, turn {number}, input_ids array<int>, loss_mask array<tinyint>"
    )


def read_turns(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, text, loss_text, formatted_chars) from ids and masks alone."""
    small_batches(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    number = formatted.schema["turn"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(tokenizer).tokenizer.decode_batch
        start, sep, end = reserved_ids(tokenizer)
        controls = sum(map(len, CONTROLS))
        for batch in batches:
            roles, texts, spoken = [], [], []
            for ids, mask in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if ids[0] != start or ids[-1] != end or ids.count(sep) != 1:
                    raise ValueError("a turn does not follow the template")
                at = ids.index(sep)
                roles.append(ids[1:at])
                texts.append(ids[at + 1 : -1])
                spoken.append([i for i, m in zip(ids, mask) if m])
            roles, texts, spoken = (decode(part, skip_special_tokens=False) for part in (roles, texts, spoken))
            chars = [controls + len(r) + len(t) for r, t in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *(pa.array([unescape(t) for t in part], pa.string()) for part in (roles, texts, spoken)),
                    pa.array(chars, pa.int64()),
                ],
                names=["conv_id", "turn", "role", "text", "loss_text", "formatted_chars"],
            )

    return formatted.select("conv_id", "turn", "input_ids", "loss_mask").mapInArrow(
        scan, f"conv_id {kind}, turn {number}, role string, text string, loss_text string, formatted_chars bigint"
    )


def conversation_digests(read: DataFrame) -> DataFrame:
    """One row per conversation; a conversation's turns pass through one task as a stream."""
    kind = read.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begun = None, False
        turns, loss, counts = sha256(), sha256(), [0, 0, 0]

        def out() -> list:
            return [held, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]]

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = []
            for conv, role, text, spoken, chars in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if not begun or conv != held:
                    if begun:
                        rows.append(out())
                    held, begun = conv, True
                    turns, loss, counts = sha256(), sha256(), [0, 0, 0]
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(spoken.encode())
                counts[0] += 1
                counts[1] += len(spoken)
                counts[2] += chars
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out(), kinds)], names=names)

    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(
        walk,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def format_and_read(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Format all conversations, store the ids and masks, and read the digests back."""
    return conversation_digests(read_turns(stored(format_turns(turns, tokenizer), "chat-ids"), tokenizer))
