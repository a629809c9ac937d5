"""Token ids of whole texts, with the words' ids kept between texts.

A public tokenizer splits a text into words before it looks for merges, and a single blank
between two visible characters always ends a word. So a text is cut at such blanks, every
distinct part is encoded once by the tokenizers library, and a text's ids are the parts' ids in
order: the ids the library gives for the whole text.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

#: Bytes of parts, with their ids, in each of the two generations a Python worker keeps.
KEPT_BYTES = 128 << 20
#: What a kept part costs besides its own bytes: two objects and a place in a dictionary.
_OVERHEAD = 180
_JOINED = 200
_SIGNS = ".,;:!?%&$#*"
# Letters, digits and visible ASCII: never white space, never joined to what stands before them.
_SAFE = re.compile(r"[!-~\w](?:.*[!-~\w])?", re.DOTALL)
_STARTS = re.compile(r"[!-~\w]")


class TextEncoder:
    """``encode(texts)`` gives an array of uint32 ids per text."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Their strings in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.kept_bytes, self.size = kept_bytes, 0
        # ``kept`` grows; once it is full it becomes ``old``, and what is met again comes back from there.
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        marks = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        for token, i in vocabulary.items():
            marks[i] = token.endswith(suffix) if suffix else token.startswith("Ġ")
        self.begins, self.ends = (None, marks) if suffix else (marks, None)

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part with a blank before it.

        A part that ends in signs after a letter is the part without them and the signs. Parts
        of letters only are one word each, so the tokens that begin or end words show where the
        parts end; for the others the tokens' places in the string do.
        """
        cut: dict[str, tuple[str, str]] = {}
        whole = []
        for part in parts:
            base = part.rstrip(_SIGNS)
            if base is not part and base != part and base and base[-1].isalpha():
                cut[part] = (base, part[len(base) :])
            else:
                whole.append(part)
        bases = {base for base, _ in cut.values()}.difference(self.kept)
        whole = list(bases.union(whole))
        words = [p for p in whole if p.isalpha()]
        ids = self._encode_words(words)
        ids.update(self._encode_placed([p for p in whole if p not in ids]))
        tails = list({tail for _, tail in cut.values()}.difference(self.tails))
        self.tails.update(zip(tails, self._direct(tails)))
        for part, (base, tail) in cut.items():
            found = ids.get(base)
            ids[part] = (self.kept[base] if found is None else found) + self.tails[tail]
        return ids

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        joined = [" " + " ".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)]
        found = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        if not found:
            return {}
        tokens = np.concatenate([np.array(e.ids, "<u4") for e in found])
        first = np.flatnonzero(self.begins[tokens]) if self.begins is not None else np.flatnonzero(self.ends[tokens]) + 1
        cuts = (np.append(first, len(tokens)) if self.begins is not None else np.insert(first, 0, 0)) * 4
        if len(cuts) != len(words) + 1:  # a letter that the tokenizer does not count as one
            return {}
        data, cuts = tokens.tobytes(), cuts.tolist()
        return dict(zip(words, [data[a:b] for a, b in zip(cuts, cuts[1:])]))

    def _encode_placed(self, parts: list[str]) -> dict[str, bytes]:
        ids: dict[str, bytes] = {}
        for low in range(0, len(parts), _JOINED):
            some = parts[low : low + _JOINED]
            found = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            begins = np.cumsum([0] + [len(p) + 1 for p in some])
            tokens = np.array(found.ids, "<u4")
            places = np.fromiter((o[0] for o in found.offsets), np.int64, len(tokens))
            cuts = (np.searchsorted(places, begins) * 4).tolist()
            data = tokens.tobytes()
            ids.update(zip(some, [data[a:b] for a, b in zip(cuts, cuts[1:])]))
        return ids

    def _merged(self, parts: list[str]) -> list[str]:
        """Parts again, joined where a cut between them is not safe."""
        merged = [parts[0]]
        for left, right in zip(parts, parts[1:]):
            cut = bool(left) and bool(right) and _STARTS.match(left[-1]) and _STARTS.match(right)
            if cut:
                merged.append(right)
            else:
                merged[-1] += " " + right
        return merged

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = []
        wanted: set[str] = set()
        for text in texts:
            parts = text.split(" ")
            new = set(parts).difference(self.kept)
            if new and not all(map(_SAFE.fullmatch, new)):
                parts = self._merged(parts)
                new = set(parts[1:]).difference(self.kept)
            else:
                new.discard(parts[0])
                new.update(p for p in parts[1:2] if p not in self.kept)
                if parts[0] not in self.kept and parts.count(parts[0]) > 1:
                    new.add(parts[0])
            wanted |= new
            split.append(parts)
        if self.old:
            again = {p: self.old[p] for p in wanted if p in self.old}
            self._keep(again)
            wanted.difference_update(again)
        self._keep(self._encode_parts(list(wanted)))
        heads = self._direct([parts[0] for parts in split])
        get = self.kept.__getitem__
        ids = [np.frombuffer(head + b"".join(map(get, parts[1:])), "<u4") for head, parts in zip(heads, split)]
        if self.size > self.kept_bytes:
            self.old, self.kept, self.size = self.kept, {}, 0
        return ids

    def _keep(self, found: dict[str, bytes]) -> None:
        self.kept.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + _OVERHEAD * len(found)


@functools.cache
def encoder(path: str) -> TextEncoder:
    """One encoder per Python worker and tokenizer."""
    return TextEncoder(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
