"""Token ids of whole texts by a public tokenizer, word by word.

Every pre-token of this kind of vocabulary lies between white space, so a text's
ids are the ids of its words in a row. Words are hashed, distinct ones are
encoded by the tokenizers library once a worker, and ids are gathered from there.
Texts that hold the text of a special token go to the library as a whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex

from riskloom.llm.textkernel import Words, slices

#: The vocabulary whose parts between white space are independent.
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Distinct words a worker keeps; beyond them it starts anew.
KEEP_WORDS = 800_000
#: Words gathered before distinct ones are looked up.
ROUND_BYTES = 6 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Encoder:
    """Ids of words and texts; keeps the ids of words it has met, in sorted arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def word(self, word: bytes, parts: dict[str, list[int]]) -> list[int]:
        if not word.isascii() or min(word) < 32:
            text = word.decode("utf-8", "replace")
            if max(text) >= "ɐ" or any(c < " " or "\x7f" <= c <= "\xa0" for c in text):
                return self.tokenizer.encode(text, add_special_tokens=False).ids
            text = text.lower()
        else:
            text = word.decode().lower()
        if text.isalpha():
            pieces = (text,)
        else:
            pieces = self.split(text)
        out: list[int] = []
        for piece in pieces:
            ids = parts.get(piece)
            if ids is None:
                mapped = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
                ids = parts[piece] = [t.id for t in self.model.tokenize(mapped)]
            out += ids
        return out

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        parts: dict[str, list[int]] = {}
        flat: list[int] = []
        sizes = np.zeros(len(words), np.int64)
        for i, w in enumerate(words):
            ids = self.word(w, parts)
            sizes[i] = len(ids)
            flat += ids
        at = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.array(flat, self.ids.dtype)])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, sizes])[order]

    def texts(self, texts: pa.Array, end_id: int | None = END_ID) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds of the rows' ids) for runs of rows; a null text is empty."""
        for at, to, data, bounds in slices(texts, ROUND_BYTES):
            hashes, first, pieces = [], [np.zeros(1, np.int64)], []
            for a, b, d, bo in slices(pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(bounds), pa.py_buffer(data)])):
                words = Words(d, bo)
                pieces.append((words.starts + bounds[a], words.ends + bounds[a]))
                hashes.append(words.hashes())
                first.append(words.first[1:] + first[-1][-1])
            starts, ends = (np.concatenate([p[i] for p in pieces]) for i in (0, 1))
            first = np.concatenate(first)
            code, distinct = pd.factorize(np.concatenate(hashes))
            where = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
            if len(self.known) > KEEP_WORDS:
                self.forget()
            place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
            fresh = np.ones(len(distinct), bool) if not len(self.known) else self.known[place] != distinct
            if fresh.any():
                raw = data.tobytes()
                self.learn(distinct[fresh], [raw[starts[i] : ends[i]] for i in where[fresh]])
                place = np.searchsorted(self.known, distinct)
            # the end id stands behind a document's words as a word of its own
            table, size, begin = self.ids, self.size[place], self.at[place]
            if end_id is not None:
                size, begin = np.append(size, 1), np.append(begin, len(table))
                table = np.append(table, table.dtype.type(end_id))
                code = np.insert(code, first[1:], len(distinct))
                first = first + np.arange(len(first))
            upto = np.zeros(len(code) + 1, np.int64)
            np.cumsum(size[code], out=upto[1:])
            out_bounds = upto[first]
            ids = np.empty(out_bounds[-1], table.dtype)
            step = 1 << 18
            for lo in range(0, len(code), step):
                hi = min(lo + step, len(code))
                own = code[lo:hi]
                ids[upto[lo] : upto[hi]] = table[np.repeat(begin[own] - upto[lo:hi], size[own]) + np.arange(upto[lo], upto[hi])]
            odd = self._special_rows(data, bounds)
            if odd:
                ids, out_bounds = self._replace(odd, data, bounds, ids, out_bounds, end_id)
            yield at, ids, out_bounds

    def _special_rows(self, data: np.ndarray, bounds: np.ndarray) -> list[int]:
        raw = data.tobytes() if self.special else b""
        rows = set()
        for token in self.special:
            p = raw.find(token)
            while p >= 0:
                rows.add(int(np.searchsorted(bounds, p, side="right")) - 1)
                p = raw.find(token, p + 1)
        return sorted(rows)

    def _replace(self, odd, data, bounds, ids, out_bounds, end_id):
        parts, sizes, last = [], np.diff(out_bounds), 0
        for r in odd:
            whole = self.tokenizer.encode(data[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids
            own = np.array(whole + ([] if end_id is None else [end_id]), ids.dtype)
            parts += [ids[last : out_bounds[r]], own]
            last, sizes[r] = out_bounds[r + 1], len(own)
        parts.append(ids[last:])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
