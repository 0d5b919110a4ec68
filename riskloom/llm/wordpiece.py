"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Where a match cannot grow, the
failure link pops the longest pieces off its front and leads to the state of what
is left; how many pieces that pops is stored with the link, so a word's greedy
word-piece length is the sum of the counts on its path, and no piece is built.
Every letter is read once and each link pops a piece, so time is linear in the
word. A word some part of which no piece covers is one unknown token.

Pieces that begin a word and pieces inside a word have tries of their own; the
vocabulary marks beginnings by a sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.io import table, text_batches
from riskloom.llm.textkernel import Words, slices

#: The vocabulary file, and its sign of a word's beginning.
VOCABULARY, BEGIN = "piece_bpe_32k.model", "▁"
#: Distinct words a worker keeps.
KEEP_WORDS = 500_000


def pieces_of(path: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word, without their sign, and pieces inside a word; special and byte pieces are neither."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, inner = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith(BEGIN):
            if len(piece) > 1 and BEGIN not in piece[1:]:
                first.append(piece[1:])
        elif BEGIN not in piece:
            inner.append(piece)
    return first, inner


class Automaton:
    """States: 0 begins a word, 1 is inside one, others are prefixes of pieces in either trie.

    go[state] maps a letter to the next state; link[state] is the state after the
    longest pieces are popped off the front (-1: nothing can be), pops[state] how
    many those are.
    """

    def __init__(self, first: list[str], inner: list[str]):
        self.go: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        path = ["", ""]
        parent = [-1, -1]
        for root, words in ((0, first), (1, inner)):
            for word in words:
                at = root
                for letter in word:
                    to = self.go[at].get(letter)
                    if to is None:
                        to = self.go[at][letter] = len(self.go)
                        self.go.append({})
                        ends.append(False)
                        path.append(letter)
                        parent.append(at)
                    at = to
                ends[at] = True
        n = len(self.go)
        self.link, self.pops = [-1] * n, [0] * n
        todo = [0, 1]
        for at in todo:
            todo.extend(self.go[at].values())
        for at in todo[2:]:
            if ends[at]:
                self.link[at], self.pops[at] = 1, 1
                continue
            up, letter = parent[at], path[at]
            z, popped = self.link[up], self.pops[up]
            while z != -1 and letter not in self.go[z]:
                popped += self.pops[z]
                z = self.link[z]
            if z != -1:
                self.link[at], self.pops[at] = self.go[z][letter], popped

    def length(self, word: str) -> int:
        """Pieces of the greedy longest match, or -1 where it fails."""
        at, count = 0, 0
        go, link, pops = self.go, self.link, self.pops
        for letter in word:
            to = go[at].get(letter)
            while to is None:
                if link[at] == -1:
                    return -1
                count += pops[at]
                at = link[at]
                to = go[at].get(letter)
            at = to
        while at != 1:
            if link[at] == -1:
                return -1
            count += pops[at]
            at = link[at]
        return count


_automata: dict[str, tuple[Automaton, dict[int, int]]] = {}


def automaton(path: str) -> tuple[Automaton, dict[int, int]]:
    if path not in _automata:
        _automata[path] = Automaton(*pieces_of(path)), {}
    return _automata[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text.

    A word that no pieces cover counts as one token and one unknown. Null and empty
    texts and texts without words have none of each. Rows that repeat are counted
    each for itself; a null doc_id stays null; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, known = automaton(path)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for _, _, data, bounds in slices(batch.column(1)):
                words = Words(data, bounds)
                code, distinct = pd.factorize(words.hashes(lower=False))
                where = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1)) if len(code) else code
                if len(known) > KEEP_WORDS:
                    known.clear()
                sizes = np.zeros(len(distinct), np.int64)
                raw = data.tobytes()
                for i, (h, w) in enumerate(zip(distinct.tolist(), where.tolist(), strict=True)):
                    n = known.get(h)
                    if n is None:
                        n = known[h] = auto.length(raw[words.starts[w] : words.ends[w]].decode("utf-8", "replace"))
                    sizes[i] = n
                size = sizes[code] if len(code) else np.zeros(0, np.int64)
                upto = np.concatenate([[0], np.cumsum(np.where(size < 0, 1, size))])
                bad = np.concatenate([[0], np.cumsum(size < 0)])
                for have, more in zip(out, (words.counts, np.diff(upto[words.first]), np.diff(bad[words.first])), strict=True):
                    have.append(more)
            columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, null ids, null texts (empty) and repeats included; an empty table gives no rows."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
