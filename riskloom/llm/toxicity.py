"""Toxicity over a noisy channel: obfuscated words are restored, then the restored text is scored.

A word that mixes letters with digits, signs or separators, repeats a letter three
times or more, is spelled out in single letters or lies in short fragments becomes
a lattice: every sign may stand for letters it is used for, a run of one letter for
one or two, a separator for nothing or for a break; what stands there is a path as
well. The Viterbi path under a character 4-gram model of the
whole corpus is the restored text. Scoring is a logistic regression over which
words and word beginnings occur, fitted by FTRL on a bounded labelled sample with
weights of 0 or more, so no amount of clean text outweighs a toxic word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.io import table, text_batches
from riskloom.llm.linear import THRESHOLD, Features, fit, in_fold, labelled_sample, sigmoid
from riskloom.llm.quality import runs
from riskloom.llm.tally import tally
from riskloom.llm.textkernel import Words, mix, running, slices, span_hashes

FOLDS, HELD_OUT = 3, 1
BITS = 20
PREFIXES = (4, 5, 6)
#: Labelled documents the classifier is fitted on at most.
TRAIN_ROWS = 20_000
#: Log odds of a text in which nothing toxic occurs; rows of label 1 a feature needs; the learning rate. Chosen, with the
#: rate and the shrinkage of fit(), on a split of the training fold alone: of 642 rows there 7 of 76 toxic ones were missed, 1 flagged.
CLEAN, SUPPORT, RATE = -1.2, 3, 1.0
#: The letters a sign or digit stands for in obfuscated words.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Costs, in nats, of the channel's steps.
COST_SIGN, COST_KEEP, COST_JOIN, COST_BREAK, COST_SINGLE, COST_DOUBLE = 0.3, 6.0, 0.2, 2.5, 0.4, 1.0
#: Cost of a space put into a word; what the letters must at least almost make up for to open the lattice.
COST_SPACE, NEAR = 4.0, 2.0
#: Letters of a fragment at most.
FRAGMENT = 5
#: Spelled-out words have so many single letters in a row at least.
SPELLED = 3

CLASSES = 29
_OTHER, _DIGIT = 27, 28
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[48:58] = _DIGIT
_CLASS[192:] = _OTHER

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET if c.isascii()]] = True
_JOINER = np.zeros(256, bool)
_JOINER[[ord(c) for c in "._-*~^'`,:;/\\#%&=<>[]{})?\""]] = True
#: First bytes of signs (True) and separators (False) beyond ASCII, and the bytes of the whole.
_WIDE = [
    *(((*x.encode(), len(x.encode())), True) for x in LEET if not x.isascii()),
    *(((0xC2, x, 2), False) for x in range(0xA0, 0xC0) if x not in (0xA3, 0xAA, 0xB5, 0xBA)),
    ((0xE2, 0x80, 3), False),
    ((0xE2, 0x81, 3), False),
    ((0xEF, 0xBB, 0xBF, 3), False),
]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def letter_counts(batch: pa.RecordBatch) -> np.ndarray:
    """Counts of runs of four letter classes; everything but letters and digits is one break."""
    total = np.zeros(CLASSES**4, np.int64)
    for _, _, data, bounds in slices(batch.column(0)):
        own = np.concatenate([np.zeros(3, np.int64), _CLASS[data[(data < 128) | (data >= 192)]], np.zeros(1, np.int64)])
        keep = np.ones(len(own), bool)
        keep[4:] = (own[4:] != 0) | (own[3:-1] != 0)
        own = own[keep]
        code = ((own[:-3] * CLASSES + own[1:-2]) * CLASSES + own[2:-1]) * CLASSES + own[3:]
        total += np.bincount(code, minlength=len(total))
    return total


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(class | three before it) as float32, every order backed by the next lower one."""
    four = counts.reshape([CLASSES] * 4).astype(np.float64)
    one = four.sum((0, 1, 2)) + 1.0
    p = one / one.sum()
    for order in (four.sum((0, 1)), four.sum(0), four):
        seen = order.sum(-1, keepdims=True)
        p = (order + 4.0 * p) / (seen + 4.0)
    return -np.log(p).astype(np.float32)


def _lattice(text: str) -> list[list[tuple[str, float]]]:
    """What each stretch of the text may stand for, with costs."""
    steps: list[list[tuple[str, float]]] = []
    parts = text.split()
    spelled = len(parts) >= SPELLED and max(map(len, parts)) == 1
    i = 0
    while i < len(text):
        c = text[i]
        n = 1
        while i + n < len(text) and text[i + n] == c:
            n += 1
        outer = i == 0 or i + n == len(text)
        i += n
        if c.isspace() and not spelled:
            steps.append([("", COST_SPACE), (" ", 0.0)])
        elif c.isalpha():
            steps.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, 4.0)] if n == 2 else [(c, COST_SINGLE), (c * 2, COST_DOUBLE)])
        elif c in LEET:
            own = [(x * min(n, 2), COST_SIGN * n) for x in LEET[c]] + ([(x, COST_SIGN * n) for x in LEET[c]] if n > 1 else [])
            own.append((" ", COST_KEEP if c.isdigit() else 0.0 if outer else COST_BREAK))
            if not c.isdigit():
                own.append(("", COST_BREAK))
            steps.append(own)
        else:
            steps.append([("", COST_JOIN), (" ", COST_BREAK)])
    return steps


def _class_of(c: str) -> int:
    return int(_CLASS[ord(c)]) if c.isascii() else _OTHER


def _as_it_stands(text: str, costs: np.ndarray) -> float:
    """The cost of a stretch read without restoring anything."""
    a = b = c = 0
    total = 0.0
    for letter in text + " ":
        d = _class_of(letter) if letter.isalnum() else 0
        if d or c:
            total += float(costs[a, b, c, d])
            a, b, c = b, c, d
    return total


def restore(text: str, costs: np.ndarray) -> str:
    """The cheapest reading of a lower-case obfuscated stretch, which may be what stands there."""
    paths: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
    for step in [*_lattice(text), [(" ", 0.0)]]:
        after: dict[tuple[int, int, int], tuple[float, str]] = {}
        for state, (cost, done) in paths.items():
            for letters, extra in step:
                a, b, c = state
                total, out = cost + extra, done
                for letter in letters:
                    d = _class_of(letter)
                    if d == 0 and c == 0:
                        continue
                    total += float(costs[a, b, c, d])
                    a, b, c = b, c, d
                    out += letter
                old = after.get((a, b, c))
                if old is None or (total, out) < old:
                    after[a, b, c] = (total, out)
        paths = after
    cost, done = min(paths.values())
    return text if _as_it_stands(text, costs) <= cost else done.strip()


class Reader:
    """Words of texts with the obfuscated ones restored; keeps restored words."""

    KEEP = 200_000

    def __init__(self, costs: np.ndarray):
        self.costs, self.known = costs, {}

    def restored(self, raw: bytes) -> str:
        out = self.known.get(raw)
        if out is None:
            if len(self.known) >= self.KEEP:
                self.known.clear()
            out = self.known[raw] = restore(raw.decode("utf-8", "replace").lower(), self.costs)
        return out

    def stretches(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of stretches to restore: odd words, single letters in a row, and fragments."""
        size = len(data)
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        letter, sign, join = _LETTER[data], _SIGN[data], _JOINER[data]
        for bytes_, kind in _WIDE:
            at = np.flatnonzero(data == bytes_[0])
            at = at[at + bytes_[-1] <= size]
            for k, byte in enumerate(bytes_[1:-1], 1):
                at = at[data[at + k] == byte]
            for k in range(bytes_[-1]):
                letter[at + k] = False
                (sign if kind else join)[at + k] = True
        inner = letter | sign
        # the core of a word: without signs at its ends that stand for nothing
        mark = np.flatnonzero(inner)
        at = np.searchsorted(mark, words.starts)
        to = np.searchsorted(mark, words.ends)
        full = to > at
        begin = np.where(full, mark[np.minimum(at, max(len(mark) - 1, 0))] if len(mark) else 0, words.starts)
        end = np.where(full, (mark[np.maximum(to - 1, 0)] if len(mark) else 0) + 1, words.starts)
        # a single letter of a spelled word may have signs ("!", "$$$") behind it
        letters = np.flatnonzero(letter)
        last = np.searchsorted(letters, end) - 1
        first = np.searchsorted(letters, begin)
        has = full & (last >= first)
        tail = np.where(has, (letters[np.maximum(last, 0)] if len(letters) else 0) + 1, begin)
        digit = (data >= 48) & (data < 58)
        bare = np.where(has & (end > tail) & ~digit[np.minimum(end - 1, size - 1)], tail, end)
        bare = np.maximum(bare, begin)
        count = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        n_letter, n_sign, n_join = count(letter), count(sign), count(join)
        low = _FOLD[data]
        triple = np.zeros(size, bool)
        triple[2:] = letter[2:] & (data[2:] < 128) & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
        n_triple = count(triple)
        within = lambda c: c[end] - c[begin]
        lettered = within(n_letter)
        odd = (lettered > 0) & ((within(n_sign) > 0) | (within(n_triple) > 0) | (within(n_join) > 0))
        single = full & (bare - begin == 1)
        # rows end a run of single letters
        edge = np.zeros(len(words) + 1, bool)
        edge[words.first] = True
        run = np.cumsum(~single | edge[:-1] | np.concatenate([[True], ~single[:-1]]))
        run_ids, run_at, run_n = np.unique(run[single], return_index=True, return_counts=True)
        place = np.flatnonzero(single)
        long = run_n >= SPELLED
        a = place[run_at[long]]
        b = a + run_n[long] - 1
        spelled = np.zeros(len(words) + 1, np.int64)
        np.add.at(spelled, a, 1)
        np.add.at(spelled, b + 1, -1)
        free = np.cumsum(spelled)[:-1] == 0
        odd &= free
        c, d = self.fragments(data, words, begin, end, free & full & ~odd & (lettered == end - begin), edge)
        starts = np.concatenate([begin[odd], begin[a], begin[c]])
        ends = np.concatenate([end[odd], bare[b], end[d]])
        order = np.argsort(starts)
        return starts[order], ends[order]

    def fragments(self, data: np.ndarray, words: Words, begin: np.ndarray, end: np.ndarray, plain: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last words of runs of short words whose letters, joined, are nearly worth the spaces' cost."""
        char = (data < 128) | (data >= 192)
        n_char = np.concatenate([[0], np.cumsum(char, dtype=np.int64)])
        short = plain & (n_char[end] - n_char[begin] <= FRAGMENT)
        gap = np.flatnonzero(short[:-1] & short[1:] & ~edge[1:-1] & (end[:-1] == words.ends[:-1]) & (begin[1:] == words.starts[1:]))
        none = np.zeros(0, np.int64)
        if not len(gap):
            return none, none
        # letters without gaps, and the word of each; padded so that a look beyond the ends is another word
        owner = np.repeat(np.arange(len(begin)), np.where(short, n_char[end] - n_char[begin], 0))
        first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(begin)))])
        letters = _CLASS[data[char]][n_char[begin][owner] + np.arange(len(owner)) - first[owner]]
        letters = np.concatenate([np.zeros(3, np.int64), letters, np.zeros(3, np.int64)])
        owner = np.concatenate([np.full(3, -9), owner, np.full(3, len(begin) + 9)])
        at = first[gap + 1] + 3
        best = np.full(len(gap), -np.inf, np.float32)
        for near in range(3):
            left = self._beside(letters, owner, at - 1, -1, gap, near)
            for far in range(3):
                right = self._beside(letters, owner, at, 1, gap + 1, far)
                joined = [*left[::-1], *right]
                broken = [*left[::-1], np.zeros(len(gap), np.int64), *right]
                gain = sum(self.costs[tuple(broken[k - 3 : k + 1])] for k in range(3, 7)) - sum(self.costs[tuple(joined[k - 3 : k + 1])] for k in range(3, 6))
                np.maximum(best, gain, out=best)
        gap = gap[best > COST_SPACE - NEAR]
        if not len(gap):
            return none, none
        new = np.flatnonzero(np.diff(gap, prepend=-2) != 1)
        return gap[new], gap[np.append(new[1:], len(gap)) - 1] + 1

    @staticmethod
    def _beside(letters: np.ndarray, owner: np.ndarray, at: np.ndarray, way: int, word: np.ndarray, joined: int) -> list[np.ndarray]:
        """The three classes beside a gap, nearest first, if so many gaps further on are joined."""
        out, ended = [], np.zeros(len(at), bool)
        for k in range(3):
            place = np.clip(at + way * k, 0, len(letters) - 1)
            ended = ended | (np.abs(owner[place] - word) > joined)
            out.append(np.where(ended, 0, letters[place]))
        return out

    def texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int, int, str]]]]:
        """(first row, bytes, bounds, (row, start, end, restored) of every stretch) for runs of rows."""
        for at, _, data, bounds in slices(texts):
            starts, ends = self.stretches(data, Words(data, bounds))
            rows = np.searchsorted(bounds, starts, side="right") - 1
            raw = data.tobytes()
            yield at, data, bounds, [(r, a, b, self.restored(raw[a:b])) for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True)]

    def features(self, texts: pa.Array) -> Iterator[Features]:
        """Which words and word beginnings occur in the restored text, each once a document."""
        for _, data, bounds, fixed in self.texts(texts):
            data = data.copy()
            for _, a, b, _ in fixed:
                data[a:b] = 32
            parts = [_word_features(data, bounds)]
            extra = [(r, t.encode()) for r, _, _, t in fixed if t]
            if extra:
                sizes = np.zeros(len(bounds), np.int64)
                for r, t in extra:
                    sizes[r + 1] += len(t) + 1
                parts.append(_word_features(np.frombuffer(b"".join(t + b" " for _, t in extra), np.uint8), np.cumsum(sizes)))
            index = np.concatenate([p[0] for p in parts])
            row = np.concatenate([p[1] for p in parts])
            yield index, row, np.array([len(bounds) - 1])


def _word_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and beginnings, and the row of each."""
    starts, ends, first = runs(data, bounds)
    lettered = _LETTER[data[starts]] if len(starts) else np.zeros(0, bool)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))[lettered]
    starts, ends = starts[lettered], ends[lettered]
    total = running(data)
    mask = np.uint64((1 << BITS) - 1)
    index, rows = [span_hashes(data, starts, ends, total=total)], [row]
    for k in PREFIXES:
        long = ends - starts >= k
        index.append(mix(span_hashes(data, starts[long], starts[long] + k, total=total) + np.uint64(k)))
        rows.append(row[long])
    return np.maximum((np.concatenate(index) & mask).astype(np.int64), 1), np.concatenate(rows)


def _once(index: np.ndarray, row: np.ndarray, n: int) -> Features:
    """Each feature once a row."""
    key = np.unique(row * (1 << BITS) + index)
    row = key >> BITS
    return key & ((1 << BITS) - 1), np.ones(len(key)), np.searchsorted(row, np.arange(n + 1))


class Model:
    """The letter model's costs and the classifier's weights."""

    def __init__(self, costs: np.ndarray, weights: np.ndarray):
        self.costs, self.weights = costs, weights


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Letters are counted over all texts; labels are learnt from a bounded sample.

    An id with several labels counts as toxic if one says so, one with several rows is
    learnt from each; null ids and null labels teach nothing. Without labels no text
    scores above the clean one's odds. Ties do not matter: rows are learnt in order of
    their ids' hash, and rows that repeat, whatever their order, are alike.
    """
    costs = letter_costs(tally(text_batches(docs).select(F.col("text").cast("string")), letter_counts, CLASSES**4))
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def features(texts: pa.Array) -> Iterator[Features]:
        for index, row, n in Reader(shared.value).features(texts):
            yield _once(index, row, int(n[0]))

    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, TRAIN_ROWS)
    return Model(costs, fit(sample, features, 1 << BITS, alpha=RATE, beta=1.0, l1=0.1, l2=0.0, epochs=8, rising=True, fixed=CLEAN, support=SUPPORT))


def score(docs: DataFrame, model: Model, column: str = "toxic_score") -> DataFrame:
    """docs (any columns, text among them) with the chance that label 1 holds in a column of this name, which docs must lack.

    A null text scores as an empty one; a long text is read whole; rows that repeat
    score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.costs, model.weights))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, weights = shared.value
        reader = Reader(costs)
        for batch in batches:
            out = []
            for index, row, n in reader.features(batch.column(at)):
                weighs = weights[index] != 0
                index, value, begin = _once(index[weighs], row[weighs], int(n[0]))
                total = np.concatenate([[0.0], np.cumsum(weights[index] * value)])
                out.append(sigmoid(total[begin[1:]] - total[begin[:-1]] + weights[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*batch.schema.names, column])

    return text_batches(docs).mapInArrow(run, docs.select("*", F.lit(0.0).cast("double").alias(column)).schema)


def deobfuscate(docs: DataFrame, costs: np.ndarray, column: str = "restored") -> DataFrame:
    """docs (any columns, text among them) with the restored text; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            source = batch.column(at).to_pylist()
            raw = [None if t is None else t.encode() for t in source]
            done: list[list[bytes]] = [[] for _ in raw]
            last = [0] * len(raw)
            for first, _, bounds, fixed in reader.texts(batch.column(at)):
                for r, a, b, text in fixed:
                    i = first + r
                    done[i] += [raw[i][last[i] : a - bounds[r]], text.encode()]
                    last[i] = b - int(bounds[r])
            texts = [None if t is None else (b"".join(done[i]) + t[last[i] :]).decode("utf-8", "replace") for i, t in enumerate(raw)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, column])

    return text_batches(docs).mapInArrow(run, docs.select("*", F.lit("").alias(column)).schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, null ids, null texts and repeats included; see train and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model, "score")
    return out.select("doc_id", in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
