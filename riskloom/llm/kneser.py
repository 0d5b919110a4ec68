"""Interpolated modified Kneser-Ney trigram model, counted in Spark, kept as sorted hash arrays.

Words are 64-bit hashes. Each word of a text is an event (word two before, word
before, word); texts are split three times, for a sketch of word counts, for counting, for
scoring:

* Events go, packed, to the part of the model that the word before belongs to. All
  trigrams, bigrams and contexts with that word in their middle or front meet there,
  so trigram counts and the numbers of different words before a bigram are counted
  in one place.
* What a part lacks are totals over all parts: of words, and of contexts with a hot
  word. It asks for them with its own share of each; shares are added up by key and
  the totals sent back to the parts that asked, in the order of their questions.
* Events are sent once more, which takes less disk than keeping them. Each part
  writes its n-grams, contexts and words as sorted hash arrays to a file, maps the
  file into memory and looks each different n-gram of its events up; sums by document
  come back to where the document's events were packed.

A word whose bucket of the sketch holds more than a part's share of all tokens is
hot: its events are dealt by it and the word after, so no part grows with it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.io import forget, table, text_batches, written
from riskloom.llm.linear import in_fold
from riskloom.llm.tally import tally
from riskloom.llm.textkernel import Words, mix, slices

ORDER = 3
FOLDS, HELD_OUT = 7, 2
#: Events of a part of the model, on average, and events a task packs at once.
PART_EVENTS = 1_500_000
PACK_EVENTS = 2_000_000
#: Parts whose questions are answered in one group, on average.
DEAL_PARTS = 16
#: Packs whose sums are added up in one group, on average.
DEAL_PACKS = 2
SKETCH_BITS = 20
START, END = 1, 2
#: What parts ask for: words, contexts of two words, contexts of one.
WORD, TWO, ONE = range(3)


class HashArrays:
    """Sorted 64-bit keys with float64 columns in one file, mapped into memory."""

    def __init__(self, path: str, keys: np.ndarray, *columns: np.ndarray):
        order = np.argsort(keys)
        self.n, self.columns = len(keys), len(columns)
        with open(path, "wb") as f:
            f.write(keys[order].astype("<u8").tobytes())
            for c in columns:
                f.write(c[order].astype("<f8").tobytes())
        self.map = np.memmap(path, np.uint8, "r") if self.n else np.zeros(0, np.uint8)

    def get(self, keys: np.ndarray, missing: float = 0.0) -> list[np.ndarray]:
        if not self.n:
            return [np.full(len(keys), missing) for _ in range(self.columns)]
        held = self.map[: 8 * self.n].view("<u8")
        # asked in their order, keys are found in one pass through the file
        order, at = np.argsort(keys), np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(held, keys[order])
        at = np.minimum(at, self.n - 1)
        found = held[at] == keys
        return [np.where(found, self.map[8 * self.n * (1 + i) : 8 * self.n * (2 + i)].view("<f8")[at], missing) for i in range(self.columns)]


_ZSTD = pa.Codec("zstd", compression_level=3)


def _zip(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    parts = [_ZSTD.compress(x, asbytes=True) for x in raw]
    return np.array([len(parts), *map(len, parts), *map(len, raw)], "<u4").tobytes() + b"".join(parts)


def _unzip(raw: bytes, *kinds: str) -> list[np.ndarray]:
    k = len(kinds)
    sizes = np.frombuffer(raw, "<u4", 2 * k, 4).tolist()
    at, out = 4 + 8 * k, []
    for size, whole, kind in zip(sizes[:k], sizes[k:], kinds, strict=True):
        out.append(np.frombuffer(_ZSTD.decompress(raw[at : at + size], decompressed_size=whole, asbytes=True), kind))
        at += size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, their bytes by place: the upper ones are nearly all zero."""
    return np.diff(ascending, prepend=np.zeros(1, np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8).T


def _ascending(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(steps.reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def _planes(numbers: np.ndarray) -> np.ndarray:
    """Numbers below 2³², their bytes by place: upper ones are zero or alike."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the upper half of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9FB21C651E98DF25) + w)


def token_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased words' hashes, where each row's begin)."""
    for at, _, data, bounds in slices(batch.column(1)):
        words = Words(data, bounds)
        yield at, words.hashes(), words.first


def _prepared(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return text_batches(docs).select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), F.col("text").cast("string"), in_fold(doc_id, FOLDS, HELD_OUT).alias("held_out"), doc_id.isNull().alias("nameless"))


class Pack:
    """Events of some rows: words ascending, places of the word two before, the word before and the word, row; and the rows."""

    def __init__(self, word: np.ndarray, count: np.ndarray, doc_id: np.ndarray, held_out: np.ndarray, nameless: np.ndarray):
        code, distinct = pd.factorize(np.concatenate([np.array([START, END], np.uint64), word]))
        order = np.argsort(distinct)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[code]
        start, end, code = code[0], code[1], code[2:]
        ends = np.cumsum(count)
        # a row's events: its words, each after the two before, and the end
        self.words = distinct[order]
        code = code.astype(np.int32)
        self.w = np.insert(code, ends, end)
        self.v = np.insert(code, ends - count, start)
        first = np.cumsum(count + 1) - (count + 1)
        self.u = np.empty_like(self.v)
        self.u[1:] = self.v[:-1]
        self.u[first] = start
        self.row = np.repeat(np.arange(len(count), dtype=np.int32), count + 1)
        self.doc_id, self.held_out, self.nameless, self.n_tokens = doc_id, held_out, nameless, count + 1
        self.key = int(mix(np.concatenate([doc_id.view(np.uint64) + np.uint64(3), distinct, count.astype(np.uint64)])).sum(dtype=np.uint64).view(np.int64))

    def _order(self, part: np.ndarray) -> np.ndarray:
        """Events by part, word before, word and place."""
        n, size = len(part), len(self.words)
        bits = max(n - 1, 1).bit_length()
        if size * size << bits >= 1 << 63 or part.max(initial=0) >= 1 << 16:
            return np.lexsort((self.w, self.v, part))
        # numbers with their place in the lower bits sort by value, and parts of 16 bits by counting
        key = ((self.v.astype(np.int64) * size + self.w) << bits) + np.arange(n)
        key.sort()
        order = key & ((1 << bits) - 1)
        return order[np.argsort(part[order].astype(np.uint16), kind="stable")]

    def sent(self, part: np.ndarray, rows: bool) -> Iterator[tuple[int, bytes]]:
        """(part, packed events) by part; with their rows, or only whether they are held out."""
        order = self._order(part)
        by_part = part[order]
        begin = np.flatnonzero(np.diff(by_part, prepend=-1))
        seen, place = np.zeros(len(self.words), bool), np.empty(len(self.words), np.int64)
        for p, a, b in zip(by_part[begin].tolist(), begin, [*begin[1:], len(order)], strict=True):
            own = order[a:b]
            v, w, u, row = self.v[own], self.w[own], self.u[own], self.row[own]
            first = np.flatnonzero(np.diff(v, prepend=-1))
            n = np.diff(first, append=len(own))
            v = v[first]
            if 16 * len(own) < len(seen):
                words = np.unique(np.concatenate([v, w, u]))
            else:
                seen[v] = seen[w] = seen[u] = True
                words = np.flatnonzero(seen)
                seen[words] = False
            place[words] = np.arange(len(words))
            # words ascend with one word before: steps take less room
            w = place[w]
            step = np.diff(w, prepend=0)
            step[first] = w[first]
            held_out = self.held_out[row]
            mark = _planes(2 * row + held_out) if rows else np.packbits(held_out)
            yield p, _zip(np.array([rows], "u1"), np.array([self.key], "<i8"), _steps(self.words[words]), n.astype("<u4"), _planes(place[v]), _planes(step), _planes(place[u]), mark)

    def rows(self) -> bytes:
        return _zip(np.array([self.key], "<i8"), self.doc_id.astype("<i8"), self.held_out.astype("u1"), self.nameless.astype("u1"), self.n_tokens.astype("<i8"))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[Pack]:
    held: list[list[np.ndarray]] = [[], [], [], [], []]
    n = rows = 0
    for batch in batches:
        ids, out, nameless = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        for at, word, first in token_runs(batch):
            to = at + len(first) - 1
            for have, more in zip(held, (word, np.diff(first), ids[at:to], out[at:to], nameless[at:to]), strict=True):
                have.append(more)
            n += len(word)
            rows += to - at
        if n >= PACK_EVENTS:
            yield Pack(*(np.concatenate(x) for x in held))
            held, n, rows = [[], [], [], [], []], 0, 0
    if rows:
        yield Pack(*(np.concatenate(x) for x in held))


def _sent(docs: DataFrame, parts: int, hot: np.ndarray, rows: bool) -> DataFrame:
    """part, events, rows: packed events by part; with rows, a pack's rows go along to one part."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches):
            part = part_of(pack.words, parts)[pack.v]
            is_hot = _is_hot(pack.words, shared.value)[pack.v]
            part[is_hot] = (pair_key(pack.words[pack.v[is_hot]], pack.words[pack.w[is_hot]]) % np.uint64(parts)).astype(np.int64)
            for p, blob in pack.sent(part, rows):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([blob], pa.binary()), pa.nulls(1, pa.binary())], names=["part", "events", "rows"])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([pack.key % parts], pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack.rows()], pa.binary())], names=["part", "events", "rows"])

    return _prepared(docs).mapInArrow(run, "part long, events binary, rows binary")


def _is_hot(words: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return np.isin(words >> np.uint64(64 - SKETCH_BITS), buckets) if len(buckets) else np.zeros(len(words), bool)


def _run_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _of_runs(begin: np.ndarray, n: int) -> np.ndarray:
    """Of each of n places, the number of its run."""
    return np.repeat(np.arange(len(begin)), np.diff(begin, append=n))


class Events:
    """One part's events, their different n-grams, and what is counted from those outside the held-out fold.

    Within the part words are numbers in the order of their hashes, so different
    trigrams are in order of word before, word, word two before: those of a bigram
    and of a context of one word lie together.
    """

    def __init__(self, blobs: list[bytes], hot: np.ndarray):
        u, v, w, mark, pack, own_words, begin = [], [], [], [], [], [], 0
        for raw in blobs:
            rows, key, steps, n, v_at, w_at, u_at, own = _unzip(raw, "u1", "<i8", "u1", "<u4", "u1", "u1", "u1", "u1")
            own_words.append(_ascending(steps))
            n = n.astype(np.int64)
            first, total = np.cumsum(n) - n, np.cumsum(_numbers(w_at), dtype=np.int64)
            total -= np.repeat(np.where(first > 0, total[first - 1], 0), n)
            for have, code in zip((v, w, u), (np.repeat(_numbers(v_at), n), total, _numbers(u_at)), strict=True):
                have.append(code.astype(np.int64) + begin)
            begin += len(own_words[-1])
            mark.append(_numbers(own) if rows[0] else np.unpackbits(own, count=len(w[-1])).astype(np.uint32))
            pack.append((int(key[0]), len(w[-1])))
        blobs.clear()
        self.names, number = np.unique(np.concatenate(own_words), return_inverse=True) if own_words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        number = number.reshape(-1).astype(np.int32)
        v, w, u = (number[np.concatenate(x)] if x else number for x in (v, w, u))
        mark = np.concatenate(mark) if mark else np.zeros(0, np.uint32)
        self.w, self.row, self.packs = w, (mark >> 1).astype(np.int64), pack
        learnt = (mark & 1 == 0).astype(np.int64)
        size, n = len(self.names), len(w)
        order = np.argsort((v.astype(np.int64) * size + w) * size + u) if size < 1 << 21 else np.lexsort((u, w, v))
        begin = _run_starts(v[order], w[order], u[order])
        #: of each event, the number of its trigram
        self.triple = np.empty(n, np.int32)
        self.triple[order] = _of_runs(begin, n)
        self.times = np.add.reduceat(learnt[order], begin) if n else np.zeros(0, np.int64)
        v, w, u = (x[order[begin]] for x in (v, w, u))
        self.u, n = u, len(u)
        # bigrams by the learnt trigrams in them
        begin = _run_starts(v, w)
        self.pair = _of_runs(begin, n)
        self.before = np.add.reduceat((self.times > 0).astype(np.int64), begin) if n else np.zeros(0, np.int64)
        self.pair_v, self.pair_w = v[begin], w[begin]
        # contexts of two words by the trigrams in them, contexts of one by the bigrams
        code, self.context = np.unique(v.astype(np.int64) * size + u, return_inverse=True)
        self.context = self.context.reshape(-1)
        self.two_v, self.two_u = code // max(size, 1), code % max(size, 1)
        self.two = _by_count(self.context, self.times, len(code))
        begin = _run_starts(self.pair_v)
        self.one_v, self.one_at = self.pair_v[begin], _of_runs(begin, len(self.pair_v))
        self.one = _by_count(self.one_at, self.before, len(begin))
        self.words = np.flatnonzero(np.bincount(self.w, minlength=size))
        self.word_count = np.bincount(self.w, learnt, size)[self.words]
        self.pair_word_count = np.bincount(self.pair_w[self.before > 0], minlength=size)[self.words]
        # hot contexts in the order of their hashes
        is_hot = _is_hot(self.names, hot)
        self.hot_one = np.flatnonzero(is_hot[self.one_v])
        self.hot_two = np.flatnonzero(is_hot[self.two_v])
        self.hot_two = self.hot_two[np.argsort(self.two_keys()[self.hot_two])]

    def pair_keys(self) -> np.ndarray:
        return pair_key(self.names[self.pair_v], self.names[self.pair_w])

    def triple_keys(self) -> np.ndarray:
        return pair_key(self.names[self.u], self.pair_keys()[self.pair])

    def two_keys(self) -> np.ndarray:
        return pair_key(self.names[self.two_u], self.names[self.two_v])

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """By kind, keys of what the part lacks, ascending, and its own share of each: four numbers."""
        word = np.zeros((len(self.words), 4))
        word[:, 0], word[:, 1] = self.pair_word_count, self.word_count
        return [(self.names[self.words], word), (self.two_keys()[self.hot_two], self.two[self.hot_two]), (self.names[self.one_v[self.hot_one]], self.one[self.hot_one])]


def _by_count(context: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Of each of n contexts, the sum of its counts, and how many are 1, 2, more."""
    return np.stack([np.bincount(context, x, n) for x in (count, count == 1, count == 2, count > 2)], axis=1)


def _count_stats(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and more, from how many types have counts 1 to 4; kept between 0 and the count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)]


def _discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.where(c > 0, c - np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)], 0.0)


def _rest(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """The mass that discounts leave in each context."""
    return counts[:, 1] * d[0] + counts[:, 2] * d[1] + counts[:, 3] * d[2]


_PART = "part long, deal long, asked binary, stats array<long>"


def _counted(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """What each part asks for by deal (part, deal, asked), and its counts of counts (stats)."""
    deals = max(1, -(-parts // DEAL_PARTS))
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        events = Events(rows["events"].to_pylist(), shared.value)
        stats = [*_count_stats(events.times), *_count_stats(events.before)]
        asked = []
        for kind, (keys, values) in enumerate(events.asked()):
            deal = part_of(keys, deals)
            for d in np.unique(deal).tolist():
                own = deal == d
                asked.append((kind * deals + d, _zip(_steps(keys[own]), *(values[own, k].astype("<u4") for k in range(4)))))
        n = len(asked)
        return pa.table(
            {
                "part": pa.array([part] * (n + 1), pa.int64()),
                "deal": pa.array([None, *(d for d, _ in asked)], pa.int64()), "asked": pa.array([None, *(x for _, x in asked)], pa.binary()), "stats": pa.array([stats, *[None] * n], pa.list_(pa.int64())),
            }
        )

    return _sent(docs, parts, hot, rows=False).groupBy("part").applyInArrow(run, _PART)


def _answered(counted: DataFrame, parts: int) -> DataFrame:
    """part, deal, answer: totals of what each part asked for, in order; and counts over all words (stats)."""
    deals = max(1, -(-parts // DEAL_PARTS))

    def run(rows: pa.Table) -> pa.Table:
        kind, to = rows["deal"][0].as_py() // deals, rows["part"].to_pylist()
        sent = [_unzip(raw, "u1", "<u4", "<u4", "<u4", "<u4") for raw in rows["asked"].to_pylist()]
        own = [_ascending(x[0]) for x in sent]
        keys, at = np.unique(np.concatenate(own), return_inverse=True)
        total = [np.bincount(at, np.concatenate([x[1 + k] for x in sent]), len(keys)).astype("<u8") for k in range(4)]
        answers = [_zip(*(x[np.searchsorted(keys, k)] for x in total)) for k in own]
        stats = [*_count_stats(total[0]), int(total[0].sum()), int((total[1] > 0).sum()), int(total[1].sum()), int((total[0] > 0).sum())] if kind == WORD else None
        n = len(to)
        return pa.table({"part": pa.array([*to, None], pa.int64()), "deal": pa.array([rows["deal"][0].as_py()] * (n + 1), pa.int64()), "answer": pa.array([*answers, None], pa.binary()), "stats": pa.array([*[None] * n, stats], pa.list_(pa.int64()))})

    return counted.where("asked is not null").select("part", "deal", "asked").groupBy("deal").applyInArrow(run, "part long, deal long, answer binary, stats array<long>")


def _dealt(events: Events, logp: np.ndarray, logc: np.ndarray, known: np.ndarray, rows: list[bytes], deals: int) -> dict[str, pa.Array]:
    """One part's sums by pack and row, and the rows of packs that came along, by where they are added up."""
    deal, pack, sums, begin = [], [], [], 0
    for key, n in events.packs:
        row = events.row[begin : begin + n]
        own = np.flatnonzero(np.bincount(row))
        values = [np.bincount(row, x[begin : begin + n])[own] for x in (logp, logc, known)]
        # a part's sums are of some words each: single precision keeps nine digits of the document's
        sums.append(_zip(_planes(own), values[0].astype("<f4"), values[1].astype("<f4"), _planes(values[2])))
        pack.append(key)
        begin += n
    for raw in rows:
        pack.append(int(_unzip(raw, "<i8", "<i8", "u1", "u1", "<i8")[0][0]))
    deal = [k % deals for k in pack]
    return {"deal": pa.array(deal, pa.int64()), "pack": pa.array(pack, pa.int64()), "sums": pa.array([*sums, *[None] * len(rows)], pa.binary()), "rows": pa.array([*[None] * len(sums), *rows], pa.binary())}


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, logc double, logp double"


def _summed(rows: pa.Table) -> pa.Table:
    """The rows of a group's packs with their sums over all parts."""
    by_pack: dict[int, list] = {}
    for pack, sums, own in zip(rows["pack"].to_pylist(), rows["sums"].to_pylist(), rows["rows"].to_pylist(), strict=True):
        by_pack.setdefault(pack, [[], []])[0 if own is None else 1].append(sums if own is None else own)
    out: list[list] = [[] for _ in range(7)]
    for sent, own in by_pack.values():
        # packs of the same rows in the same order share a key: as many copies of the rows, and of each part's sums
        _, doc_id, held_out, nameless, n_tokens = _unzip(own[0], "<i8", "<i8", "u1", "u1", "<i8")
        total = np.zeros((3, len(doc_id)))
        for raw in sent:
            at, *values, known = _unzip(raw, "u1", "<f4", "<f4", "u1")
            for k, x in enumerate((*values, _numbers(known))):
                total[k, _numbers(at)] += x
        total /= len(own)
        for _ in own:
            for have, more in zip(out, (doc_id, nameless, held_out, n_tokens, total[2], total[1], total[0]), strict=True):
                have.append(more)
    doc_id, nameless, held_out, n_tokens, known, logc, logp = (np.concatenate(x) for x in out)
    return pa.table(
        {
            "doc_id": pa.array(doc_id, pa.int64(), mask=nameless.astype(bool)), "held_out": pa.array(held_out.astype(bool)), "n_tokens": pa.array(n_tokens, pa.int64()),
            "n_known": pa.array(np.rint(known).astype(np.int64), pa.int64()), "logc": pa.array(logc), "logp": pa.array(logp),
        }
    )


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Null and empty texts have the end token alone. Learning is from rows outside
    the held-out fold; a null doc_id counts as an empty id text and comes back null.
    Rows that repeat are learnt and scored each. With nothing to learn from, every
    probability is uniform over the unknown word. Further columns are not read. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")

    def words(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((1 << SKETCH_BITS) + 1, np.int64)
        for _, word, _ in token_runs(batch):
            out[:-1] += np.bincount((word >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        out[-1] = len(batch)
        return out

    sketch = tally(_prepared(docs), words, (1 << SKETCH_BITS) + 1)
    events, rows = int(sketch.sum()), int(sketch[-1])
    sketch = sketch[:-1].copy()
    # start and end stand in each row
    for mark in (START, END):
        sketch[mark >> (64 - SKETCH_BITS)] += rows
    parts = max(1, -(-events // PART_EVENTS))
    hot = np.flatnonzero(sketch > PART_EVENTS).astype(np.uint64) if parts > 1 else np.zeros(0, np.uint64)

    counted = written(_counted(docs, parts, hot), "counts")
    answered = written(_answered(counted, parts), "answers")
    total = np.sum([r.stats for r in counted.where("stats is not null").select("stats").collect()] or [[0] * 8], axis=0)
    word = np.sum([r.stats for r in answered.where("stats is not null").select("stats").collect()] or [[0] * 8], axis=0)
    forget(counted)
    d3, d2, d1 = discounts(total[:4].tolist()), discounts(total[4:8].tolist()), discounts(word[:4].tolist())
    continuations, vocabulary, tokens, followers = (int(x) for x in word[4:])
    # mass that the discounts of the lowest order leave to words not seen
    n1, n2 = int(word[0]), int(word[1])
    left = (d1[0] * n1 + d1[1] * n2 + d1[2] * max(followers - n1 - n2, 0)) / continuations if continuations else 1.0
    deals, questions = max(1, -(-events // (PACK_EVENTS * DEAL_PACKS))), max(1, -(-parts // DEAL_PARTS))
    shared = spark.sparkContext.broadcast(hot)

    def score_part(key: tuple, left_rows: pa.Table, right_rows: pa.Table) -> pa.Table:
        packed = [x for x in left_rows["rows"].to_pylist() if x is not None]
        e = Events([x for x in left_rows["events"].to_pylist() if x is not None], shared.value)
        # answers by kind and range of keys, in the order of the keys the part has itself
        answers = sorted(zip(right_rows["deal"].to_pylist(), right_rows["answer"].to_pylist(), strict=True))
        asked = []
        for kind, (keys, _) in enumerate(e.asked()):
            numbers = [np.stack(_unzip(raw, "<u8", "<u8", "<u8", "<u8"), axis=1) for deal, raw in answers if deal // questions == kind]
            asked.append((keys, np.concatenate(numbers).astype(np.float64) if numbers else np.zeros((0, 4))))

        # hot contexts have their totals over all parts
        for counts, own, kind in ((e.two, e.hot_two, TWO), (e.one, e.hot_one, ONE)):
            counts[own] = asked[kind][1]
        with tempfile.TemporaryDirectory() as folder:
            file = lambda name: os.path.join(folder, name)
            known_w, numbers = asked[WORD]
            unigrams = HashArrays(file("words"), known_w, _discounted(numbers[:, 0], d1) / max(continuations, 1) + left / (vocabulary + 1), numbers[:, 1])
            p, c_w = unigrams.get(e.names)
            p = p[e.pair_w]
            # each different n-gram is looked up once, events take what theirs has found
            for name, keys, counts, at, context, grams, c, d in (("one", e.names[e.one_v], e.one, slice(None), e.one_at, e.pair_keys(), e.before, d2), ("two", e.two_keys(), e.two, e.pair, e.context, e.triple_keys(), e.times, d3)):
                known = counts[:, 0] > 0
                higher = HashArrays(file(name), keys[known], counts[known, 0], _rest(counts[known], d))
                ngrams = HashArrays(file(f"{name}-grams"), grams[c > 0], c[c > 0].astype(np.float64))
                (c,) = ngrams.get(grams)
                whole, rest = (x[context] for x in higher.get(keys))
                p = p[at]
                p = np.where(whole > 0, (_discounted(c, d) + rest * p) / np.maximum(whole, 1), p)
                del higher, ngrams
            logp, logc, seen = np.log10(p)[e.triple], np.log10(c_w + 1)[e.w], (c_w > 0).astype(np.int64)[e.w]
            del unigrams
        return pa.table(_dealt(e, logp, logc, seen, packed, deals))

    own = _sent(docs, parts, hot, rows=True).withColumnRenamed("part", "own_part")
    found = own.groupBy("own_part").cogroup(answered.where("answer is not null").select("part", "deal", "answer").groupBy("part")).applyInArrow(score_part, "deal long, pack long, sums binary, rows binary")
    spread = float(np.log10(tokens + vocabulary + 1))
    out = written(found.groupBy("deal").applyInArrow(_summed, _SCORES), "scores")
    forget(answered)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("logc") - F.col("n_tokens") * F.lit(spread)).alias("base_score"), F.col("logp").alias("score")
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, null ids, null texts and repeats included; see scores."""
    return scores(table(spark, sf_dir, "documents"))
