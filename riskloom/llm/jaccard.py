"""N-gram Jaccard join by set relations: an inverted index read in blocks by position, and answers derived from similar sets.

A document's set is its distinct 5-word shingles; two sets link when
100 * |both| >= 75 * |either|. Links are found without ever listing a group's pairs:

1. Equal sets are one set, known by the sum of their shingles' hashes. A count of
   all shingles in a fixed number of buckets tells common ones from the rest; the
   order of shingles everywhere is: uncommon first, then by hash.
2. A set's prefix in that order goes to an inverted index dealt by shingle. In a
   list, the set with the smallest signature is the leader; each other set is paired
   with the leader its lists name most often, and compared with it in full. Sets
   that fail are compared with the leader's other sets through what they lack and
   add against the leader, not through whole sets.
3. Links so far make components. All other pairs of short lists are compared where
   they lie in two components. Long lists are read again only for pairs between
   components, and only lists that still hold sets of several. A few waves compare
   two pairs at most for each set, which joins most; the last one compares all that
   are left, in blocks of one position sorted by set size: a block is skipped when
   no size in it can reach the overlap from there, and only the reachable run of
   sizes is read from the others. What two sets share with one leader bounds what
   they have in common, as do counts of their shingles in buckets, so most pairs of
   long lists need no comparison.

Every pair of sets that can link shares a prefix entry which passes the length and
position bounds, and is therefore compared, or lies in one component already.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.components import components, relabelled
from riskloom.llm.io import forget, shuffle_partitions, table, text_batches, written
from riskloom.llm.textkernel import Words, doc_unique, grams, mix, slices

SHINGLE = 5
#: Buckets of the count of all shingles.
SKETCH_BITS = 21
SKETCH_PARTS = 16
#: Entries of one part of the index, on average.
PART_ENTRIES = 1 << 20
#: Sets compared with one leader in one group, on average.
GROUP_SETS = 64
#: Times that two pairs at most for each set are tried before all pairs that are left.
WAVES = 3
#: Members of a list's main component that a set is held against before it waits for the next wave.
TRIES = 12
#: Entries of a list all pairs of which are looked at without further ado.
SHORT_LIST = 24
#: Buckets in which a set's shingles are counted, to bound what two sets have in common.
SKETCH = 512
#: Block bounds, and pairs, that one list's reading holds at once.
BLOCK_CELLS = 1 << 20
BLOCK_PAIRS = 1 << 21
#: Bits that tell documents whose text is wanted from most others.
FILTER_BITS = 24


def linked(both: np.ndarray | int | Column, a: np.ndarray | int | Column, b: np.ndarray | int | Column):
    """100 * |both| >= 75 * |either|, in whole numbers."""
    return 7 * both >= 3 * (a + b)


def prefix(n: np.ndarray) -> np.ndarray:
    """Of a set of n, the entries one of which any set it links with shares."""
    return n - (3 * n + 3) // 4 + 1


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingles ascending, bounds) for runs of rows."""
    for at, _, data, bounds in slices(texts):
        words = Words(data, bounds)
        yield at, *doc_unique(*grams(words.hashes(), words.first, SHINGLE))


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[begin[1:]] - total[begin[:-1]]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, sig of every document, and rows of the shingle counts (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["doc_id", "n", "sig", "part", "deal", "counts"]
        for batch in batches:
            n, sig = [], []
            for _, values, begin in shingle_sets(batch.column(1)):
                n.append(np.diff(begin))
                sig.append(_sums(values, begin))
                counts += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            rows = len(batch)
            empty = pa.nulls(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array((np.concatenate(sig) if sig else np.zeros(0, np.uint64)).view(np.int64), pa.int64()), empty, empty, pa.nulls(rows, pa.binary())], names=names)
        parts = [zlib.compress(x.astype("<u4").tobytes(), 1) for x in np.split(counts, SKETCH_PARTS)]
        deal = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(([None] * SKETCH_PARTS, [-1] * SKETCH_PARTS, [None] * SKETCH_PARTS, list(range(SKETCH_PARTS)), [deal] * SKETCH_PARTS, parts), kinds, strict=True)], names=names)

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, sig long, part int, deal int, counts binary")


def common_ranks(made: DataFrame) -> np.ndarray:
    """For each bucket, 0 where its count is ordinary, else how often it doubles the mean: bounded by SKETCH_BITS."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
        for raw in rows["counts"].to_pylist():
            raw = zlib.decompress(raw)
            total += np.frombuffer(raw, f"<u{len(raw) // len(total)}").astype(np.int64)
        return pa.table({"part": pa.array([rows["part"][0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.astype("<u8").tobytes(), 1)], pa.binary())})

    blobs = made.where("part is not null").select("part", "deal", "counts")
    dealt = blobs.groupBy("part", "deal").applyInArrow(add, "part int, counts binary")
    summed = written(dealt.groupBy("part").applyInArrow(add, "part int, counts binary"), "counts")
    rows = summed.orderBy("part").collect()
    forget(summed)
    counts = np.concatenate([np.frombuffer(zlib.decompress(r.counts), "<u8") for r in rows]).astype(np.float64) if rows else np.zeros(1 << SKETCH_BITS)
    usual = counts.mean() + 4 * np.sqrt(counts.mean()) + 2
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1, 0, 60).astype(np.uint8)


def index_entries(docs: DataFrame, ranks: np.ndarray, parts: int) -> DataFrame:
    """part, entries: the prefixes of a batch's sets, by part of the index.

    entries hold, each array in a row: sets uint32, sig uint64[sets], n uint32[sets],
    count uint32[sets], then for each entry its shingle's low half uint32 and position uint32.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = shared.value
        for batch in batches:
            sig, size, owner, shingle, place = [], [], [], [], []
            held = 0
            for _, values, begin in shingle_sets(batch.column(0)):
                n = np.diff(begin)
                own = _sums(values, begin)
                row = np.repeat(np.arange(len(n)), n)
                rank = rank_of[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if rank.any():
                    order = np.lexsort((values, rank, row))
                    values = values[order]
                at = np.arange(len(values)) - np.repeat(begin[:-1], n)
                keep = at < np.repeat(prefix(n), n)
                sig.append(own)
                size.append(n)
                owner.append(row[keep] + held)
                shingle.append(values[keep])
                place.append(at[keep])
                held += len(n)
            if not held:
                continue
            sig, size, owner, shingle, place = (np.concatenate(x) for x in (sig, size, owner, shingle, place))
            # a set that the batch holds twice goes out once
            _, first = np.unique(sig, return_index=True)
            fresh = np.zeros(held, bool)
            fresh[first] = True
            keep = fresh[owner]
            owner, shingle, place = owner[keep], shingle[keep], place[keep]
            if not len(owner):
                continue
            part = ((shingle >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((owner, part))
            owner, shingle, place, part = owner[order], shingle[order], place[order], part[order]
            used, edge = np.unique(part, return_index=True)
            blobs = []
            for a, b in zip(edge, [*edge[1:], len(part)], strict=True):
                who, count = np.unique(owner[a:b], return_counts=True)
                blobs.append(b"".join((np.array([len(who)], "<u4").tobytes(), sig[who].astype("<u8").tobytes(), size[who].astype("<u4").tobytes(), count.astype("<u4").tobytes(), (shingle[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), place[a:b].astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "entries"])

    return text_batches(docs).select(F.col("text").cast("string")).mapInArrow(run, "part long, entries binary")


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sig, n, shingle, position of every entry."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for raw in blobs:
        k = int(np.frombuffer(raw, "<u4", 1)[0])
        sig, n, count = np.frombuffer(raw, "<u8", k, 4), np.frombuffer(raw, "<u4", k, 4 + 8 * k), np.frombuffer(raw, "<u4", k, 4 + 12 * k)
        m = int(count.sum())
        for have, more in zip(out, (np.repeat(sig, count), np.repeat(n, count), np.frombuffer(raw, "<u4", m, 4 + 16 * k), np.frombuffer(raw, "<u4", m, 4 + 16 * k + 4 * m)), strict=True):
            have.append(more)
    sig, n, shingle, place = (np.concatenate(x) for x in out)
    return sig, n.astype(np.int64), shingle, place.astype(np.int64)


def _lists(sig: np.ndarray, n: np.ndarray, shingle: np.ndarray, place: np.ndarray, least: int):
    """The lists of at least so many entries, in order of shingle and set; where lists begin. A set stands in a list once."""
    order = np.lexsort((sig, shingle))
    sig, n, shingle, place = sig[order], n[order], shingle[order], place[order]
    once = np.ones(len(sig), bool)
    once[1:] = (shingle[1:] != shingle[:-1]) | (sig[1:] != sig[:-1])
    sig, n, shingle, place = sig[once], n[once], shingle[once], place[once]
    edge = np.flatnonzero(np.diff(shingle, prepend=shingle[:1] ^ 1)) if len(shingle) else np.zeros(0, np.int64)
    length = np.diff(np.append(edge, len(shingle)))
    keep = np.repeat(length >= least, length)
    sig, n, place, length = sig[keep], n[keep], place[keep], length[length >= least]
    return sig, n, place, np.concatenate([[0], np.cumsum(length)]).astype(np.int64)


class Lists:
    """Inverted lists: sets (sig, n), and for each entry its set's number and its position there; begin has where lists begin."""

    def __init__(self, sig: np.ndarray, n: np.ndarray, at: np.ndarray, place: np.ndarray, begin: np.ndarray):
        self.sig, self.n, self.at, self.place, self.begin = sig, n, at, place, begin

    @classmethod
    def of(cls, sig: np.ndarray, n: np.ndarray, place: np.ndarray, begin: np.ndarray) -> Lists:
        own, first, at = np.unique(sig, return_index=True, return_inverse=True)
        return cls(own, n[first], at.reshape(-1), place, begin)

    @property
    def length(self) -> np.ndarray:
        return np.diff(self.begin)

    def keep(self, entries: np.ndarray) -> Lists:
        """Only these entries, of lists that keep two at least."""
        left = np.add.reduceat(entries.astype(np.int64), self.begin[:-1]) if len(self.at) else np.zeros(0, np.int64)
        entries = entries & np.repeat(left >= 2, self.length)
        left = left[left >= 2]
        used, at = np.unique(self.at[entries], return_inverse=True)
        return Lists(self.sig[used], self.n[used], at.reshape(-1), self.place[entries], np.concatenate([[0], np.cumsum(left)]).astype(np.int64))

    def pack(self) -> bytes:
        head = np.array([len(self.sig), len(self.begin) - 1, len(self.at)], "<u4")
        return b"".join(x.tobytes() for x in (head, self.sig.astype("<u8"), self.n.astype("<u4"), self.length.astype("<u4"), self.at.astype("<u4"), self.place.astype("<u4")))

    @classmethod
    def unpack(cls, raw: bytes) -> Lists:
        k, lists, m = np.frombuffer(raw, "<u4", 3).tolist()
        sig, to = np.frombuffer(raw, "<u8", k, 12), 12 + 8 * k
        n, length, at, place = (np.frombuffer(raw, "<u4", c, to + 4 * s).astype(np.int64) for c, s in ((k, 0), (lists, k), (m, k + lists), (m, k + lists + m)))
        return cls(sig, n, at, place, np.concatenate([[0], np.cumsum(length)]).astype(np.int64))


def can_link(n_a, at_a, n_b, at_b):
    """Whether sets of these sizes whose first common shingle stands at these positions can overlap enough."""
    most = 1 + np.minimum(n_a - 1 - at_a, n_b - 1 - at_b)
    return linked(most, n_a, n_b)


def leader_pairs(rows: pa.Table) -> pa.Table:
    """From one part's entries: (a, b, times, short) of sets that may link, a the smaller one; and the long lists, with their sets.

    times is in how many lists a is b's leader, short whether they meet in a short
    list. Of long lists the leader's pairs are given alone, of short ones all.
    """
    part = rows["part"][0].as_py()
    sig, n, place, begin = _lists(*_unpack(rows["entries"].to_pylist()), 2)
    length = np.diff(begin)
    own, at = np.unique(sig, return_inverse=True)
    at = at.reshape(-1)
    # lists stand in order of set within, so the first entry is the smallest set
    lead = np.repeat(begin[:-1], length)
    long = length > SHORT_LIST
    after = np.flatnonzero((np.arange(len(sig)) != lead) & np.repeat(long, length))
    found = [(lead[after], after, False), *((left, right, True) for left, right in _near_entries(begin[:-1][~long], length[~long]))]
    codes, leads, shorts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for left, right, short in found:
        ok = can_link(n[left], place[left], n[right], place[right])
        left, right = left[ok], right[ok]
        codes.append(at[left] * max(len(own), 1) + at[right])
        leads.append((left == lead[right]).astype(np.int64))
        shorts.append(np.full(len(left), int(short)))
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    times, short = (np.bincount(where.reshape(-1), np.concatenate(x), len(code)).astype(np.int64) for x in (leads, shorts))
    a, b = (own[x].view(np.int64) for x in (code // max(len(own), 1), code % max(len(own), 1)))
    kept = Lists.of(sig, n, place, begin).keep(np.repeat(long, length))
    m, extra = len(code), 1 if len(kept.at) else 0
    return pa.table(
        {
            "a": pa.array([*a.tolist(), *[None] * extra], pa.int64()),
            "b": pa.array([*b.tolist(), *[None] * extra], pa.int64()),
            "times": pa.array([*times.tolist(), *[None] * extra], pa.int64()),
            "short": pa.array([*(short > 0).tolist(), *[None] * extra], pa.bool_()),
            "part": pa.array([None] * m + [part] * extra, pa.int64()),
            "lists": pa.array([None] * m + [kept.pack()] * extra, pa.binary()),
            "sets": pa.array([None] * m + [kept.sig.view(np.int64).tolist()] * extra, pa.list_(pa.int64())),
        }
    )


def _near_entries(begin: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of entries of each of these short lists, by their distance in the list."""
    for step in range(1, int(length.max(initial=1))):
        have = length > step
        begin, length = begin[have], length[have]
        count = length - step
        left = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        yield left, left + step


def _block_pairs(n: np.ndarray, place: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one list's entries that can link and are of two groups, some at a time.

    Entries stand in blocks of one position, sorted by size. Against an entry of
    size m at position i, a block at position j holds only sizes from (3m + 7j) / 4
    to (4m - 7i) / 3; blocks without any are skipped. The largest group's entries are
    never looked up, only found, so a list of one group and a stranger costs its length.
    """
    _, at, count = np.unique(group, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    rank = rank[at.reshape(-1)]
    order = np.lexsort((n, place))
    wide = int(n.max(initial=0)) + 2
    key, owner = (place * wide + n)[order], rank[order]
    block = np.unique(place)
    asked = np.flatnonzero(rank < len(count) - 1)
    step = max(1, BLOCK_CELLS // max(len(block), 1))
    for own in (asked[k : k + step] for k in range(0, len(asked), step)):
        m, i = n[own], place[own]
        low = -(-(3 * m[:, None] + 7 * block[None, :]) // 4)
        top = np.clip((4 * m - 7 * i) // 3, -1, wide - 1)[:, None]
        from_ = np.searchsorted(key, block * wide + np.minimum(low, wide - 1))
        to = np.searchsorted(key, block * wide + np.maximum(top, 0), side="right")
        count = np.where((low <= top) & (top >= 0), np.maximum(to - from_, 0), 0)
        total = np.cumsum(count.sum(axis=1))
        for rows in np.split(np.arange(len(own)), np.searchsorted(total, np.arange(BLOCK_PAIRS, int(total[-1]), BLOCK_PAIRS))) if len(own) else ():
            size, begin = count[rows].reshape(-1), from_[rows].reshape(-1)
            left = np.repeat(np.repeat(own[rows], len(block)), size)
            right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
            keep = owner[right] > rank[left]
            yield left[keep], order[right[keep]]


class State:
    """What is known of sets: the component, what each shares with the leader it was compared with, counts of shingles in buckets."""

    def __init__(self, node: np.ndarray, label: np.ndarray, lead: np.ndarray, both: np.ndarray, sketch: list[bytes | None] | None = None):
        order = np.argsort(node)
        self.node, self.label, self.lead, self.both = node[order], label[order], lead[order], both[order]
        self.sketch = [None] * len(node) if sketch is None else [sketch[k] for k in order]

    def of(self, lists: Lists) -> Known:
        """What is known of the lists' sets; one not known is a group and a leader of its own."""
        sig = lists.sig
        group, lead, both, row = sig.view(np.int64).copy(), sig.view(np.int64).copy(), lists.n.copy(), np.full(len(sig), -1)
        blobs: list[bytes] = []
        if len(self.node):
            at = np.minimum(np.searchsorted(self.node, sig), len(self.node) - 1)
            known = self.node[at] == sig
            group[known], lead[known] = self.label[at[known]], self.lead[at[known]]
            both[known] = np.where(self.both[at[known]] < 0, both[known], self.both[at[known]])
            for k in np.flatnonzero(known):
                if self.sketch[at[k]] is not None:
                    row[k] = len(blobs)
                    blobs.append(self.sketch[at[k]])
        return Known(lists, group, lead, both, row, np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, SKETCH))


class Known:
    """Sets of lists with group, leader, shingles shared with it, and the row of counts (-1: none)."""

    def __init__(self, lists: Lists, group: np.ndarray, lead: np.ndarray, both: np.ndarray, row: np.ndarray, counts: np.ndarray):
        self.n, self.group, self.lead, self.both, self.row, self.counts = lists.n, group, lead, both, row, counts

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets a and b (numbers) can overlap enough.

        Of one leader's shingles they have no more in common than either has of them,
        of others no more than either has; and in each bucket no more than either has there.
        """
        n_a, n_b = self.n[a], self.n[b]
        most = np.minimum(self.both[a], self.both[b]) + np.minimum(n_a - self.both[a], n_b - self.both[b])
        ok = (self.lead[a] != self.lead[b]) | linked(most, n_a, n_b)
        counted = np.flatnonzero(ok & (self.row[a] >= 0) & (self.row[b] >= 0))
        step = max(1, BLOCK_CELLS * 4 // SKETCH)
        for own in (counted[k : k + step] for k in range(0, len(counted), step)):
            most = np.minimum(self.counts[self.row[a[own]]], self.counts[self.row[b[own]]]).sum(axis=1, dtype=np.int64)
            ok[own] = linked(most, n_a[own], n_b[own])
        return ok


def _mixed(lists: Lists, group: np.ndarray) -> Lists:
    """The lists that hold sets of more than one component."""
    if not len(lists.at):
        return lists
    own = group[lists.at]
    mixed = np.minimum.reduceat(own, lists.begin[:-1]) != np.maximum.reduceat(own, lists.begin[:-1])
    return lists.keep(np.repeat(mixed, lists.length))


def few_pairs(lists: Lists, state: State, wave: int) -> tuple[Lists, np.ndarray]:
    """The mixed long lists, and (b, kind, a, times): for each set outside its lists' main component two sets to compare it with at most.

    One is of the main component, drawn anew in each wave, the other is a neighbour
    in an order of components that is drawn too. So a wave's pairs are no more than
    twice the sets, however long lists are.
    """
    lists = _mixed(lists, state.of(lists).group)
    if not len(lists.at):
        return lists, np.zeros((4, 0), np.int64)
    known = state.of(lists)
    group = known.group
    number = np.repeat(np.arange(len(lists.length)), lists.length)
    drawn = mix(group.view(np.uint64) + np.uint64(wave))
    order = np.lexsort((lists.at, drawn[lists.at], number))
    own, of = group[lists.at[order]], number[order]
    edge = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(own, prepend=own[0] - 1) != 0))
    count = np.diff(np.append(edge, len(order)))
    by_size = np.lexsort((count, of[edge]))
    main = by_size[np.flatnonzero(np.diff(of[edge][by_size], append=-1))]
    begin, size = edge[main], count[main]
    places = np.arange(len(order))
    rest = np.flatnonzero((places < begin[of]) | (places >= begin[of] + size[of]))
    found = [np.zeros((3, 0), np.int64)]

    def fits(b: np.ndarray, a: np.ndarray) -> np.ndarray:
        a, b = order[a], order[b]
        ok = can_link(lists.n[lists.at[a]], lists.place[a], lists.n[lists.at[b]], lists.place[b])
        # sets meet in many lists; what their counts say is worked out once
        pairs, at = np.unique(np.stack([lists.at[b[ok]], lists.at[a[ok]]]), axis=1, return_inverse=True)
        ok[ok] = known.may_link(pairs[0], pairs[1])[at.reshape(-1)]
        return ok

    def add(kind: int, b: np.ndarray, a: np.ndarray) -> None:
        found.append(np.stack([lists.at[order[b]], np.full(len(b), kind), lists.at[order[a]]]))

    todo = rest
    for k in range(TRIES):
        draw = mix(lists.sig[lists.at[order[todo]]] + np.uint64(wave * TRIES + k)) % size[of[todo]].astype(np.uint64)
        other = begin[of[todo]] + draw.astype(np.int64)
        ok = fits(todo, other)
        add(0, todo[ok], other[ok])
        todo = todo[~ok]
    before, after = rest[:-1], rest[1:]
    ok = (of[before] == of[after]) & (own[before] != own[after])
    before, after = before[ok], after[ok]
    ok = fits(after, before)
    add(1, after[ok], before[ok])
    pairs, times = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
    best = np.lexsort((times, pairs[1], pairs[0]))
    pairs, times = pairs[:, best], times[best]
    last = np.ones(len(times), bool)
    last[:-1] = (pairs[0][1:] != pairs[0][:-1]) | (pairs[1][1:] != pairs[1][:-1])
    sig = lists.sig.view(np.int64)
    return lists, np.stack([sig[pairs[0][last]], pairs[1][last], sig[pairs[2][last]], times[last]])


def all_pairs(lists: Lists, state: State) -> Iterator[np.ndarray]:
    """(a, b) of all sets of two components that meet in a list and can link, a the smaller one, unsigned; some at a time."""
    lists = _mixed(lists, state.of(lists).group)
    known = state.of(lists)

    def distinct(held: list[np.ndarray]) -> np.ndarray:
        code = np.unique(np.concatenate(held))
        return np.stack([code // len(lists.sig), code % len(lists.sig)])

    held, much = [], 0
    for k, m in zip(lists.begin[:-1], lists.length, strict=True):
        own = lists.at[k : k + m]
        for left, right in _block_pairs(lists.n[own], lists.place[k : k + m], known.group[own]):
            a, b = own[left], own[right]
            held.append(np.unique(np.minimum(a, b) * len(lists.sig) + np.maximum(a, b)))
            much += len(held[-1])
            if much > BLOCK_PAIRS:
                pairs = distinct(held)
                held, much = [pairs[0] * len(lists.sig) + pairs[1]], pairs.shape[1]
                if 2 * much > BLOCK_PAIRS:
                    yield lists.sig.view(np.int64)[pairs[:, known.may_link(*pairs)]]
                    held, much = [], 0
    if held:
        pairs = distinct(held)
        yield lists.sig.view(np.int64)[pairs[:, known.may_link(*pairs)]]


def crossing(listed: DataFrame, state: DataFrame, wave: int) -> DataFrame:
    """Pairs between components by part of the index: few_pairs and the lists still mixed, or in wave 0 all_pairs.

    listed: part, lists, sets. state: node, label, lead, both, sketch. Each part's state
    comes first, then its lists; pairs leave some at a time.
    """
    members = listed.select("part", F.explode("sets").alias("node"))
    known = members.join(state, "node").select("part", F.lit(0).alias("role"), "node", "label", "lead", "both", F.col("sketch").alias("lists"))
    rows = known.unionByName(listed.select("part", F.lit(1).alias("role"), "lists"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, sketch = None, [], []
        for batch in batches:
            of, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero((np.diff(of, prepend=of[:1] - 1) != 0) | (np.diff(role, prepend=-1) != 0)) if len(of) else []
            for a, b in zip(edge, [*edge[1:], len(of)], strict=True):
                if of[a] != part:
                    part, held, sketch = of[a], [], []
                own = batch.slice(a, b - a)
                if not role[a]:
                    held.append(np.stack([own.column(k).to_numpy() for k in (2, 3, 4, 5)]))
                    sketch += own.column(6).to_pylist()
                    continue
                node, label, lead, both = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
                for raw in own.column(6).to_pylist():
                    yield from _answers(int(part), Lists.unpack(raw), State(node.view(np.uint64), label, lead, both, sketch), wave)

    ordered = rows.select("part", "role", "node", "label", "lead", "both", "lists").repartition("part").sortWithinPartitions("part", "role")
    return ordered.mapInArrow(run, "a long, b long, kind int, times long, part long, lists binary, sets array<long>")


#: Kind of pairs all of which are compared; of kinds 0 and 1 a set gets one each.
ALL = 2
_ANSWER = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32()), ("times", pa.int64()), ("part", pa.int64()), ("lists", pa.binary()), ("sets", pa.list_(pa.int64()))])


def _answers(part: int, lists: Lists, state: State, wave: int) -> Iterator[pa.RecordBatch]:
    def batch(a, b, kind, times) -> pa.RecordBatch:
        none = [pa.nulls(len(a), f.type) for f in list(_ANSWER)[4:]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.int32()), pa.array(times, pa.int64()), *none], schema=_ANSWER)

    if not wave:
        for pairs in all_pairs(lists, state):
            yield batch(pairs[0], pairs[1], np.full(pairs.shape[1], ALL, np.int32), np.ones(pairs.shape[1], np.int64))
        return
    left, (b, kind, a, times) = few_pairs(lists, state, wave)
    yield batch(a, b, kind.astype(np.int32), times)
    if len(left.at):
        none = [pa.nulls(1, f.type) for f in list(_ANSWER)[:4]]
        yield pa.RecordBatch.from_arrays([*none, pa.array([part], pa.int64()), pa.array([left.pack()], pa.binary()), pa.array([left.sig.view(np.int64).tolist()], pa.list_(pa.int64()))], schema=_ANSWER)


class Relation:
    """A leader's set and what other sets lack and add against it; answers between those follow from that.

    Only links that join what was apart are given, so a group of any size gives fewer links than it has sets.
    """

    def __init__(self, leader: np.ndarray):
        self.leader, self.seen, self.root = leader, [], [-1]

    def _find(self, i: int) -> int:
        while self.root[i] >= 0:
            i = self.root[i]
        return i

    def shared(self, own: np.ndarray) -> np.ndarray:
        """Which of the leader's shingles a set has."""
        return np.isin(self.leader, own, assume_unique=True)

    def add(self, name: int, own: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int | None, int]]:
        """Links of a new set: None stands for the leader, which is number 0."""
        lacks = np.flatnonzero(~shared)
        both = len(self.leader) - len(lacks)
        adds = own[~np.isin(own, self.leader, assume_unique=True)]
        me = len(self.root)
        self.root.append(-1)
        if linked(both, len(self.leader), len(own)):
            self.root[me] = self._find(0)
            yield None, name
        for i, (other, other_lacks, other_adds) in enumerate(self.seen, 1):
            mine, theirs = self._find(me), self._find(i)
            n = len(self.leader) - len(other_lacks) + len(other_adds)
            if mine == theirs or 4 * min(n, len(own)) < 3 * max(n, len(own)):
                continue
            # |x and y| = |leader| - |what either lacks| + |what both add|
            lost = len(lacks) + len(other_lacks) - len(np.intersect1d(lacks, other_lacks, assume_unique=True))
            common = len(self.leader) - lost + len(np.intersect1d(adds, other_adds, assume_unique=True))
            if linked(common, n, len(own)):
                self.root[theirs] = mine
                yield other, name
        self.seen.append((name, lacks, adds))


def promising(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of pairs (a, b), a table, whose counts of shingles in buckets leave enough in common. sketches: sig, n, sketch.

    Where one of the two has no counts, sizes alone decide.
    """
    none = F.lit(bytes(SKETCH))
    sketches = among(sketches, pairs.select(F.explode(F.array("a", "b")).alias("sig")), "sig")
    for side in ("a", "b"):
        own = sketches.select(F.col("sig").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.join(own, side)

    @F.arrow_udf("boolean")
    def enough(n_a: pa.Array, n_b: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, SKETCH) for x in (a, b))
        return pa.array(linked(np.minimum(a, b).sum(axis=1, dtype=np.int64), n_a.to_numpy(), n_b.to_numpy()))

    a, b = F.col("sketch_a"), F.col("sketch_b")
    by_counts = enough("n_a", "n_b", F.coalesce(a, none), F.coalesce(b, none))
    by_size = linked(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b"))
    return pairs.where(F.when(a.isNull() | b.isNull(), by_size).otherwise(by_counts)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, derive: bool) -> DataFrame:
    """a, b, both, link for pairs (a, b): the shingles that both have, and whether the sets link.

    With derive, further links between sets with one a, of which both is null.
    named: sig, doc_id of the document whose text stands for a set. Pairs are grouped
    by a, large groups into several by a hash of b, and read in order: the leader's
    text first, then the others', one at a time.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(GROUP_SETS)).cast("int").alias("deals"))
    member = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal"))
    leader = sizes.select("a", F.col("a").alias("b"), F.explode(F.expr("sequence(0, deals - 1)")).alias("deal"))
    asked = written(member.withColumn("role", F.lit(1)).unionByName(leader.withColumn("role", F.lit(0))).join(named.select(F.col("sig").alias("b"), "doc_id"), "b"), "asked")
    rows = _texts(docs, asked).join(asked, "doc_id").select("a", "deal", "role", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, relation = None, None, None
        for batch in batches:
            a, deal, role, b = (batch.column(i).to_pylist() for i in range(4))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for at, values, begin in shingle_sets(batch.column(4)):
                names = _sums(values, begin).view(np.int64).tolist()
                for i, name in enumerate(names):
                    own, row = values[begin[i] : begin[i + 1]], at + i
                    # rows that share an id may differ in text, and rows may repeat; the set says which is meant, once
                    if name != b[row] or last == (a[row], deal[row], role[row], name):
                        continue
                    last = (a[row], deal[row], role[row], name)
                    if role[row] == 0:
                        key, relation = (a[row], deal[row]), Relation(own.copy())
                        continue
                    if key != (a[row], deal[row]):
                        raise ValueError("a group without its leader's text")
                    shared = relation.shared(own)
                    both = int(shared.sum())
                    for to, x in zip(out, (a[row], name, both, bool(linked(both, len(relation.leader), len(own)))), strict=True):
                        to.append(x)
                    if derive:
                        for other, mine in relation.add(name, own, shared):
                            if other is not None:
                                for to, x in zip(out, (other, mine, None, True), strict=True):
                                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "both", "link"])

    ordered = rows.repartition("a", "deal").sortWithinPartitions("a", "deal", "role", "b")
    out = written(text_batches(ordered).mapInArrow(run, "a long, b long, both long, link boolean"), "links")
    forget(asked)
    return out


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among wanted's, and few others: a bit for each bucket of keys, of which there is a fixed number, keeps most from being shuffled.

    The bits are a table of 2 MB at most, broadcast and tested without Python.
    """
    # Spark numbers bits, and runs of bits, from 1
    bucket = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)) + 1
    bits = wanted.select(bucket.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("__run")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("__bits"))
    at = F.bitmap_bit_position(bucket)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bits), F.bitmap_bucket_number(bucket) == F.col("__run"))
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of documents whose ids are among wanted's, and of few others."""
    return among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null"), wanted, "doc_id")


def sketched(docs: DataFrame, named: DataFrame) -> DataFrame:
    """sig, n, sketch of sets (sig, doc_id), one row each: counts of a set's shingles in buckets, null where one holds more than 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, size, sketch = [], [], []
            for _, values, begin in shingle_sets(batch.column(1)):
                own.append(_sums(values, begin))
                size.append(np.diff(begin))
                row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
                counts = np.bincount(row * SKETCH + (values & np.uint64(SKETCH - 1)).astype(np.int64), minlength=(len(begin) - 1) * SKETCH).reshape(-1, SKETCH)
                sketch += [x.astype(np.uint8).tobytes() if x.max() < 256 else None for x in counts]
            sig = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.int64()), pa.array(np.concatenate(size) if size else [], pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "sig", "n", "sketch"])

    made = text_batches(_texts(docs, named)).mapInArrow(run, "doc_id long, sig long, n long, sketch binary")
    return made.join(named, ["doc_id", "sig"]).select("sig", "n", "sketch").dropDuplicates(["sig"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for rows (doc_id, text); see components_of_sets."""
    return components_of_sets(docs).drop("sig")


def components_of_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sig (of the row's set), component_id for rows (doc_id, text).

    Null and empty texts and texts without words have the empty set, link with
    nothing and are components of their own, as is a document that no other is
    like. Rows that repeat are equal sets. A null doc_id has no name to link by:
    its row comes back with its count and a null component_id, and links nothing.
    Further columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    made = written(signatures(docs), "signatures")
    sets = made.where("n >= 0").select("doc_id", "n", "sig")
    named = sets.where("doc_id is not null and n > 0")
    ranks = common_ranks(made)
    total = sets.agg(F.sum(F.expr("n div 4 + 1"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // PART_ENTRIES))
    entries = index_entries(docs.where("doc_id is not null"), ranks, parts)
    listed = written(entries.groupBy("part").applyInArrow(leader_pairs, "a long, b long, times long, short boolean, part long, lists binary, sets array<long>"), "index")

    sides = written(listed.where("part is null").groupBy("a", "b").agg(F.sum("times").alias("times"), F.bool_or("short").alias("short")), "sides")
    chosen = written(sides.where("times > 0").groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b"), "pairs")
    # what short lists say and no leader was chosen for
    rest = sides.where("short").select("a", "b").join(chosen, ["a", "b"], "left_anti")
    mixed = listed.where("part is not null").select("part", "lists", "sets")
    # each set's text, from the document with the smallest id
    first = named.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    wanted = sides.select(F.explode(F.array("a", "b")).alias("sig")).unionByName(mixed.select(F.explode("sets").alias("sig"))).distinct()
    wanted = written(wanted.join(first, "sig"), "wanted")
    sketches = written(sketched(docs, wanted), "sketches")

    found = verified(promising(chosen, sketches), docs, wanted, derive=True)
    labels = components(found.where("link").select("a", "b"))
    leaders = written(found.where("both is not null").select(F.col("b").alias("node"), F.col("a").alias("lead"), "both"), "leaders")
    forget(found)
    # everywhere a is the smaller one, unsigned
    tried, past, idle = chosen, [listed, sides, chosen], False
    for wave in (*range(1, WAVES + 1), 0):
        if wave and idle:
            continue
        met = mixed.select(F.explode("sets").alias("node")).distinct()
        state = among(sketches.select(F.col("sig").alias("node"), "sketch"), met, "node").join(leaders, "node", "left").join(labels, "node", "left")
        state = state.select("node", F.coalesce("label", "node").alias("label"), F.coalesce("lead", "node").alias("lead"), F.coalesce("both", F.lit(-1)).alias("both"), "sketch")
        answer = written(crossing(mixed, state, wave), "crossing")
        pairs = answer.where("part is null").select("a", "b", "kind", "times")
        best = pairs.where(F.col("kind") != ALL).groupBy("b", "kind").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")
        pairs = pairs.where(F.col("kind") == ALL).select("a", "b").unionByName(best)
        if wave == 1:
            pairs = pairs.unionByName(_apart(rest, labels))
        if wave:
            mixed = answer.where("part is not null").select("part", "lists", "sets")
        pairs = pairs.select(F.when(_below("a", "b"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(_below("a", "b"), F.col("b")).otherwise(F.col("a")).alias("b"))
        untried = written(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "untried")
        pairs = written(promising(untried, sketches), "pairs")
        forget(untried)
        past += [answer, pairs]
        # a wave that joins nothing is the last before all pairs that are left
        idle = True
        if pairs.limit(1).count():
            tried = tried.unionByName(pairs)
            more = verified(pairs, docs, wanted, derive=False)
            links = more.where("link").select("a", "b")
            if links.limit(1).count():
                idle = False
                after = relabelled(labels, links)
                forget(labels)
                labels = after
            forget(more)

    grouped = first.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    grouped = written(grouped, "grouped")
    # a table of its own, so that a label of many sets can be split
    lowest = written(grouped.groupBy("label").agg(F.min("doc_id").alias("component_id")), "lowest")
    of_set = written(grouped.join(lowest, "label").select("sig", "component_id"), "components")
    forget(*past, wanted, sketches, leaders, labels, grouped, lowest)
    # empty sets and rows without a name never meet in one task
    alone = sets.where("doc_id is null or n = 0").withColumn("component_id", F.col("doc_id"))
    out = named.join(of_set, "sig").select("doc_id", "n", "sig", "component_id").unionByName(alone.select("doc_id", "n", "sig", "component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "sig", "component_id")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that lie in two components."""
    own = pairs
    for side in ("a", "b"):
        own = own.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    return own.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _below(a: str, b: str):
    """a < b, both unsigned."""
    return F.col(a).bitwiseXOR(F.lit(-(2**63))) < F.col(b).bitwiseXOR(F.lit(-(2**63)))


def signed(docs: DataFrame, name: str = "sig") -> DataFrame:
    """docs (any columns, text among them) with the signature of each row's set."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_sums(values, begin) for _, values, begin in shingle_sets(batch.column(at))]
            sig = (np.concatenate(own) if own else np.zeros(0, np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.int64())], names=[*batch.schema.names, name])

    return text_batches(docs).mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias(name)).schema)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, null ids, null texts and repeats included; see components_of_sets."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
