"""The language model's events by part, each different n-gram once, against plain counting."""

from collections import Counter

import numpy as np

from riskloom.llm import kneser


def pack(seed: int, rows: int) -> kneser.Pack:
    r = np.random.default_rng(seed)
    count = r.integers(0, 40, rows)
    word = kneser.mix(r.zipf(1.3, int(count.sum())).astype(np.uint64) % np.uint64(300) + np.uint64(7))
    return kneser.Pack(word, count, np.arange(rows), r.random(rows) < 0.3, np.zeros(rows, bool))


def test_events_are_sent_by_part_pair_and_place():
    own = pack(1, 60)
    part = (own.words[own.v] % np.uint64(5)).astype(np.int64)
    assert own._order(part).tolist() == np.lexsort((own.w, own.v, part)).tolist()


def test_each_ngram_of_a_part_stands_once_and_is_counted():
    packs = [pack(2, 50), pack(3, 70)]
    for rows in (False, True):
        events = kneser.Events([blob for p in packs for _, blob in p.sent(np.zeros(len(p.w), np.int64), rows)], np.zeros(0, np.uint64))
        got = Counter(zip(events.u[events.triple].tolist(), events.pair_v[events.pair[events.triple]].tolist(), events.w.tolist(), strict=True))
        want, learnt = Counter(), Counter()
        for p in packs:
            for u, v, w, row in zip(p.u, p.v, p.w, p.row, strict=True):
                key = tuple(int(np.searchsorted(events.names, p.words[x])) for x in (u, v, w))
                want[key] += 1
                learnt[key] += int(not p.held_out[row])
        keys = list(zip(events.u.tolist(), events.pair_v[events.pair].tolist(), events.pair_w[events.pair].tolist(), strict=True))
        # repeats of a trigram share one place, so it is looked up once
        assert got == want and len(set(keys)) == len(keys) == len(want) < want.total()
        assert events.times.tolist() == [learnt[k] for k in keys]
        before = Counter((v, w) for (_, v, w), n in learnt.items() if n)
        assert events.before.tolist() == [before[k] for k in zip(events.pair_v.tolist(), events.pair_w.tolist(), strict=True)]
        two = {(v, u): [sum(learnt[k] for k in want if k[:2] == (u, v)), *(sum(learnt[k] == n for k in want if k[:2] == (u, v)) for n in (1, 2))] for u, v, _ in want}
        assert events.two[:, :3].tolist() == [two[k] for k in zip(events.two_v.tolist(), events.two_u.tolist(), strict=True)]
