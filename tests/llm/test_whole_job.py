"""Cases in which an operator once did less than the whole job, against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from riskloom.llm import jaccard, toxicity


def components(texts):
    """doc_id -> smallest id of its component, by comparing all pairs."""
    sets = {}
    for i, text in texts:
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_bridges_over_lists_of_two(spark):
    """Q links P and R, which don't link; what all three share ranks as common and stands last."""
    r, texts = random.Random(8), []
    for k in range(30):
        word = iter([f"w{k}x{x}" for x in r.sample(range(10**6), 80)])
        q, p, s = [next(word) for _ in range(60)], [next(word) for _ in range(6)], [next(word) for _ in range(6)]
        texts += [(3 * k, " ".join(q[:54] + p)), (3 * k + 1, " ".join(s + q[6:])), (3 * k + 2, " ".join(q))]
    low = components(texts)
    assert all(low[3 * k] == low[3 * k + 1] == low[3 * k + 2] == 3 * k for k in range(30))
    out = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == low


def test_links_that_meet_in_lists_of_two_only(spark):
    """Each text with its first word changed, and with its last: each change leaves 6 of 8 shingles, 75 % exactly."""
    r, texts = random.Random(2), []
    for k in range(1500):
        own = [f"{r.randrange(10**9)}" for _ in range(11)]
        for n, w in enumerate((own, ["first", *own[1:]], [*own[:-1], "last"])):
            texts.append((3 * k + n, " ".join(w)))
    r.shuffle(texts)
    out = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(out) == 4500 and [x for x in out if x.component_id != x.doc_id // 3 * 3 or x.n_shingles != 7] == []


def test_long_list_of_one_component_and_a_stranger():
    """20,000 sets in one list and one component, but for one: 20,000 pairs at most are ever held."""
    n, place = np.full(20_001, 150), np.zeros(20_001, np.int64)
    group = np.zeros(20_001, np.int64)
    group[777] = 5
    held = [len(a) for a, _ in jaccard._block_pairs(n, place, group)]
    assert sum(held) == 20_000 and max(held) <= 20_000
    half = np.arange(20_001) % 2
    assert max(len(a) for a, _ in itertools.islice(jaccard._block_pairs(n, place, half), 3)) <= 2 * jaccard.BLOCK_PAIRS


def test_counts_in_buckets_never_hide_a_link():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = r.choice(2**40, 120, replace=False)
        b = np.concatenate([a[r.integers(0, 60) :], r.choice(2**40, int(r.integers(0, 40)))])
        both, n = len(np.intersect1d(a, b)), np.array([len(np.unique(a)), len(np.unique(b))])
        counts = np.stack([np.bincount(np.unique(x) % jaccard.SKETCH, minlength=jaccard.SKETCH) for x in (a, b)])
        lists = jaccard.Lists(np.array([1, 2], np.uint64), n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64))
        state = jaccard.State(lists.sig, np.array([1, 2]), np.array([1, 2]), np.array([-1, -1]), [x.astype(np.uint8).tobytes() for x in counts])
        if jaccard.linked(both, *n):
            assert state.of(lists).may_link(np.array([0]), np.array([1])).all()


def test_sets_too_large_for_counts_link(spark):
    """160,000 words: buckets hold more than 255 shingles, so such sets have no counts; two are 75 % alike exactly, the third is not."""
    n = 7 * 22_860
    word = [f"w{k}" for k in range(3 * n)]
    # sets of n shingles of which 6 n / 7 are common, and one less for the third
    texts = [(i, " ".join(word[at : at + n + 4])) for i, at in ((1, 0), (2, n // 7), (3, 2 * (n // 7) + 1))]
    out = jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == {(1, n, 1), (2, n, 1), (3, n, 3)}


def test_an_id_on_two_rows_loses_only_the_copy(spark):
    """Id 2 stands on a copy of 1 and on a text of its own, which nothing is like."""
    copy, own, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, copy), (2, copy), (2, own), (2, own), (3, other), (4, other), (None, copy), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert len(left) == len(set(left)) and set(left) == {(1, copy), (2, own), (3, other), (None, copy), (5, None), (5, "")}


def letter_model():
    r = random.Random(4)
    words = ["idiot", "stupid", "worthless", "ass", "the", "garden", "opens", "early", "when", "rain", "falls", "over", "town", "river"]
    text = pa.array([" ".join(r.choices(words, k=40)) for _ in range(200)])
    return toxicity.letter_costs(toxicity.letter_counts(pa.record_batch([text], names=["text"])))


@pytest.mark.parametrize("form, word", [("id.iot", "idiot"), ("id·iot", "idiot"), ("stu pid", "stupid"), ("id iot", "idiot"), ("wor-th-less", "worthless"), ("a$$", "ass"), ("$tupid", "stupid"), ("worthl€ss", "worthless"), ("1diot!!", "idiot")])
def test_separators_spaces_and_signs_reach_the_lattice(form, word):
    text = f"the garden {form} opens early"
    ((_, data, _, fixed),) = toxicity.Reader(letter_model()).texts(pa.array([text]))
    assert [(data[a:b].tobytes().decode(), s) for _, a, b, s in fixed if data[a:b].tobytes().decode() != s] == [(form, word)]


def test_what_stands_there_is_a_reading():
    text = "the town, over rain! when the river falls (early) garden-town"
    ((_, data, _, fixed),) = toxicity.Reader(letter_model()).texts(pa.array([text]))
    assert all(data[a:b].tobytes().decode() == s for _, a, b, s in fixed)


def test_many_signs_in_a_row_lose_no_reading():
    """Random letter costs, so any state may turn out cheapest; against all paths of the lattice."""
    costs = np.random.default_rng(2).uniform(0, 6, (toxicity.CLASSES,) * 4).astype(np.float32)

    def cost_of(path):
        total, state = 0.0, (0, 0, 0)
        for letters, extra in path:
            total += extra
            for letter in letters:
                d = toxicity._class_of(letter)
                if d or state[2]:
                    total += float(costs[*state, d])
                    state = (*state[1:], d)
        return total

    for text in ("a((!!@@||11b", "a11++$$@@||b", "a11@@$$++((b", "a11!!((||@@b", "a||!!11@@((b", "a11$$++!!@@b"):
        best = min(itertools.product(*toxicity._lattice(text), [(" ", 0.0)]), key=cost_of)
        want = text if toxicity._as_it_stands(text, costs) <= cost_of(best) else " ".join("".join(x for x, _ in best).split())
        assert toxicity.restore(text, costs) == want


def test_quality_stage_decides_as_its_operator(spark, monkeypatch):
    docs = spark.createDataFrame([(4, "a"), (6, "b"), (7, "c"), (9, "d")], "doc_id long, text string")
    monkeypatch.setattr(P, "table", lambda *_: None)
    monkeypatch.setattr(P.quality, "train", lambda *_: None)
    monkeypatch.setattr(P.quality, "score", lambda docs, _, column: docs.withColumn(column, docs.doc_id / 10))
    assert {r.doc_id for r in P.drop_poor(spark, docs, "").collect()} == {7, 9}
