"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import ann, huffman, jaccard, kneser, mixing, packing, quality, tokens, topk, toxicity, vectors, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdefg", k=r.randint(1, 6))) for _ in range(300)]
    out = []
    for i in range(60):
        out.append([i, " ".join(r.choices(vocabulary, k=r.randint(1, 90)))])
    for i in range(60, 90):
        base = out[r.randrange(20)][1].split(" ")
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = "changed"
        out.append([i, r.choice([" ", "\n", "\t\x0b"]).join(base).upper() if i % 2 else " ".join(base)])
    out += [[90, None], [91, ""], [92, " \n "], [93, "one two"], [94, "one TWO"], [95, "x " * 5000], [96, out[0][1]], [96, out[0][1]], [97, "Grüße <|endoftext|> don't  stop日本語 ÉÉ"], [98, "a b c d e"]]
    return [(i, t, "en", [None, "a", "b", "c"][i % 4], None if t is None else len(t)) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("text_2", F.lit("extra")).repartition(3)


def test_near_duplicates(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_ENTRIES", 200)
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    low = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    out = jaccard.near_duplicates(docs).collect()
    assert len(out) == len(rows) and len(links) > 10
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == {(i, len(sets[i]), low[i]) for i in sets}


def test_near_duplicates_without_links_names_or_rows(spark):
    some = spark.createDataFrame([(1, "a b c d e f g"), (None, "a b c d e f g"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(some).collect()} == {(1, 3, 1), (None, 3, None), (2, 0, 2)}
    assert jaccard.near_duplicates(some.limit(0)).count() == 0


def test_set_relations():
    r = random.Random(3)
    for _ in range(200):
        base = set(r.sample(range(60), 40))
        group = [np.array(sorted((base - set(r.sample(range(60), r.randint(0, 14)))) | set(r.sample(range(60, 90), r.randint(0, 8)))), np.uint64) for _ in range(5)]
        relation, root = jaccard.Relation(np.array(sorted(base), np.uint64)), {i: i for i in range(-1, 5)}

        def find(i, root=root):
            return i if root[i] == i else find(root[i])

        got = [(-1 if a is None else a, b) for i, s in enumerate(group) for a, b in relation.add(i, s, relation.shared(s))]
        for a, b in got:
            root[find(a)] = find(b)
        everything = {-1: base, **{i: set(s.tolist()) for i, s in enumerate(group)}}
        for a in everything:
            for b in everything:
                if a < b and 100 * len(everything[a] & everything[b]) >= 75 * len(everything[a] | everything[b]):
                    assert find(a) == find(b)


def test_block_pairs_miss_nothing():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = r.integers(1, 40, 60)
        place = np.array([r.integers(0, max(1, x - (3 * x + 3) // 4 + 1)) for x in n])
        group = r.integers(0, 30, 60)
        got = [tuple(sorted(p)) for a, b in jaccard._block_pairs(n, place, group) for p in zip(a.tolist(), b.tolist(), strict=True)]
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if group[i] != group[j] and jaccard.can_link(n[i], place[i], n[j], place[j])}
        assert set(got) == want and len(got) == len(want)


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 4)]) for i in range(300)] + [(300, None), (301, [1.0, None, 1.0, 1.0]), (302, [1.0, float("nan"), 1.0, 1.0]), (303, [float("inf")] * 4), (304, [1e300] * 4), (306, [1e300] * 4), (305, [1.0, 2.0])]
    frame = topk.whole_numbers(vectors.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    out = defaultdict(list)
    for x in topk.top_k(frame.where("vec_id % 50 = 0 or vec_id = 304"), frame, k=5, block_rows=3, shard_rows=20).orderBy("query_id", "rank").collect():
        out[x.query_id].append((x.rank, x.vec_id, x.score))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and None not in v and all(map(math.isfinite, v))}
    for q in [*range(0, 300, 50), 304]:
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert out[q] == [(k, i, -s) for k, (s, i) in enumerate(best, 1)], q
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 50)
    r = np.random.default_rng(4)
    base = r.normal(size=(600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist()) for i in range(200)] + [(2000, [0.0] * 8), (2001, None)]
    frame = vectors.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), nonzero=True)
    out = ann.nearest(frame, frame.where("vec_id % 20 = 0"), 10).collect()
    have = {i: np.array(v) for i, v in rows if v and any(v)}
    hits = total = 0
    for q in [i for i in have if i % 20 == 0]:
        near = sorted((float(np.sqrt(((have[q] - v) ** 2).sum())), i) for i, v in have.items() if i != q)[:10]
        own = sorted((x.rank, x.vec_id, x.score) for x in out if x.query_id == q)
        assert [k for k, *_ in own] == list(range(1, 11)) and all(abs(s - float(np.sqrt(((have[q] - have[i]) ** 2).sum()))) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in near} | {i for _, i, s in own if s <= near[-1][0]})
        total += 10
    assert hits / total >= 0.9
    few = frame.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id = 0"), 10).count() == 4 and ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def own_ids(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    return [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t, *_ in rows]


def test_token_files(spark, docs, own_ids, monkeypatch, tmp_path):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 500)
    path = f"file://{tmp_path}/ids"
    huffman.write(huffman.token_table(docs, tokens.vocabulary_path()), path, shards=3)
    out = huffman.read(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in out) == sorted((i, x.tobytes()) for i, x in own_ids)
    assert [r.doc_id for r in out] == sorted(i for i, _ in own_ids) and [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 700, 60_000])
def test_codes(n):
    r = np.random.default_rng(n)
    counts = np.zeros(n + 3, np.int64)
    counts[:n] = r.zipf(1.2, n) % 10**6 + 1
    code = huffman.Code(huffman.code_lengths(counts))
    assert code.width <= 16
    for m in (0, 1, 255, 256, 257, 3000):
        ids = r.choice(n, m, p=counts[:n] / counts[:n].sum())
        offsets, packed = code.pack(ids)
        assert (code.unpack(m, offsets, packed) == ids).all()


def test_packing(docs, own_ids):
    pieces = packing.pack_documents(docs, tokens.vocabulary_path()).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    texts = defaultdict(set)
    for i, x in own_ids:
        texts[i].add(x.tobytes())
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
        assert any(zlib.crc32(t[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 and len(t) == 4 * p.doc_tokens for t in texts[p.doc_id])
    padded = 0
    for own in by_sequence.values():
        own.sort()
        n = own[-1][0] + own[-1][1]
        assert [o for o, _ in own] == np.cumsum([0] + [k for _, k in own])[:-1].tolist() and n <= 2048
        padded += n if n & (n - 1) == 0 else 2048
    assert padded <= 1.01 * sum(len(x) for _, x in own_ids)
    assert sum(p.length for p in pieces) == sum(len(x) for _, x in own_ids)
    for own in by_doc.values():
        assert sum(p.length for p in own) == sum(len(t) // 4 for t in texts[own[0].doc_id]) * (2 if own[0].doc_id == 96 else 1)


def test_packer_limits():
    packer = packing.Packer(packing.Limits(100, 3, 40), cut=False, pool=5)
    r = random.Random(1)
    items = [(i, r.randint(1, 60), 0) for i in range(200)]
    items = [(i, t, r.randint(0, min(t, 40))) for i, t, _ in items]
    out = []
    for i, t, loss in items:
        packer.add(i, 0, t, loss)
        out += list(packer.closed())
    out += list(packer.closed(flush=True))
    loss_of, size_of = {i: x for i, _, x in items}, {i: t for i, t, _ in items}
    assert sorted(k for s in out for k, _, _ in s) == list(range(200))
    for s in out:
        assert sum(size_of[k] for k, _, _ in s) <= 100 and len(s) <= 3 and sum(loss_of[k] for k, _, _ in s) <= 40


def test_word_pieces(docs, rows):
    import public_tokenizers

    path = public_tokenizers.path(wordpiece.VOCABULARY)
    first, inner = map(set, wordpiece.pieces_of(path))

    def greedy(w):
        n = at = 0
        while at < len(w):
            to = next((b for b in range(len(w), at, -1) if w[at:b] in (inner if at else first)), None)
            if to is None:
                return -1
            n, at = n + 1, to
        return n

    want = Counter()
    for i, t, *_ in rows:
        own = [greedy(w) for w in WORD.findall(t or "")]
        want[i, len(own), sum(max(n, 1) if n > 0 else 1 for n in own), sum(n < 0 for n in own)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in wordpiece.token_counts(docs, path).collect()) == want


@pytest.mark.parametrize("part, pack", [(100, 300), (3000, 10**6), (10**6, 10**6)])
def test_language_model(docs, rows, monkeypatch, part, pack):
    monkeypatch.setattr(kneser, "PART_EVENTS", part)
    monkeypatch.setattr(kneser, "PACK_EVENTS", pack)
    texts = [(i, ["<s>", "<s>", *words(t), "</s>"], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t, *_ in rows]
    one, three = Counter(), Counter()
    for _, w, out in texts:
        if not out:
            one.update(w[2:])
            three.update(zip(w, w[1:], w[2:], strict=False))
    total, kinds = sum(one.values()), len(one)
    two, before = Counter((v, w) for _, v, w in three), Counter()
    before.update(w for _, w in two)

    def level(grams):
        context, seen = Counter(), defaultdict(lambda: [0, 0, 0])
        for g, n in grams.items():
            context[g[:-1]] += n
            seen[g[:-1]][min(n, 3) - 1] += 1
        return grams, context, seen, kneser.discounts([sum(n == k for n in grams.values()) for k in (1, 2, 3, 4)])

    d1 = kneser.discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)])
    pairs = sum(before.values())
    left = sum(d1[min(n, 3) - 1] for n in before.values()) / pairs
    levels = [level(two), level(three)]

    def p(*g):
        if len(g) == 1:
            return (before[g[0]] - d1[min(before[g[0]], 3) - 1] if before[g[0]] else 0) / pairs + left / (kinds + 1)
        grams, context, seen, d = levels[len(g) - 2]
        low = p(*g[1:])
        if not context[g[:-1]]:
            return low
        n = grams[g]
        return ((n - d[min(n, 3) - 1] if n else 0) + sum(map(math.prod, zip(d, seen[g[:-1]], strict=True))) * low) / context[g[:-1]]

    out = defaultdict(list)
    for r in kneser.scores(docs).collect():
        out[r.doc_id].append(r)
    for i, w, held_out in texts:
        r = out[i].pop()
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, len(w) - 2, sum(one[x] > 0 for x in w[2:]), total)
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 1) / (total + kinds + 1)) for x in w[2:]))
        assert r.score == pytest.approx(sum(math.log10(p(*g)) for g in zip(w, w[1:], w[2:], strict=False)))
    assert not any(out.values())
    for context in (("<s>", "one"), ("<s>", "<s>"), ("unseen", "one")):
        assert sum(p(*context, w) for w in one) + p(*context, "unseen") == pytest.approx(1.0)


def test_language_model_of_nothing(docs):
    assert kneser.scores(docs.limit(0)).count() == 0


def test_mixing(docs, rows):
    out = mixing.copies(docs.withColumn("size", mixing.word_count(F.col("text")))).collect()
    size = defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s))
    total, target, fixed = sum(size.values()), {}, set()
    while True:
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        rest = total - sum(3 * size[s] for s in fixed)
        share = {s: rest * weight[s] / sum(weight[x] for x in order if x not in fixed) for s in order if s not in fixed}
        above = {s for s in share if share[s] > 3 * size[s]}
        if not above:
            target = share | {s: 3 * size[s] for s in fixed}
            break
        fixed |= above
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and r.taken == r.copies * r.size <= 3 * r.size
    assert len(out) == len(rows) and mixing.copies(docs.limit(0).withColumn("size", F.lit(0))).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in out)


def _labelled(spark):
    r = random.Random(9)
    clean = ["".join(r.choices("abcdehilnorstu", k=r.randint(2, 8))) for _ in range(200)]
    texts, labels = [], []
    for i in range(700):
        own = r.choices(clean, k=r.randint(5, 60))
        toxic, poor = i % 3 == 0, i % 5 == 0
        if toxic:
            own.insert(r.randrange(len(own)), r.choice(["stupid", "moron", "worthless"]))
        texts.append((i, " ".join(x + "***" for x in own) if poor else " ".join(own)))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), clean


def test_classifiers(spark):
    docs, labels, clean = _labelled(spark)
    extra = spark.createDataFrame([(1000, None), (1001, ""), (None, "word " * 20000)], "doc_id long, text string")
    for score, model, label in ((quality.score, quality.train(docs, labels), "quality"), (toxicity.score, toxicity.train(docs, labels), "toxic")):
        own = score(docs.unionByName(extra), model, "score")
        assert own.count() == 703 and own.where("score is null or score < 0 or score > 1").count() == 0
        right = own.join(labels, "doc_id").agg(F.avg((F.col("score") >= 0.7).cast("int").eqNullSafe(F.col(label)).cast("int"))).first()[0]
        assert right > 0.97, label
        assert score(docs.limit(0), model, "score").count() == 0
    hidden = spark.createDataFrame([(i, " ".join(clean[:9]) + " " + t) for i, t in enumerate(["st0pid is not", "stup1d", "s t u p i d", "m0r0n", "m.o.r.o.n", "moooron", "w0rthless"])], "doc_id long, text string")
    caught = {r.doc_id for r in toxicity.score(hidden, model, "score").where("score >= 0.7").collect()}
    assert caught >= {1, 2, 3, 4, 5, 6}
    again = toxicity.deobfuscate(hidden, model.costs).where("doc_id = 3").first().restored
    assert again.endswith("moron") and again.startswith(clean[0])


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs.select("doc_id", "text"), quality.train(docs, none), "score").where("score is not null").count() == docs.count()
    assert toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, none), "score").where("score >= 0.7").count() == 0


def test_components(spark):
    from riskloom.llm import components

    r = random.Random(8)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(12)]
    links = [(a, b) for a, b in links if a != b]
    low = {x: x for p in links for x in p}
    for _ in range(200):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    out = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {(x.node, x.label) for x in out.collect()} == set(low.items())
    half = components.components(spark.createDataFrame(links[::2], "a long, b long"))
    assert {(x.node, x.label) for x in components.relabelled(half, spark.createDataFrame(links[1::2], "a long, b long")).collect()} == set(low.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
