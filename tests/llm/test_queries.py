"""Every query and pipeline stage on one small folder of awkward tables: nulls in any column, repeats, empty and long texts, clashing names, empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from riskloom.llm import linear, packing, quality, registry, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, copies string, sig string, score double, pipeline_score double, mix_size int, n int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(150)]
    out = []
    for i in range(120):
        text = " ".join(r.choices(words, k=r.randint(1, 80)))
        if i % 4 == 0:
            text += " stupid moron"
        out.append((i, text, "en", ["a", "b", None][i % 3], len(text)))
    out += [(0, out[0][1], "en", "a", 1), (0, out[0][1], "en", "a", 1), (3, "another text of the same id", None, "b", None), (None, out[5][1], None, None, None), (None, None, None, None, None), (500, None, "de", "a", 0), (501, "", "de", "b", 0), (502, "long " * 30_000, "de", "b", 1)]
    return [(*x, 7, "c", "s", 0.5, 0.25, 3, 9) for x in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    r = np.random.default_rng(3)
    where = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(120)] + [(3, 0, 1), (None, 1, 1), (7, None, None), (999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    vectors = [(i, [float(x) for x in v], 1) for i, v in enumerate(r.normal(size=(400, 6)))] + [(400, None, 0), (401, [None] * 6, 0), (402, [float("nan")] * 6, 0), (403, [0.0] * 6, 0), (100, [1.0] * 6, 0), (None, [1.0] * 6, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    return where


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    return where


COLUMNS = {
    "op1_ngram_jaccard": ["doc_id", "n_shingles", "component_id"], "op2_topk": ["query_id", "rank", "vec_id", "score"], "op3_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op4_quality": ["doc_id", "held_out", "score", "predicted"], "op5_token_counts": ["doc_id"], "op6_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op7_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"], "op9_ann": ["query_id", "rank", "vec_id", "score"], "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, empty, rows, name):
    out = registry.QUERIES[name](spark, folder)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name]
    got = out.collect()
    if name not in ("op2_topk", "op3_packing", "op9_ann"):
        assert Counter(r.doc_id for r in got) == Counter(x[0] for x in rows)
    if name in ("op4_quality", "op8_toxicity"):
        folds, held_out = (4, 2) if name == "op4_quality" else (3, 1)
        for r in got:
            assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % folds == held_out)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    if name == "op7_token_files":
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
        own = Counter((x[0], zlib.crc32(np.array(tokenizer.encode(x[1] or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for x in rows)
        assert Counter((r.doc_id, r.ids_crc32) for r in got) == own
        assert [r.start for r in sorted(got, key=lambda r: r.start)] == np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()
    if name == "op10_mixing":
        assert all(r.taken <= 3 * r.size for r in got)
    assert registry.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("at", range(5))
def test_stage(spark, folder, empty, rows, at, tmp_path):
    name, stage = P.STAGES[at]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    got = out.collect()
    if name != "packing":
        assert out.columns == docs.columns and all(r.size == 7 and r.copies == "c" and r.n == 9 for r in got)
        have = Counter(map(tuple, rows))
        assert all(n <= (3 if name == "mixing" else 1) * have[x] for x, n in Counter(map(tuple, got)).items())
    if name == "near_duplicates":
        texts = [r.text for r in got if r.doc_id is not None and r.text]
        assert len(texts) == len(set(texts)) and {r.doc_id for r in got} >= {None, 3, 500, 501, 502}
    none = spark.read.parquet(f"{empty}/documents.parquet")
    assert stage(spark, none, empty).count() == 0
    if name in ("toxicity", "quality"):
        assert stage(spark, docs, empty).count() == len(rows)


def test_run_is_the_stages(spark, folder):
    pieces = P.run(spark, folder)
    assert pieces.columns == COLUMNS["op3_packing"] and pieces.count() > 0
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_loss_limit_binds(spark):
    rows = [(i, "word " * (20 + i % 50), i % 3 != 0) for i in range(300)] + [(900, "word " * 900, True), (901, "word " * 900, False), (902, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer boolean").coalesce(1)
    limits = packing.Limits(512, 16, 100)
    bears = {i: b for i, _, b in rows}
    loss, size, segments, seen = Counter(), Counter(), Counter(), Counter()
    for p in packing.pack_documents(docs, tokens.vocabulary_path(), limits, loss="answer").collect():
        loss[p.sequence_id] += p.length if bears[p.doc_id] else 0
        size[p.sequence_id] += p.length
        segments[p.sequence_id] += 1
        seen[p.doc_id] += p.length
        assert p.doc_tokens >= p.start + p.length
    assert max(loss.values()) <= 100 and max(size.values()) <= 512 and max(segments.values()) <= 16
    assert set(seen) == set(bears) and seen[902] == 1


def test_learner_against_plain_updates():
    """The same updates, written out one weight at a time."""
    r = random.Random(4)
    rows = [(float(r.random() < 0.4), sorted(r.sample(range(1, 30), 5))) for _ in range(200)]
    model = linear.Ftrl(30, 0.5, 1.0, 0.02, 0.1)
    z, n = [0.0] * 30, [0.0] * 30

    def weight(i):
        l1 = 0.0 if i == 0 else 0.02
        return 0.0 if abs(z[i]) <= l1 and i else -(z[i] - (l1 if z[i] > 0 else -l1 if z[i] < 0 else 0.0)) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.1)

    for y, at in rows:
        at = [0, *at]
        model.learn(np.array(at), np.ones(len(at)), y)
        p = 1 / (1 + np.exp(-sum(weight(i) for i in at)))
        for i in at:
            w, g = weight(i), p - y
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w
            n[i] += g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(30)])


def test_quality_features_against_plain_counts():
    import pyarrow as pa

    text = "One two, two one! ééé 12 一二"
    ((index, value, begin),) = quality.features(pa.array([text, None, ""]))
    assert begin.tolist()[1:] == [begin[1]] * 3 and len(index) == begin[-1] and (value >= 0).all()
    assert sum(value[: begin[1] : 3]) == pytest.approx(quality.SCALE)


def test_toxicity_settings_use_no_held_out_label():
    assert toxicity.FOLDS == 3 and toxicity.HELD_OUT == 1
