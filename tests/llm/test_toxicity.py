import random
import zlib

import numpy as np
import pytest
from corpora import ODD, frame
from reviewlens.llm import toxicity
from reviewlens.llm.toxicity import Ftrl, toxicity_scores, train

RNG = random.Random(4)
VOCAB = ["".join(RNG.choice("abcdefghijkl") for _ in range(6)) for _ in range(600)]
BAD = ["dolt", "fool", "Oaf,"]


def labelled(n=900):
    rows, labels = [], []
    for i in range(n):
        toxic = RNG.random() < 0.25
        w = [RNG.choice(VOCAB) for _ in range(RNG.randint(5, 120))]
        for _ in range(3 * toxic):
            w.insert(RNG.randrange(len(w)), RNG.choice(BAD))
        rows.append((i, " ".join(w), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = labelled()
    labels += [(None, 1, 1), (3, 1, None), (900, 1, 0), (5000, 1, 1)]
    return (frame(spark, rows + ODD), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels[:900]))


@pytest.fixture(scope="module")
def scored(tables):
    return toxicity_scores(*tables[:2]).collect()


def test_held_out_accuracy(scored, tables):
    truth = tables[2]
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_contract(scored):
    assert len(scored) == 900 + len(ODD)
    for r in scored:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    blank = {r.score for r in scored if r.doc_id in (900, 901, 902)}
    assert len(blank) == 1


def test_weights_are_sparse_and_labels_of_held_out_rows_do_not_matter(tables, spark, scored):
    docs, labels, truth = tables
    slots, weights = train(docs, labels)
    assert 0 < len(slots) < 5000 and (weights != 0).all()
    flipped = labels.withColumn("toxic", labels.toxic).rdd.map(
        lambda r: (r.doc_id, 1, 1 - r.toxic if r.doc_id is not None and r.toxic is not None
                   and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.toxic))
    again = toxicity_scores(docs, spark.createDataFrame(
        flipped, "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.doc_id or -1, r.score) for r in again) == sorted(
        (r.doc_id or -1, r.score) for r in scored)


def test_update_matches_plain_ftrl():
    model, z, n = Ftrl(), {}, {}
    rng = np.random.default_rng(0)
    for _ in range(60):
        at, y = np.unique(rng.integers(0, 12, 5)), float(rng.integers(0, 2))
        w = {}
        for i in at:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= toxicity.L1 else -(zi - np.sign(zi) * toxicity.L1) / (
                (toxicity.BETA + ni ** 0.5) / toxicity.ALPHA + toxicity.L2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
            z[i] = z.get(i, 0.0) + g - s * w[i]
            n[i] = n.get(i, 0.0) + g * g
        model.learn(at, y)
    for i in z:
        assert model.z[i] == pytest.approx(z[i]) and model.n[i] == pytest.approx(n[i])


def test_no_labels_and_empty(tables, empty):
    docs, labels, _ = tables
    none = toxicity_scores(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity_scores(empty, labels).collect() == []


def test_sample_bound(tables):
    docs, labels, _ = tables
    assert train(docs, labels, sample_rows=40) is not None


def test_features_of_short_slices(monkeypatch):
    import pyarrow as pa
    real, sizes = toxicity.features, []

    def seen(part):
        sizes.append(part.column("text").nbytes)
        return real(part)
    monkeypatch.setattr(toxicity, "features", seen)
    text = " ".join(VOCAB) * 5
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(200), pa.int64()), pa.array([0.0] * 200), pa.array([text] * 200)], ["key", "toxic", "text"])
    out = pa.Table.from_batches(list(toxicity._feature_rows(iter([batch]))))
    assert out.num_rows == 200 and len(set(out.column("slots").to_pylist())) == 1
    assert max(sizes) < (1 << 20) + 2 * len(text) and len(sizes) > 3


def test_training_reads_short_batches(spark, monkeypatch):
    """Texts of the sample reach a worker a thousand rows at a time, not ten thousand."""
    real = toxicity._feature_rows

    def checked(batches):
        def short():
            for b in batches:
                assert b.num_rows <= 1000, b.num_rows
                yield b
        yield from real(short())
    monkeypatch.setattr(toxicity, "_feature_rows", checked)
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat('w', id % 7, ' x') AS text").coalesce(1)
    labels = spark.range(2500).selectExpr("id AS doc_id", "cast(id % 7 = 0 AS int) AS toxic")
    slots, weights = train(docs, labels)
    assert len(slots) == len(weights) > 0 and (weights != 0).all()
