"""Trees over sparse rows against those of pyspark.ml, which holds every feature of every row."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.sql import functions as F

from reviewlens.operators import model as MD
from reviewlens.operators import sparse_trees as ST
from reviewlens.operators.sparse_trees import Points


def vectors(spark, kind, n=160, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        tokens = [f"w{min(rng.randrange(40), rng.randrange(40)):02}" for _ in range(rng.randint(0, 30))]
        rows.append((i, tokens, float((("w03" in tokens) ^ ("w07" in tokens)) or rng.random() < 0.15)))
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>, label double")
    return MD.fit_features(df.filter("doc_id < 110"), kind=kind).transform(df, "doc_id")


def scores(model, rows):
    out = model.transform(rows).select("doc_id", "prediction", "probability").collect()
    return {r.doc_id: (r.prediction, *r.probability.toArray()) for r in out}


@pytest.mark.parametrize("kind", ["bow", "tfidf"])
def test_trees_equal_those_over_every_feature(spark, kind):
    data = vectors(spark, kind)
    train = data.filter("doc_id < 110")
    for mine, plain in ((MD.learner("tree", 0, max_depth=12), DecisionTreeClassifier(maxDepth=12, seed=42)),
                        (MD.learner("gbt", 0, max_iter=3, max_depth=3), GBTClassifier(maxIter=3, maxDepth=3, seed=42))):
        got, want = mine.fit(train), plain.fit(train)
        found, asked = scores(got, data), scores(want, data)
        assert found.keys() == asked.keys()
        for i in asked if got.kind == "tree" else range(110):     # boosted trees may tie but for rounding
            assert found[i] == pytest.approx(asked[i]), i
        if got.kind == "tree":
            assert list(got.featureImportances.toArray()) == pytest.approx(list(want.featureImportances.toArray()))


def test_rows_hold_their_cells_alone(spark):
    """A wide vocabulary costs nothing: pyspark.ml holds rows times features."""
    from pyspark.ml.linalg import Vectors
    rows = [(i, Vectors.sparse(50_000_000, {i: 1.0, 49_999_999 - i % 2: 2.0}), float(i % 2)) for i in range(40)]
    data = spark.createDataFrame(rows, ["doc_id", "features", "label"])
    points = Points(data)
    assert points.table.agg(F.sum(F.size("idx"))).first()[0] == 80
    for kind in ("tree", "gbt"):
        model = MD.learner(kind, 0, max_iter=2).fit(data)
        assert {r.label == r.prediction for r in model.transform(data).collect()} == {True}


def test_bad_labels_raise(spark):
    data = vectors(spark, "bow", 20)
    for bad in (F.lit(None).cast("double"), F.lit(0.5), F.lit(-1.0)):
        with pytest.raises(ValueError):
            MD.learner("tree", 0).fit(data.withColumn("label", bad))
    with pytest.raises(ValueError):
        MD.learner("rf", 0).fit(data.limit(0))


def test_whole_trees_in_a_task_are_those_grown_level_by_level(spark, monkeypatch):
    data = vectors(spark, "tfidf", 400, 6).filter("doc_id < 300")
    points = Points(data)
    for depth, leaf in ((30, 1), (4, 3)):
        learner = MD.learner("rf", 0, num_trees=9, max_depth=depth, min_instances=leaf)
        monkeypatch.setattr(ST, "HERE", 1 << 24)
        monkeypatch.setattr(ST, "STEP", 50)
        with monkeypatch.context() as m:
            m.setattr(ST, "grow", None)                  # no pass a level
            here = learner.fit(data, points)
        monkeypatch.setattr(ST, "HERE", 0)
        levels = learner.fit(data, points)
        a, b = here.nodes(), levels.nodes()
        assert len(a) == len(b) > 9
        for c in ("tree", "id", "left", "right", "feature"):
            assert (a[c] == b[c]).all(), c
        inner = a["feature"] >= 0
        assert (a["threshold"] == b["threshold"])[inner].all()
        assert (np.stack(list(a["stats"])) == np.stack(list(b["stats"]))).all()
        assert list(here.featureImportances.toArray()) == list(levels.featureImportances.toArray())
        assert scores(here, data) == scores(levels, data)
