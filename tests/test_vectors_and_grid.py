"""The distributed vectoriser and the nested grid search against plain code."""

import math
import random
from collections import Counter

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from reviewlens.operators import model as MD
from reviewlens.operators.nested_forest import nested_accuracy, trees_of


def rows(seed=4, n=120):
    rng = random.Random(seed)
    words = [f"w{i:02}" for i in range(30)]
    out = []
    for i in range(n):
        tokens = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        noisy = rng.random() < 0.15
        out.append((i, tokens, float(("w03" in tokens) ^ ("w07" in tokens) ^ noisy), i % 3))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, tokens array<string>, label double, fold int").withColumn(
        "row", F.lit("own"))


@pytest.mark.parametrize("kind", ["bow", "tfidf"])
def test_vectors_equal_the_definition(spark, kind):
    data = rows() + [(500, None, 0.0, 0), (501, [None, "w01"], 1.0, 1)]
    train, test = data[:80], data[40:] + [(502, ["unseen", "w02"], 0.0, 2)]
    feats = MD.fit_features(frame(spark, train), kind=kind)
    df = Counter(t for _, ts, *_ in train for t in set(ts or []))
    vocab = sorted(df)
    assert [(r.term, r.idx) for r in feats.terms.orderBy("idx").collect()] == [(t, i) for i, t in enumerate(vocab)]
    for id_col in ("doc_id", None):
        got = feats.transform(frame(spark, test), id_col)
        assert got.columns == ["doc_id", "tokens", "label", "fold", "row", "features"]
        got = {r.doc_id: r.features for r in got.collect()}
        assert len(got) == len(test)
        for i, ts, *_ in test:
            n = Counter(t for t in ts or [] if t in df)
            w = [n[t] * (math.log((1 + len(train)) / (1 + df[t])) + 1 if kind == "tfidf" else 1) for t in vocab]
            length = math.sqrt(sum(x * x for x in w)) if kind == "tfidf" else 1.0
            assert got[i].size == len(vocab)
            assert list(got[i].toArray()) == pytest.approx([x / length if length else 0.0 for x in w])


def test_vocabulary_limits_and_empty(spark):
    data = [(1, ["a", "a", "b"], 0.0, 0), (2, ["b", "c"], 1.0, 1)]
    names = lambda **kw: [r.term for r in MD.fit_features(frame(spark, data), **kw).terms.orderBy("idx").collect()]
    assert names(vocab_size=2) == ["a", "b"] and names(min_df=2) == ["b"] and names() == ["a", "b", "c"]
    none = MD.fit_features(frame(spark, []))
    assert none.size == 0
    assert [r.features.size for r in none.transform(frame(spark, data), "doc_id").collect()] == [1, 1]


PLAIN = dict(featureSubsetStrategy="all", bootstrap=False)      # trees then depend on the rows alone
GRID = {"n_estimators": (1, 3), "max_depth": (1, 2, 4, None), "min_samples_split": (2, 8), "min_samples_leaf": (1, 3)}


def test_grid_equals_the_cross_validator(spark):
    data = frame(spark, rows())
    found, feats = MD.rf_grid_search(data, GRID, folds=3, id_col="doc_id", **PLAIN)
    rf = RandomForestClassifier(impurity="gini", seed=42, **PLAIN)
    maps = [{rf.numTrees: p["num_trees"], rf.maxDepth: p["max_depth"], rf.minInstancesPerNode: p["min_instances"]}
            for p in found.points]
    cv = CrossValidator(estimator=rf, estimatorParamMaps=maps, numFolds=3, foldCol="fold", parallelism=4,
                        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"))
    want = cv.fit(feats.transform(data, "doc_id"))
    assert found.accuracy == pytest.approx(list(want.avgMetrics))
    assert len(set(found.accuracy)) > 3
    assert found.best == found.points[max(range(len(maps)), key=lambda i: want.avgMetrics[i])]
    assert found.bestModel.getNumTrees == found.best["num_trees"]


def test_sampled_forest_scores_as_spark_does(spark):
    """The whole of a bagged forest: votes and accuracy equal those of its own transform."""
    data = frame(spark, rows(9, 200))
    x = MD.fit_features(data).transform(data, "doc_id")
    model = RandomForestClassifier(numTrees=25, maxDepth=8, seed=3).fit(x.filter("fold < 2"))
    held = x.filter("fold = 2")
    want = model.transform(held).select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert nested_accuracy(model, held, [25], [8])[25, 8] == pytest.approx(want)
    trees, _ = trees_of(model, spark)
    assert len(trees) == 25 and all((t.leaves(8) == (t.left < 0)).all() for t in trees)
