"""Inputs the test tables lack: one class, zero vectors, null keys, ties, missing shared folder."""

import pytest
from pyspark.sql import functions as F

from reviewlens import session
from reviewlens.operators import features as FT
from reviewlens.operators import metrics as M
from reviewlens.operators import model as MD
from reviewlens.operators import ordering as O
from reviewlens.operators import similarity as S
from reviewlens.operators import split as SP


@pytest.mark.parametrize("label", [0, 1])
def test_score_auc_with_one_class(spark, label):
    df = spark.createDataFrame([(label, 0.1), (label, 0.4), (label, 0.4)], "label int, score double")
    r = M.score_auc(df).first()
    assert r.roc_auc is None and (r.positives, r.negatives) == ((3, 0) if label else (0, 3))
    assert r.avg_precision == (1.0 if label else None)
    r = M.score_auc(df.limit(0)).first()
    assert r.roc_auc is None and (r.positives, r.negatives) == (0, 0)


def test_similar_topk_with_zero_vector(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("zero", [0.0, 0.0])],
                                 "word string, vector array<double>")
    seeds = vecs.select(F.col("word").alias("seed"), "vector")
    got = {m: sorted((r.seed, r.neighbor) for r in S.similar_topk(vecs, seeds, 5, inline=m).collect())
           for m in (256, 0)}
    assert got[256] == got[0] == [("a", "b"), ("b", "a")]


def test_gamma_without_variance(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 2)], "doc_id int, term string, tf int")
    assert FT.gamma_scale(df, F.lit(2)).first().gamma is None


def test_exact_split_with_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None,)] * 4 + [(i,) for i in range(20)] + [(3,)] * 30, "k int")
    rows = SP.exact_split(df, "k").collect()
    assert len(rows) == 54 and all(r.is_test == 0 for r in rows if r.k is None)
    sides = {}
    for r in rows:
        sides.setdefault(r.k, set()).add(r.is_test)
    assert all(len(s) == 1 for s in sides.values())


def test_first_in_group_breaks_ties(spark):
    rows = [(1, 5, "b", 2), (1, 5, "a", 9), (1, 7, "0", 0), (2, None, "z", 1)]
    df = spark.createDataFrame(rows, "g int, o int, v string, w int")
    for d in (df, df.orderBy(F.desc("v")), df.repartition(3)):
        got = sorted((r.g, r.v, r.w) for r in O.first_in_group(d, "g", "o", ["v", "w"]).collect())
        assert got == [(1, "a", 9), (2, "z", 1)]


def test_random_features_keep_rows_without_terms(spark):
    df = spark.createDataFrame([(1, [("a", 1.0), ("b", 2.0)]), (2, []), (3, None)],
                               "doc_id int, terms array<struct<term:string,weight:double>>")
    got = {r.doc_id: list(r.features) for r in MD.rff_features(df, 0.5, dims=8).collect()}
    assert len(got) == 3 and got[2] == got[3] != got[1] and len(got[1]) == 8


def test_shared_folder_is_needed_off_local():
    session._local_only("local[4]")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "remote"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session._local_only(master)


def test_feature_vocabulary_is_whole(spark):
    df = spark.createDataFrame([(i, [f"w{i}_{j}" for j in range(50)]) for i in range(40)],
                               "doc_id int, tokens array<string>")
    assert len([r.idx for r in MD.vocabulary_frame(MD.fit_features(df, kind="bow")).collect()]) == 2000
