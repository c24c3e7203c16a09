"""Skew-safe ordering helpers, splits and metrics against brute force."""

import math
import random

from pyspark.sql import functions as F

from reviewlens.operators import metrics as M
from reviewlens.operators import ordering as O
from reviewlens.operators import split as SP


def skewed(spark, n=3000):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rnd.randint(0, 40)}"
        rows.append((i, g, rnd.randint(0, 50)))
    return rows, spark.createDataFrame(rows, "id bigint, g string, v int")


def test_ordinal_in_group_with_hot_group(spark):
    rows, df = skewed(spark)
    got = {r["id"]: r["ordinal"] for r in O.ordinal_in_group(df.repartition(7), ["g"], ["v", "id"]).collect()}
    want = {}
    by = {}
    for i, g, v in rows:
        by.setdefault(g, []).append((v, i))
    for g, lst in by.items():
        for k, (_, i) in enumerate(sorted(lst), 1):
            want[i] = k
    assert got == want


def test_top_k_per_group(spark):
    rows, df = skewed(spark)
    got = sorted((r["g"], r["id"]) for r in O.top_k_per_group(df, "g", [F.col("v").desc(), "id"], 3).collect())
    by = {}
    for i, g, v in rows:
        by.setdefault(g, []).append((-v, i))
    want = sorted((g, i) for g, lst in by.items() for _, i in sorted(lst)[:3])
    assert got == want


def test_dense_index_and_running_totals(spark):
    rows, df = skewed(spark, 500)
    got = sorted((r["idx"], r["id"]) for r in O.dense_index(df.repartition(5), ["v", "id"]).collect())
    assert [i for _, i in got] == [i for _, i in sorted((v, i) for i, _, v in rows)]
    assert [k for k, _ in got] == list(range(500))
    rt = O.running_totals(df, ["id"], {"cum": F.col("v")}).orderBy("id").collect()
    acc = 0
    for r, (_, _, v) in zip(rt, sorted(rows)):
        acc += v
        assert r["cum"] == acc


def test_classification_metrics_golden(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    m = M.classification_metrics(spark.createDataFrame(rows, "label int, prediction int")).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (3, 1, 2, 4)
    assert round(m.accuracy, 6) == 0.7 and round(m.precision, 6) == 0.75 and round(m.recall, 6) == 0.6
    assert round(m.f1, 6) == 0.666667 and round(m.roc_auc, 6) == 0.7 and round(m.avg_precision, 6) == 0.65
    none = M.classification_metrics(spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")).first()
    assert none.precision == 0.0 and none.avg_precision == 0.5


def test_score_auc_matches_pairwise(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 20))) for _ in range(400)]
    got = M.score_auc(spark.createDataFrame(rows, "label int, score double")).first()
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(got.roc_auc - auc) < 1e-12
    # step-wise average precision over descending distinct thresholds
    ap, tp, fp = 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        p_here = sum(1 for y, t in rows if t == s and y == 1)
        n_here = sum(1 for y, t in rows if t == s and y == 0)
        tp += p_here
        fp += n_here
        ap += p_here / len(pos) * tp / (tp + fp)
    assert abs(got.avg_precision - ap) < 1e-12


def test_exact_split_size_disjoint_and_stable(spark):
    df = spark.range(0, 997).withColumnRenamed("id", "doc_id")
    a = {r[0]: r[1] for r in SP.exact_split(df, "doc_id").collect()}
    b = {r[0]: r[1] for r in SP.exact_split(df.repartition(13), "doc_id").collect()}
    assert a == b and sum(a.values()) == math.ceil(0.2 * 997) and len(a) == 997


def test_hash_split_and_three_way(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "doc_id")
    share = SP.hash_split(df, "doc_id").agg(F.avg("is_test")).first()[0]
    assert 0.15 < share < 0.25
    parts = {r[0]: r[1] for r in SP.three_way_split(df, "doc_id").groupBy("part").count().collect()}
    assert set(parts) == {"train", "validation", "test"} and sum(parts.values()) == 2000


def test_stratified_folds_balance(spark):
    rows = [(i, 1 if i % 10 == 0 else 0) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, label int")
    f = SP.stratified_folds(df, "doc_id", "label", 5)
    counts = {(r[0], r[1]): r[2] for r in f.groupBy("fold", "label").count().collect()}
    assert all(counts[(k, 1)] == 10 for k in range(5))
    assert all(counts[(k, 0)] == 90 for k in range(5))


def test_term_log_odds(spark):
    dt = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bb")], "doc_id int, term string")
    lab = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id int, label int")
    out = {r["term"]: r for r in M.term_log_odds(dt, lab).collect()}
    assert out["aa"]["docs_pos"] == 1 and out["aa"]["docs_neg"] == 1
    want = math.log(1.5 / 0.5) - math.log(1.5 / 1.5)
    assert abs(out["aa"]["log_odds"] - want) < 1e-12
