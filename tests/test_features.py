"""Bag of words, TF-IDF, phrases: golden rows and brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import text as T
from reviewlens.operators import features as FT
from reviewlens.operators import text_ops as X


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_tfidf_golden(spark):
    d = docs(spark, [(1, "ab cd ab x"), (2, "CD ef")])
    dt = FT.bow(d, "doc_id", "text")
    out = {(r[0], r[1]): round(r[2], 6) for r in FT.tfidf(dt, F.lit(2)).collect()}
    assert out == {(1, "ab"): 0.942156, (1, "cd"): 0.335176, (2, "cd"): 0.579739, (2, "ef"): 0.814802}


def test_tfidf_rows_have_unit_norm(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(rnd.randint(1, 30))))
            for i in range(60)]
    dt = FT.bow(docs(spark, rows), "doc_id", "text")
    norms = FT.tfidf(dt, F.lit(60)).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r["n"] - 1.0) < 1e-9 for r in norms)


def test_vocabulary_dense_index(spark):
    d = docs(spark, [(1, "bb aa"), (2, "cc aa"), (3, "dd")])
    v = sorted((r["idx"], r["term"]) for r in FT.vocabulary(FT.bow(d, "doc_id", "text")).collect())
    assert v == [(0, "aa"), (1, "bb"), (2, "cc"), (3, "dd")]


def test_gamma_scale_matches_numpy_variance(spark):
    d = docs(spark, [(1, "aa aa bb"), (2, "bb cc"), (3, "dd")])
    g = FT.gamma_scale(FT.bow(d, "doc_id", "text"), F.lit(3)).first()
    cells = [2, 1, 0, 0, 0, 1, 1, 0, 0, 0, 0, 1]
    mean = sum(cells) / 12
    var = sum((c - mean) ** 2 for c in cells) / 12
    assert abs(g["variance"] - var) < 1e-12
    assert abs(g["gamma"] - 1 / (4 * var)) < 1e-9


def brute_phrases(token_lists, min_count=5, threshold=10.0):
    uni, bi = Counter(), Counter()
    for t in token_lists:
        uni.update(t)
        bi.update(zip(t, t[1:]))
    n = len(uni) + len(bi)
    out = {}
    for (a, b), c in bi.items():
        score = (c - min_count) * n / (uni[a] * uni[b])
        if score > threshold:
            out[f"{a} {b}"] = score
    return out


def test_phrase_scores_and_merge_match_brute_force(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    lists = []
    for _ in range(300):
        t = [rnd.choice(words) for _ in range(rnd.randint(0, 15))]
        if rnd.random() < 0.3:
            t[0:0] = ["new", "york"]
        lists.append(t)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "doc_id bigint, tokens array<string>")
    ph = FT.phrase_scores(df, "tokens")
    got = {r["phrase"]: r["score"] for r in ph.collect()}
    want = brute_phrases(lists)
    assert set(got) == set(want) and "new york" in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    merged = {r[0]: r[1] for r in X.merge_phrases(df, "tokens", ph, "doc_id").collect()}
    from tests.test_text_functions import greedy
    for i, t in enumerate(lists):
        assert merged[i] == greedy(t, set(want)), t


def test_mean_pool(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 6.0]), (1, [5.0, 5.0])], "g int, v array<float>")
    out = {(r[0], r[1]): r[2] for r in FT.mean_pool(df, "g", "v").collect()}
    assert out == {(0, 0): 2.0, (0, 1): 4.0, (1, 0): 5.0, (1, 1): 5.0}


def test_bow_fixed_terms_keeps_every_document(spark):
    d = docs(spark, [(1, "the cat the"), (2, "nothing here")])
    rows = sorted(FT.bow_fixed_terms(d, "doc_id", "text", ["the", "cat"]).collect())
    assert [tuple(r) for r in rows] == [(1, 2, 1), (2, 0, 0)]


def test_clean_reviews_pipeline(spark):
    df = spark.createDataFrame(
        [(1, "五星好評送小菜！的 好吃😀", 5.0), (2, "打卡送飲料 由 Google 提供翻譯", 5.0), (3, None, 5.0),
         (4, "ABC", 4.0), (5, "打卡送 好喝", 4.0)], "id int, text string, rating double")
    out = X.clean_reviews(df, text_col="text", rating_col="rating", stopwords=["的"],
                          tokenizer="whitespace").orderBy("id").collect()
    assert [(r["id"], r["processed"], r["is_inducing"]) for r in out] == [
        (1, "五星好評送小菜的好吃", 1), (5, "打卡送好喝", 0)]


def test_doc_terms_counts(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "doc_id int, t array<string>")
    got = sorted(tuple(r) for r in FT.doc_terms(df, "doc_id", F.col("t")).collect())
    assert got == [(1, "a", 1), (1, "b", 2)]


def test_idf_formula():
    assert abs(math.log(3 / 2) + 1 - 1.4054651081081644) < 1e-12


def test_tokenize_word_matches_python_regex(spark):
    import re
    text = "Über-große Äpfel, l'été 2024 _x_ a b9"
    want = re.findall(r"(?u)\b\w\w+\b", text.lower())
    got = docs(spark, [(1, text)]).select(T.tokenize_word("text")).first()[0]
    assert got == want


def test_similar_topk_inline_and_blocks_agree_with_brute_force(spark):
    import numpy as np
    from reviewlens.operators.similarity import similar_topk
    rnd = np.random.default_rng(4)
    vecs = rnd.normal(size=(120, 8))
    rows = [(f"w{i}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "word string, vector array<double>")
    seeds = df.filter(F.col("word").isin("w1", "w7", "w50")).withColumnRenamed("word", "seed")
    want = {}
    for s in ("w1", "w7", "w50"):
        a = vecs[int(s[1:])]
        sims = [(round(float(a @ v / (np.linalg.norm(a) * np.linalg.norm(v))), 6), f"w{j}")
                for j, v in enumerate(vecs) if f"w{j}" != s]
        want[s] = [w for _, w in sorted(sims, key=lambda t: (-t[0], t[1]))[:5]]
    for inline in (256, 0):
        got = {}
        for r in similar_topk(df, seeds, 5, inline=inline).orderBy("seed", "rank").collect():
            got.setdefault(r["seed"], []).append(r["neighbor"])
        assert got == want, method


def test_clean_review_table_on_raw_schema(spark):
    import datetime
    from reviewlens.schema import RAW_REVIEWS
    ts = datetime.datetime(2024, 3, 1, 10, 5, 0)
    raw = spark.createDataFrame([
        (ts, "店A", "N", "小明", "", 5.0, "2 週前", "五星好評送小菜 😀 好吃"),
        (ts, "店A", "Y", "小華", "在地嚮導", 5.0, "3 天前", "由 Google 提供翻譯 good"),
        (ts, "店B", "N", "阿強", "", 4.0, "剛剛", None),
        (ts, "店B", "N", "阿美", "", 3.0, "1 年前", "更多"),
    ], RAW_REVIEWS)
    out = X.clean_review_table(raw, drop_token="更多", with_restaurant=True).collect()   # the default segments
    assert [tuple(r) for r in out] == [("店A", "2024/02/16 10:05", "小明", 5.0, "五星 星好 好評 評送 送小 小菜 菜好 好吃", 1)]
    out = X.clean_review_table(raw, drop_token="更多", with_restaurant=True, tokenizer="whitespace").collect()
    assert [tuple(r) for r in out] == [("店A", "2024/02/16 10:05", "小明", 5.0, "五星好評送小菜好吃", 1)]
    assert out[0].asDict().keys() == {"RestName", "ReviewActualDate", "Reviewer", "ReviewRating",
                                      "ProcessedReview", "IsInducing"}


def test_ppmi_neighbors_match_brute_force(spark):
    import math
    from collections import Counter
    from reviewlens.operators import cooccurrence as CO
    rnd = random.Random(2)
    lists = [[rnd.choice("abcdefg") for _ in range(rnd.randint(0, 9))] for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in lists], "tokens array<string>")
    got = {(r.seed, r.neighbor): r.similarity
           for r in CO.ppmi_neighbors(CO.ppmi(CO.cooccurrence_counts(df, "tokens", 2)), ["a"], 3).collect()}
    cnt = Counter()
    for t in lists:
        for i in range(len(t)):
            for d in (1, 2):
                if i + d < len(t):
                    cnt[(t[i], t[i + d])] += 1
                    cnt[(t[i + d], t[i])] += 1
    total = sum(cnt.values())
    marg = Counter()
    for (w, _), n in cnt.items():
        marg[w] += n
    vec = {}
    for (w, c), n in cnt.items():
        v = math.log(n * total / (marg[w] * marg[c]))
        if v > 0:
            vec.setdefault(w, {})[c] = v
    def cos(x, y):
        a, b = vec.get(x, {}), vec.get(y, {})
        dot = sum(a[k] * b[k] for k in a if k in b)
        return dot / (math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values())))
    sims = sorted(((round(cos("a", w), 6), w) for w in vec if w != "a" and any(k in vec["a"] for k in vec[w])),
                  key=lambda t: (-t[0], t[1]))[:3]
    assert got == {("a", w): s for s, w in sims}


@pytest.mark.parametrize("more", [0, 3000])
def test_remove_stopwords_is_one_path(spark, more):
    big = [f"zz{i}" for i in range(more)] + ["b", "d", None]
    stop = spark.createDataFrame([(w,) for w in big], "word string")
    rows = [(1, ["a", "b", "a", "c", "d", "b"]), (2, ["b", "d"]), (3, []), (4, None), (5, ["a", None, "b"]),
            (5, ["c"])]
    df = spark.createDataFrame(rows, "doc_id int, t array<string>")
    got = sorted(((r.doc_id, r.t) for r in X.remove_stopwords(df, "t", stop).collect()), key=str)
    assert got == sorted([(1, ["a", "a", "c"]), (2, []), (3, []), (4, None), (5, ["a"]), (5, ["c"])], key=str)


def test_merge_at_matches_greedy(spark):
    from tests.test_text_functions import greedy
    rnd = random.Random(21)
    phrases = {"a b", "b b", "c a"}
    rows = [[rnd.choice("abc") for _ in range(rnd.randint(0, 10))] for _ in range(150)]
    hits = [[i for i in range(len(t) - 1) if f"{t[i]} {t[i + 1]}" in phrases] for t in rows]
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(rows, hits))],
                               "id int, t array<string>, h array<int>")
    got = {r.id: r.m for r in df.select("id", T.merge_at("t", "h").alias("m")).collect()}
    for i, t in enumerate(rows):
        assert got[i] == greedy(t, phrases)


def test_cooccurrence_min_count_drops_rare_words_first(spark):
    from collections import Counter
    from reviewlens.operators import cooccurrence as CO
    lists = [["a", "x", "b", "a"], ["b", "y", "a"], ["a", "b"], []]
    df = spark.createDataFrame([(t,) for t in lists], "tokens array<string>")
    got = {(r.w, r.c): r.n for r in CO.cooccurrence_counts(df, "tokens", 1, min_count=2).collect()}
    freq = Counter(w for t in lists for w in t)
    want = Counter()
    for t in lists:
        t = [w for w in t if freq[w] >= 2]
        for i in range(len(t) - 1):
            want[(t[i], t[i + 1])] += 1
            want[(t[i + 1], t[i])] += 1
    assert got == dict(want)


def test_sorted_neighbours_order(spark):
    from reviewlens.operators.similarity import sorted_neighbours
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("seed", None), ("c", 0.9), ("also", None)],
                               "feature string, similarity double").repartition(3)
    assert [r.feature for r in sorted_neighbours(df).collect()] == ["c", "a", "b", "also", "seed"]
