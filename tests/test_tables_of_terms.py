"""Feature, stop-word and phrase tables of any size, and native folding, against plain Python."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import fold
from reviewlens.operators import feature_index as FI
from reviewlens.operators import label as L
from reviewlens.operators import text_ops as X
from reviewlens.session import counted_broadcast


def texts(seed=2, n=150):
    rng = random.Random(seed)
    parts = ["the", "gift", "free", "打卡", "送", "\U0001F600", "a", "über", "s_t"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), float(rng.randint(3, 6)))
            for i in range(n)]
    return rows + [(n, None, 5.0), (n + 1, "", 5.0), (n + 2, "gift free", None), (n + 3, "x" * 60000 + "gift", 5.0)]


FEATURES = ["gift free", "打卡 送", "送", "\U0001F600 a", "zzz", "", None, "r_s_t", "über", "xgift", "gift free"] + [
    f"never{i}" for i in range(3000)]


@pytest.mark.parametrize("bound, id_col", [(1 << 18, None), (0, "id")])
def test_feature_table_equals_contains(spark, monkeypatch, bound, id_col):
    monkeypatch.setattr(counted_broadcast, "__defaults__", (bound,))
    df = spark.createDataFrame(texts(), "id long, text string, rating double").withColumn("row", F.lit("own"))
    feats = spark.createDataFrame([(f,) for f in FEATURES], "f string")
    for delimiter in (None, "_"):
        got = L.feature_label(df, text_col="text", rating_col="rating", features=feats,
                              delimiter_as_space=delimiter, id_col=id_col)
        assert got.columns == ["id", "text", "rating", "row", "is_inducing"]
        want = [f.replace("_", " ") if delimiter else f for f in FEATURES if f]
        assert {r.id: r.is_inducing for r in got.collect()} == {
            i: int(rating == 5 and text is not None and any(f in text for f in want))
            for i, text, rating in texts()}


def test_many_features_stay_a_table(spark):
    """10^5 features: looked up by their rarest gram, none collected."""
    feats = spark.range(100000).select(F.concat(F.lit("word"), F.hex("id")).alias("feature"))
    rows = spark.createDataFrame([(1, "a word1869F b"), (2, "a word18 6A0"), (3, "wordG"), (4, "WORD1")],
                                 "row long, text string")
    assert {r.row for r in FI.rows_with_features(rows, feats).collect()} == {1, 2}
    assert FI.rows_with_features(rows, feats.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [1 << 18, 0])
def test_stop_word_table(spark, monkeypatch, bound):
    monkeypatch.setattr(counted_broadcast, "__defaults__", (bound,))
    rows = [(1, ["a", "b", None, "a", "c"]), (2, []), (3, None), (4, ["x", "x"]), (5, ["a"]), (6, [None])]
    df = spark.createDataFrame(rows, "row long, t array<string>").withColumn("hits", F.lit(1))
    stop = spark.createDataFrame([("a",), (None,), ("zz",), ("a",)], "w string")
    want = {1: ["b", "c"], 2: [], 3: None, 4: ["x", "x"], 5: [], 6: []}
    for id_col in (None, "row"):
        got = X.remove_stopwords(df, "t", stop, id_col=id_col)
        assert got.columns == df.columns and {r.row: r.t for r in got.collect()} == want
    both = X.remove_stopwords(df, "t", stop, out_col="kept")
    assert {r.row: (r.t, r.kept) for r in both.collect()} == {i: (t, want[i]) for i, t in rows}


@pytest.mark.parametrize("id_col", ["__id", "__t", "row", "at", "hits", "t", "pos"])
def test_merge_phrases_with_any_key_name(spark, id_col):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b", "b"]), (2, ["b"]), (3, None)], f"{id_col} long, tokens array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("b", "b")], "a string, b string")
    got = {r[id_col]: r.merged for r in X.merge_phrases(df, "tokens", phrases, id_col).collect()}
    assert got == {1: ["a_b", "a_b", "b"], 2: ["b"], 3: []}


def test_fold_equals_unicodedata_on_all_code_points(spark):
    codes = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and c]
    rows = [(i, "".join(map(chr, codes[i:i + 4096]))) for i in range(0, len(codes), 4096)]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {r.id: r.f for r in df.select("id", fold.fold_to_ascii("s").alias("f")).collect()}
    for i, s in rows:
        assert got[i] == unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    odd = [(1, None), (2, ""), (3, "ﬁné"), (4, "ﬁné ½\U0001D400\U0001F600 ok")]
    out = spark.createDataFrame(odd, "id long, s string").select("id", fold.ascii_fold("s").alias("f"))
    assert {r.id: r.f for r in out.collect()} == {1: None, 2: "", 3: "ﬁné", 4: "fine 12A ok"}


def test_entries_of_other_hashes_stay_out_of_the_shuffled_join(spark, monkeypatch):
    from reviewlens.operators import text_ops
    from reviewlens.session import counted_broadcast
    entries = spark.range(20000).selectExpr("id AS row", "0 AS pos", "concat('a', id) AS a", "'b' AS b")
    table = spark.range(0, 20000, 100).selectExpr("concat('a', id) AS a", "'b' AS b")
    kept = {r.row for r in text_ops._may_stand_in(entries, table, ["a", "b"]).collect()}
    assert kept >= set(range(0, 20000, 100)) and len(kept) < 400
    monkeypatch.setattr(text_ops, "BITS", 64)                # most entries share a bit with a phrase
    monkeypatch.setattr(counted_broadcast, "__defaults__", (0,))
    df = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"]), (2, []), (3, None), (4, ["b", None, "a", "b"])],
                               "doc_id long, tokens array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("a", "b"), ("x", "y"), (None, "a")], "a string, b string")
    got = {r.doc_id: r.merged for r in text_ops.merge_phrases(df, "tokens", phrases, "doc_id").collect()}
    assert got == {1: ["a_b", "c", "a_b"], 2: [], 3: [], 4: ["b", None, "a_b"]}
