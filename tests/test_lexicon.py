"""Dictionary segmentation by a word table, against the one-expression segmenter and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from reviewlens.functions.text import lexicon_segmenter
from reviewlens.operators import lexicon
from reviewlens.operators.lexicon import segment
from reviewlens.session import counted_broadcast

WORDS = ["打卡", "打", "打卡送", "送飲料", "飲料", "a b", "\U0001F600x", "\U0001F600", "ab", "abc", "bcd", "$1", ".", "10"]


def longest_match(text, words):
    out, i = [], 0
    most = max(map(len, words))
    while i < len(text):
        n = next((n for n in range(most, 0, -1) if text[i:i + n] in words), 0)
        if n or not text[i].isspace():
            out.append(text[i:i + max(n, 1)])
        i += max(n, 1)
    return out


def texts():
    rng = random.Random(5)
    parts = [*WORDS, " ", "\n", "a", "b", "c", "d", "卡", "0", "1", "丁"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [
        "", " ", "打卡送飲料", "打卡送飲料", "a bc" * 20000]


@pytest.mark.parametrize("bound, id_col", [(1 << 18, None), (0, "row")])
def test_table_equals_regex_and_scan(spark, monkeypatch, bound, id_col):
    monkeypatch.setattr(counted_broadcast, "__defaults__", (bound,))
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, (len(rows), None)], "row long, text string").withColumn("at", F.lit("own"))
    words = spark.createDataFrame([(w,) for w in [*WORDS, "", None, "ab", *(f"never{i}" for i in range(2000))]],
                                  "w string")
    got = segment(df, "text", words, id_col=id_col)
    assert got.columns == ["row", "text", "at", "tokens"]
    by_row = {r.row: r.tokens for r in got.collect()}
    assert by_row == {**{i: longest_match(t, set(WORDS)) for i, t in rows}, len(rows): None}
    regex = df.select("row", lexicon_segmenter(WORDS)("text").alias("t"))
    assert by_row == {r.row: r.t for r in regex.collect()}
    assert "Python" not in got._jdf.queryExecution().toString()


def test_no_words_and_no_rows(spark):
    none = spark.createDataFrame([], "w string")
    df = spark.createDataFrame([("a b",), ("",), (None,)], "text string")
    assert [r.tokens for r in segment(df, "text", none).collect()] == [["a", "b"], [], None]
    assert segment(df.limit(0), "text", spark.createDataFrame([("a",)], "w string")).collect() == []


def test_listed_words_need_no_substrings(spark):
    words = spark.createDataFrame([(w,) for w in WORDS], "w string")
    df = spark.createDataFrame([("a bc abcd", )], "text string")
    plan = segment(df, "text", words)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan


@pytest.mark.parametrize("bound", [1 << 18, 0])
def test_words_beyond_the_tree(spark, monkeypatch, bound):
    monkeypatch.setattr(lexicon, "TREE_WORDS", 0)
    monkeypatch.setattr(counted_broadcast, "__defaults__", (bound,))
    rows = list(enumerate(texts()))
    got = segment(spark.createDataFrame(rows, "row long, text string"), "text",
                  spark.createDataFrame([(w,) for w in WORDS], "w string"), id_col="row")
    assert {r.row: r.tokens for r in got.collect()} == {i: longest_match(t, set(WORDS)) for i, t in rows}
