"""Golden rows for the scalar text functions (see FIXTURES.md)."""

import pytest
from pyspark.sql import functions as F

from reviewlens.config import PROMO_PATTERNS
from reviewlens.functions import text as T
from reviewlens.functions.fold import ascii_fold


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r[0] for r in df.select(fn(F.col("v")).alias("o")).collect()]


def test_relative_time_golden(spark):
    rows = [("2 年前", "2022/03/02 10:05"), ("3 個月前", "2023/12/02 10:05"), ("2 週前", "2024/02/16 10:05"),
            ("5 天前", "2024/02/25 10:05"), ("7 小時前", "2024/03/01 03:05"), ("20 分鐘前", "2024/03/01 09:45"),
            ("上次編輯：1 年前", "2023/03/02 10:05"), ("剛剛", "剛剛"), ("３ 天前", "2024/02/27 10:05")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "age string").withColumn(
        "anchor", F.to_timestamp(F.lit("2024-03-01 10:05:00")))
    got = [r[0] for r in df.select(T.relative_time("age", "anchor")).collect()]
    assert got == [b for _, b in rows]


def test_relative_time_unit_without_number_is_null(spark):
    df = spark.createDataFrame([("幾天前",)], "age string").withColumn("anchor", F.current_timestamp())
    assert df.select(T.relative_time("age", "anchor")).first()[0] is None


def test_promo_patterns_golden(spark):
    rows = [("五星好評送小菜", True), ("打卡就送飲料，讚😀", True), ("給五星 有送甜點", False),
            ("加入line會員送折扣", True), ("加入LINE會員送折扣", False), ("餐點普通", False),
            ("5星評論就送", True), ("給五星　有送甜點", False)]
    got = one_col(spark, [t for t, _ in rows], lambda c: T.matches_any(c, PROMO_PATTERNS))
    assert got == [m for _, m in rows]


def test_keep_charset_and_strip_emoji_golden(spark):
    rows = [("五星好評送小菜 😀ok!", "五星好評送小菜", "五星好評送小菜 ok!"),
            ("打卡 送，ABC123 飲料☆", "打卡送飲料", "打卡 送，ABC123 飲料"),
            ("😀", "", "")]
    assert one_col(spark, [r[0] for r in rows], T.keep_charset) == [r[1] for r in rows]
    assert one_col(spark, [r[0] for r in rows], T.strip_emoji) == [r[2] for r in rows]


def test_parsers_golden(spark):
    assert one_col(spark, ["1,234 則評論", "n/a"], T.parse_count) == [1234, None]
    assert one_col(spark, ["評等：5.0 (最高：5)，"], T.parse_rating) == [5.0]
    assert one_col(spark, ["3 天前\n最新"], T.strip_suffix) == ["3 天前"]
    assert one_col(spark, ["約 １２ 則", "abc", "x 7 y 9"], T.first_int) == [12, None, 7]


def test_tokenizers(spark):
    assert one_col(spark, ["Hello, wörld_x a 42!"], T.tokenize_word) == [["hello", "wörld_x", "42"]]
    assert one_col(spark, [" a　b\t\nc  ", "", None], T.tokenize_whitespace) == [["a", "b", "c"], [], []]
    assert one_col(spark, ["héllo", "a", ""], lambda c: T.char_ngrams(c, 2)) == [["hé", "él", "ll", "lo"], [], []]


def test_remove_terms_keeps_order_and_duplicates(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "b"],)], "t array<string>")
    assert df.select(T.remove_terms("t", ["b"])).first()[0] == ["a", "a", "c"]


def greedy(tokens, phrases):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and f"{tokens[i]} {tokens[i + 1]}" in phrases:
            out.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_merge_phrases_column_matches_greedy(spark):
    import random
    rnd = random.Random(7)
    rows = [[rnd.choice("abc") for _ in range(rnd.randint(0, 12))] for _ in range(200)]
    rows += [["a", "b", "c", "a", "b", "a"], ["a"], []]
    phrases = {"a b", "b c", "c c"}
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, t array<string>")
    got = {r[0]: r[1] for r in df.select("id", T.merge_phrases("t", phrases)).collect()}
    for i, r in enumerate(rows):
        assert got[i] == greedy(r, phrases), r
    assert got[len(rows) - 3] == ["a_b", "c", "a_b", "a"]


def test_contains_any(spark):
    vals = ["今天 打卡 送 飲料", "打卡送 飲料", None]
    assert one_col(spark, vals, lambda c: T.contains_any(c, ["打卡 送"])) == [True, False, False]


def test_ascii_fold(spark):
    assert one_col(spark, ["café", "café😀", None], ascii_fold) == ["café", "cafe", None]


def test_contains_any_many_features_uses_same_semantics(spark):
    feats = [f"w{i} x" for i in range(400)] + ["打卡 送"]
    vals = ["今天 打卡 送 飲料", "w399 x", "w399x", None]
    for more in ([], [""]):   # an empty feature is no feature, however many there are
        assert one_col(spark, vals, lambda c: T.contains_any(c, feats + more)) == [True, True, False, False]
    assert one_col(spark, vals, lambda c: T.contains_any(c, [""])) == [False] * 4


def test_tokenizer_modes(spark):
    vals = ["打卡送飲料 ok 好", "", None]
    assert one_col(spark, vals, lambda c: T.tokenize(c)) == [["打卡", "卡送", "送飲", "飲料", "ok", "好"], [], None]
    assert one_col(spark, vals, lambda c: T.tokenize(c, T.lexicon_segmenter(["打卡", "打", "飲料"]))) == [
        ["打卡", "送", "飲料", "o", "k", "好"], [], None]
    with pytest.raises(ValueError, match="unknown tokenizer"):
        T.tokenize("text", "ckj_ngram")


def test_relative_time_survives_huge_numbers(spark):
    vals = ["99999999 年前", "99999999999999999999 天前", "剛剛"]
    assert one_col(spark, vals, lambda c: T.relative_time(c)) == [None, None, "剛剛"]


def test_ascii_fold_works_once_per_text(spark):
    """The folded text is bound once, and ASCII is passed over before the long class of code points."""
    from reviewlens.functions.fold import fold_to_ascii
    texts = ["plain", "é́ﬁ½😀x", "中文 a", "", None, "Ⅷ\x7f\x80"]
    assert one_col(spark, texts, fold_to_ascii) == ["plain", "efi12x", " a", "", None, "VIII\x7f"]
    plan = spark.createDataFrame([("é",)], "s string").select(fold_to_ascii("s").alias("f"))._jdf.queryExecution().toString()
    optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("regexp_replace(") == 1
