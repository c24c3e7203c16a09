"""Registered queries: cleaning, scalar text functions, labels, tokenisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import (
    NEWEST_SUFFIX, PY_SPACE_CLASS, RATING_PREFIX, RATING_SUFFIX,
    RELATIVE_UNITS, REVIEW_COUNT_SUFFIX,
)
from ..functions import text as T
from ..functions.fold import ascii_fold
from ..operators import label as L
from ..operators import text_ops as X
from ..operators.lexicon import segment
from .registry import r6, register, sq, sql_list
from .tables import (
    TEST_CHARSET, TEST_FEATURES, TEST_MARKER, TEST_PATTERNS, TEST_STOPWORDS,
    WORD_PATTERN, holed_documents, rated_documents, table,
)

WORD = sq(T.WORD_TOKEN)
PROMO_ALT = sq(T.promo_regex(TEST_PATTERNS))
WORD_ALT = sq(T.promo_regex([WORD_PATTERN]))
RATING_SQL = "CAST(1 + doc_id % 5 AS DOUBLE)"
SPACE_RUN = sq(f"[{PY_SPACE_CLASS}]+")


# ------------------------------------------------------------------ labels

@register("rule_label", f"""
SELECT doc_id, {RATING_SQL} AS rating,
       CAST(coalesce(regexp_matches(text, {WORD_ALT}), false) AS BIGINT) AS is_promotional,
       CAST(coalesce({RATING_SQL} = 5 AND regexp_matches(text, {WORD_ALT}), false) AS BIGINT) AS is_inducing
FROM documents""")
def rule_label(spark, sf):
    d = rated_documents(spark, sf)
    return L.rule_label(d, text_col="text", rating_col="rating", patterns=[WORD_PATTERN]).select(
        "doc_id", "rating", "is_promotional", "is_inducing")


def induced_share_plan(spark, sf):
    d = rated_documents(spark, sf).select("doc_id", "source", "text", "rating")
    lab = L.rule_label(d, text_col="text", rating_col="rating", patterns=[WORD_PATTERN])
    return lab.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.sum("is_promotional").cast("bigint").alias("n_promotional"),
        F.sum("is_inducing").cast("bigint").alias("n_inducing"),
        r6(F.avg("is_inducing")).alias("induced_share"))


register("induced_share", f"""
SELECT source, CAST(count(*) AS BIGINT) AS n_reviews,
       CAST(sum(p) AS BIGINT) AS n_promotional, CAST(sum(i) AS BIGINT) AS n_inducing,
       round(avg(i), 6) AS induced_share
FROM (SELECT source,
             CAST(coalesce(regexp_matches(text, {WORD_ALT}), false) AS BIGINT) AS p,
             CAST(coalesce({RATING_SQL} = 5 AND regexp_matches(text, {WORD_ALT}), false) AS BIGINT) AS i
      FROM documents) GROUP BY source""")(induced_share_plan)


@register("promo_match", f"""
SELECT doc_id, CAST(coalesce(regexp_matches(text, {PROMO_ALT}), false) AS BIGINT) AS is_promotional
FROM documents""")
def promo_match(spark, sf):
    d = table(spark, sf, "documents")
    return L.promo_flag(d, "text", TEST_PATTERNS).select("doc_id", "is_promotional")


@register("extreme_label", f"""
SELECT doc_id, {RATING_SQL} AS rating, CAST({RATING_SQL} IN (1, 5) AS BIGINT) AS is_extreme
FROM documents""")
def extreme_label(spark, sf):
    d = rated_documents(spark, sf)
    return L.extreme_label(d, "rating").select("doc_id", "rating", "is_extreme")


PROCESSED_SQL = f"array_to_string(regexp_extract_all(lower(text), {WORD}, 1), ' ')"


@register("feature_label", f"""
SELECT doc_id, {RATING_SQL} AS rating,
       CAST({RATING_SQL} = 5 AND list_bool_or(list_transform({sql_list(sorted(TEST_FEATURES))},
            lambda f: contains({PROCESSED_SQL}, f))) AS BIGINT) AS is_inducing
FROM documents""")
def feature_label(spark, sf):
    d = rated_documents(spark, sf).withColumn("processed", T.join_tokens(T.tokenize_word("text")))
    return L.feature_label(d, text_col="processed", rating_col="rating",
                           features=TEST_FEATURES).select("doc_id", "rating", "is_inducing")


#: 3,000 features, some of which occur: the same operator with a long table


@register("feature_label_table", f"""
WITH b AS (SELECT {PROCESSED_SQL} AS t FROM benchmark),
  w AS (SELECT string_split(t, ' ') AS l FROM b),
  f AS (SELECT DISTINCT l[i] || ' ' || l[i + 1] AS feature FROM w, unnest(range(1, len(l))) AS r(i)),
  p AS MATERIALIZED (SELECT doc_id, {PROCESSED_SQL} AS processed FROM documents WHERE {RATING_SQL} = 5),
  h AS (SELECT DISTINCT doc_id FROM p JOIN f ON contains(processed, feature))
SELECT doc_id, CAST(doc_id IN (SELECT doc_id FROM h) AS BIGINT) AS is_inducing FROM documents""")
def feature_label_table(spark, sf):
    """Features from a table: every pair of neighbouring words of the benchmark texts."""
    pairs = F.explode(T.adjacent_pairs(T.tokenize_word("text")))
    feats = table(spark, sf, "benchmark").select(pairs.alias("feature"))
    d = rated_documents(spark, sf).withColumn("processed", T.join_tokens(T.tokenize_word("text")))
    return L.feature_label(d, text_col="processed", rating_col="rating", features=feats,
                           id_col="doc_id").select("doc_id", "is_inducing")


@register("remove_many_stopwords", f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {WORD}, 1)) AS word FROM benchmark),
  t AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS p
        FROM (SELECT doc_id, regexp_extract_all(lower(text), {WORD}, 1) AS l FROM documents)),
  k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS tokens FROM t ANTI JOIN w USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN k USING (doc_id)""")
def remove_many_stopwords(spark, sf):
    """A stop list drawn from a table: every word of the benchmark texts."""
    stop = table(spark, sf, "benchmark").select(F.explode(T.tokenize_word("text")).alias("word"))
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_word("text").alias("t"))
    out = X.remove_stopwords(d, "t", stop, id_col="doc_id")
    return out.select("doc_id", T.join_tokens("t").alias("tokens"))


#: phrases put behind each text by its id, to give CJK runs, emoji and mixed script
CJK_PARTS = ("打卡送飲料，餐點好吃", "五星好評\U0001F600送小菜", "好", "加入line會員 送折扣")


@register("tokenize_cjk", f"""
WITH d AS (SELECT doc_id, {sql_list(CJK_PARTS)}[1 + doc_id % {len(CJK_PARTS)}] || ' ' || source AS t FROM documents),
  p AS (SELECT doc_id, unnest(regexp_extract_all(t, {sq(f"([{T.CJK_RUN}]+|[^{T.CJK_RUN}{PY_SPACE_CLASS}]+)")}, 1)) AS piece,
               generate_subscripts(regexp_extract_all(t, {sq(f"([{T.CJK_RUN}]+|[^{T.CJK_RUN}{PY_SPACE_CLASS}]+)")}, 1), 1) AS k FROM d),
  g AS (SELECT doc_id, k, CASE WHEN regexp_matches(piece, {sq(f"^[{T.CJK_RUN}]")}) AND length(piece) > 1
               THEN list_transform(range(1, length(piece)), lambda i: substring(piece, i, 2)) ELSE [piece] END AS l FROM p)
SELECT doc_id, array_to_string(flatten(list(l ORDER BY k)), '|') AS tokens FROM g GROUP BY doc_id""")
def tokenize_cjk(spark, sf):
    """Default segmentation: CJK bigrams, other runs whole."""
    part = F.element_at(F.array(*[F.lit(p) for p in CJK_PARTS]), (F.col("doc_id") % len(CJK_PARTS) + 1).cast("int"))
    d = table(spark, sf, "documents", spread_text=False).select("doc_id", F.concat(part, F.lit(" "), "source").alias("t"))
    return d.select("doc_id", F.array_join(T.tokenize("t"), "|").alias("tokens"))


# ------------------------------------------------------------------ cleaning

@register("clean_reviews", f"""
WITH k AS (
  SELECT doc_id, text, {RATING_SQL} AS rating FROM documents
  WHERE text IS NOT NULL AND NOT contains(text, {sq(TEST_MARKER)})),
t AS (
  SELECT doc_id, rating,
         CAST(coalesce(rating = 5 AND regexp_matches(text, {WORD_ALT}), false) AS BIGINT) AS is_inducing,
         array_to_string(list_filter(
             regexp_extract_all(lower(regexp_replace(text, {sq(TEST_CHARSET)}, '', 'g')), {WORD}, 1),
             lambda x: NOT list_contains({sql_list(TEST_STOPWORDS)}, x)), ' ') AS processed
  FROM k)
SELECT doc_id, rating, processed, is_inducing FROM t WHERE processed <> ''""")
def clean_reviews(spark, sf):
    d = rated_documents(spark, sf)
    return X.clean_reviews(d, text_col="text", rating_col="rating", stopwords=TEST_STOPWORDS,
                           marker=TEST_MARKER, removed_class=TEST_CHARSET,
                           patterns=[WORD_PATTERN]).select("doc_id", "rating", "processed", "is_inducing")


HOLED_SQL = """(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN ''
                ELSE text END AS text FROM documents)"""


@register("drop_null_text", f"SELECT doc_id, text FROM {HOLED_SQL} WHERE text IS NOT NULL")
def drop_null_text(spark, sf):
    return X.drop_null_text(holed_documents(spark, sf), "text")


@register("drop_marked_text", f"""
SELECT doc_id, source FROM documents WHERE NOT coalesce(contains(text, {sq(TEST_MARKER)}), false)""")
def drop_marked_text(spark, sf):
    return X.drop_marked_text(table(spark, sf, "documents"), "text", TEST_MARKER).select("doc_id", "source")


@register("neq_null_safe", f"SELECT doc_id, text FROM {HOLED_SQL} WHERE text IS DISTINCT FROM ''")
def neq_null_safe(spark, sf):
    return X.drop_equal_null_safe(holed_documents(spark, sf), "text", "")


@register("fill_text", f"SELECT doc_id, coalesce(text, '') AS text FROM {HOLED_SQL}")
def fill_text(spark, sf):
    return X.fill_text(holed_documents(spark, sf), "text")


@register("strip_emoji", f"""
SELECT doc_id, regexp_replace(text, {sq(T.EMOJI_CLASS + '+')}, '', 'g') AS cleaned FROM documents""")
def strip_emoji(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.strip_emoji("text").alias("cleaned"))


@register("keep_charset", f"""
SELECT doc_id, regexp_replace(text, {sq(TEST_CHARSET)}, '', 'g') AS kept FROM documents""")
def keep_charset(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.keep_charset("text", TEST_CHARSET).alias("kept"))


@register("ascii_fold", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') || ' ok'
       ELSE text || ' ok' END AS folded FROM documents""")
def ascii_fold_q(spark, sf):
    """Every third text gets an emoji, so that it is folded."""
    d = table(spark, sf, "documents")
    mark = F.when(F.col("doc_id") % 3 == 0, F.lit(" \U0001F600ok")).otherwise(F.lit(" ok"))
    return d.select("doc_id", ascii_fold(F.concat("text", mark)).alias("folded"))


# ------------------------------------------------------------------ parsing

def _age_sql() -> str:
    units = [u for u, *_ in RELATIVE_UNITS]
    cases = " ".join(f"WHEN event_id % 7 = {i} THEN {sq(u)}" for i, u in enumerate(units))
    return (f"CAST(1 + event_id % 9 AS VARCHAR) || ' ' || "
            f"CASE {cases} ELSE '剛剛' END")


def _resolve_sql() -> str:
    parts = []
    for unit, days, hours, minutes in RELATIVE_UNITS:
        delta = f"to_days(CAST(n * {days} AS INTEGER)) + to_hours(CAST(n * {hours} AS BIGINT)) + " \
                f"to_minutes(CAST(n * {minutes} AS BIGINT))"
        parts.append(f"WHEN contains(age, {sq(unit)}) THEN strftime(ts - ({delta}), '%Y/%m/%d %H:%M')")
    return "CASE " + " ".join(parts) + " ELSE age END"


@register("relative_time", f"""
SELECT event_id, age, {_resolve_sql()} AS review_date
FROM (SELECT event_id, ts, age,
             CAST(nullif(regexp_extract(age, '([0-9]+)', 1), '') AS BIGINT) AS n
      FROM (SELECT event_id, ts, {_age_sql()} AS age FROM events))""")
def relative_time(spark, sf):
    e = table(spark, sf, "events")
    units = [u for u, *_ in RELATIVE_UNITS]
    unit = F.element_at(F.array(*[F.lit(u) for u in units] + [F.lit("剛剛")]),
                        (F.col("event_id") % 7 + 1).cast("int"))
    age = F.concat((F.lit(1) + F.col("event_id") % 9).cast("string"), F.lit(" "), unit)
    return (e.select("event_id", "ts", age.alias("age"))
            .select("event_id", "age", T.relative_time("age", "ts").alias("review_date")))


@register("first_int", """
SELECT event_id, CAST(nullif(regexp_extract(translate(props, '０１２３４５６７８９', '0123456789'),
       '([0-9]+)', 1), '') AS BIGINT) AS k FROM events""")
def first_int(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", T.first_int("props").alias("k"))


@register("parse_count", f"""
SELECT event_id, CAST(nullif(regexp_replace(format('{{:,}}', CAST(round(value * 100) AS BIGINT))
       || {sq(REVIEW_COUNT_SUFFIX)}, '[^0-9]', '', 'g'), '') AS BIGINT) AS review_count FROM events""")
def parse_count(spark, sf):
    e = table(spark, sf, "events")
    txt = F.concat(F.format_number(F.round(F.col("value") * 100).cast("bigint"), 0), F.lit(REVIEW_COUNT_SUFFIX))
    return e.select("event_id", T.parse_count(txt).alias("review_count"))


@register("parse_rating", f"""
SELECT event_id, CAST(replace(replace({sq(RATING_PREFIX)} || CAST(value AS VARCHAR) || {sq(RATING_SUFFIX)},
       {sq(RATING_PREFIX)}, ''), {sq(RATING_SUFFIX)}, '') AS DOUBLE) AS rating FROM events""")
def parse_rating(spark, sf):
    e = table(spark, sf, "events")
    txt = F.concat(F.lit(RATING_PREFIX), F.col("value").cast("string"), F.lit(RATING_SUFFIX))
    return e.select("event_id", T.parse_rating(txt).alias("rating"))


@register("strip_suffix", f"""
SELECT event_id, replace(event_type || CASE WHEN event_id % 3 = 0 THEN {sq(NEWEST_SUFFIX)} ELSE '' END,
       {sq(NEWEST_SUFFIX)}, '') AS age FROM events""")
def strip_suffix(spark, sf):
    e = table(spark, sf, "events")
    raw = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, F.lit(NEWEST_SUFFIX)).otherwise(F.lit("")))
    return e.select("event_id", T.strip_suffix(raw).alias("age"))


# ------------------------------------------------------------------ tokenisers

@register("tokenize_word", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(lower(text), {WORD}, 1) AS t FROM documents)""")
def tokenize_word(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_word("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), T.join_tokens("t").alias("tokens"))


@register("tokenize_whitespace", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, {SPACE_RUN}), lambda x: x <> '') AS t
      FROM documents)""")
def tokenize_whitespace(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_whitespace("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), T.join_tokens("t").alias("tokens"))


@register("tokenize_ngram", """
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_grams, array_to_string(g, '|') AS grams
FROM (SELECT doc_id, list_transform(range(1, length(text)), lambda i: substring(text, i, 2)) AS g
      FROM documents)""")
def tokenize_ngram(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.char_ngrams("text", 2).alias("g"))
    return d.select("doc_id", F.size("g").cast("bigint").alias("n_grams"), F.array_join("g", "|").alias("grams"))


#: a dictionary that does not grow with the corpus: every pair of these syllables, and them
LEXICON_PARTS = ("the", "th", "er", "en", "in", "re", "ti", "on", "and", "der", "ion", "ch", "ei")
LEXICON = sorted({*LEXICON_PARTS, *(a + b for a in LEXICON_PARTS for b in LEXICON_PARTS)},
                 key=lambda w: (-len(w), w))


@register("tokenize_lexicon", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[^\\p{{L}}]+', '', 'g'),
             '({"|".join(LEXICON)}|.)', 1) AS t FROM documents)""")
def tokenize_lexicon(spark, sf):
    """Forward maximum matching of run-together text against a dictionary."""
    d = table(spark, sf, "documents")
    joined = F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "")
    out = d.select("doc_id", T.lexicon_segmenter(LEXICON)(joined).alias("t"))
    return out.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), T.join_tokens("t").alias("tokens"))


@register("tokenize_lexicon_table", r"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, regexp_extract_all(regexp_replace(lower(text), '[^\p{L}]+', '', 'g'), p, 1) AS t
      FROM documents, (SELECT '(' || string_agg(w, '|' ORDER BY length(w) DESC, w) || '|.)' AS p
                       FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{2,}')) AS w
                             FROM benchmark)))""")
def tokenize_lexicon_table(spark, sf):
    """Run-together text segmented by the words of the benchmark texts, a table of any size."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(
        F.lower("text"), F.lit(r"(\p{L}{2,})"), 1)).alias("w"))
    joined = table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace(F.lower("text"), r"[^\p{L}]+", "").alias("text"))
    out = segment(joined, "text", words, "t")
    return out.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), T.join_tokens("t").alias("tokens"))


@register("remove_stopwords", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), {WORD}, 1),
             lambda x: NOT list_contains({sql_list(TEST_STOPWORDS)}, x)) AS t FROM documents)""")
def remove_stopwords(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokenize_word("text").alias("t"))
    stop = spark.createDataFrame([(w,) for w in TEST_STOPWORDS], "word string")
    out = X.remove_stopwords(d, "t", stop)
    return out.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), T.join_tokens("t").alias("tokens"))
