"""Registered queries: listings, exclusions, caps, ordinals, splits, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PY_SPACE_CLASS
from ..operators import listings as LS
from ..operators import metrics as M
from ..operators import ordering as O
from ..operators import split as SP
from .registry import r6, register, sq
from .tables import AMBIGUOUS_NATIONS, EXCLUDED_NATIONS, table

HASH_SQL = "('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT"


@register("eligible_listings", """
SELECT o_orderkey, o_orderpriority AS name, nullif(o_orderstatus, 'O') AS status FROM orders
WHERE coalesce(trim(o_orderpriority) <> '', false)
  AND (nullif(o_orderstatus, 'O') IS NULL OR nullif(o_orderstatus, 'O') <> 'F')""")
def eligible_listings(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("name"),
        F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"))
    return LS.eligible_listings(o, closed="F")


@register("listing_conditions", """
SELECT event_id, user_id, value FROM events
WHERE value >= 4.5 AND dayofweek(ts) = 6 AND hour(ts) = 12""")
def listing_conditions(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value", "ts")
    return LS.listing_conditions(e, "value", 4.5, ts_col="ts").drop("ts")


CUST_NATION = "customer JOIN nation ON c_nationkey = n_nationkey"


def _cust_nation(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "c_name", "n_name")


@register("exclude_list", f"""
SELECT c_custkey, n_name FROM {CUST_NATION}
WHERE n_name NOT IN ({", ".join(sq(x) for x in EXCLUDED_NATIONS)})""")
def exclude_list(spark, sf):
    return LS.exclude_names(_cust_nation(spark, sf), "n_name", EXCLUDED_NATIONS).select("c_custkey", "n_name")


@register("search_keyword", f"""
SELECT c_custkey, CASE WHEN n_name IN ({", ".join(sq(x) for x in AMBIGUOUS_NATIONS)})
                       THEN c_name || ' ' || n_name ELSE c_name END AS keyword FROM {CUST_NATION}""")
def search_keyword(spark, sf):
    return LS.search_keyword(_cust_nation(spark, sf), "c_name", "n_name", AMBIGUOUS_NATIONS,
                            key_col="n_name").select(
        "c_custkey", "keyword")


@register("prefer_full_text", f"""
SELECT conv_id, turn, coalesce(nullif(CASE WHEN turn % 2 = 0 THEN text ELSE '' END, ''),
                               regexp_replace(text, {sq(f'[{PY_SPACE_CLASS}]+')}, ' ', 'g')) AS review_text
FROM conversations""")
def prefer_full_text(spark, sf):
    c = table(spark, sf, "conversations")
    full = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit(""))
    snippet = F.regexp_replace("text", f"[{PY_SPACE_CLASS}]+", " ")
    return c.select("conv_id", "turn", LS.prefer_full_text(full, snippet).alias("review_text"))


@register("count_clamp", """
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(least(count(*), 30) AS BIGINT) AS capped
FROM documents GROUP BY source""")
def count_clamp(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return LS.count_clamp(counts, "n", 30)


@register("collection_completeness", """
WITH want AS (SELECT source, count(*) AS announced FROM documents GROUP BY source),
  got AS (SELECT d.source, count(*) AS collected FROM labels l JOIN documents d ON d.doc_id = l.doc_id
          GROUP BY d.source)
SELECT w.source, CAST(announced AS BIGINT) AS announced, CAST(least(announced, 60) AS BIGINT) AS expected,
       CAST(coalesce(collected, 0) AS BIGINT) AS collected,
       CASE WHEN coalesce(collected, 0) >= least(announced, 60) THEN 'complete' ELSE 'partial' END AS status
FROM want w LEFT JOIN got g ON g.source = w.source""")
def collection_completeness(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    collected = table(spark, sf, "labels").select("doc_id").join(docs, "doc_id")
    return LS.collection_completeness(collected, docs, "source")


@register("cap_per_group", """
SELECT doc_id, source, rank FROM (
  SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS rank
  FROM documents) WHERE rank <= 10""")
def cap_per_group(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return LS.cap_per_group(d, "source", ["doc_id"], 10, "rank")


@register("ordinal_in_group", """
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS ordinal
FROM conversations""")
def ordinal_in_group(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    return O.ordinal_in_group(c, ["conv_id"], ["turn"], "ordinal")


@register("first_match", """
SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id""")
def first_match(spark, sf):
    c = table(spark, sf, "conversations")
    return O.first_in_group(c, "conv_id", "turn", ["role", "text"])


@register("rows_after_position", """
SELECT event_id, user_id, ordinal FROM (
  SELECT event_id, user_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS ordinal
  FROM events) WHERE ordinal > 8""")
def rows_after_position(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return LS.rows_after_position(e, "user_id", ["ts", "event_id"], 8).select("event_id", "user_id", "ordinal")


@register("unseen_entities", """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unseen_entities(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return LS.unseen_entities(d, table(spark, sf, "labels"), "doc_id")


@register("seen_entities", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def seen_entities(spark, sf):
    return LS.seen_entities(table(spark, sf, "documents"), "source")


@register("union_distinct", """
SELECT lang AS value FROM documents UNION SELECT role AS value FROM conversations""")
def union_distinct(spark, sf):
    a = table(spark, sf, "documents").select(F.col("lang").alias("value"))
    b = table(spark, sf, "conversations").select(F.col("role").alias("value"))
    return LS.union_distinct(a, b)


# ------------------------------------------------------------------ splits

@register("hash_split", f"SELECT doc_id, CAST({HASH_SQL} % 100 < 20 AS BIGINT) AS is_test FROM documents")
def hash_split(spark, sf):
    return SP.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@register("exact_split", f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {HASH_SQL}, doc_id) <= ceil(0.2 * count(*) OVER ()) AS BIGINT)
       AS is_test FROM documents""")
def exact_split(spark, sf):
    return SP.exact_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@register("three_way_split", f"""
SELECT doc_id, CASE WHEN {HASH_SQL} % 100 < 80 THEN 'train' WHEN {HASH_SQL} % 100 < 90 THEN 'validation'
                    ELSE 'test' END AS part FROM documents""")
def three_way_split(spark, sf):
    return SP.three_way_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


# ------------------------------------------------------------------ metrics

@register("classification_metrics", """
WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND 1 - toxic = 1) AS tp,
                  count(*) FILTER (WHERE quality <> 1 AND 1 - toxic = 1) AS fp,
                  count(*) FILTER (WHERE quality = 1 AND 1 - toxic <> 1) AS fn,
                  count(*) FILTER (WHERE quality <> 1 AND 1 - toxic <> 1) AS tn FROM labels),
  r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc,
               CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END AS fpr,
               CASE WHEN tp + fp + fn + tn > 0 THEN (tp + fn) / (tp + fp + fn + tn) ELSE 0 END AS prev FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END, 6) AS accuracy,
       round(p, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1,
       round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN (rc + 1 - fpr) / 2 END, 6) AS roc_auc,
       round(CASE WHEN tp + fp > 0 THEN rc * p + (1 - rc) * prev ELSE prev END, 6) AS avg_precision
FROM r""")
def classification_metrics(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("quality").alias("label"),
                                           (F.lit(1) - F.col("toxic")).alias("prediction"))
    out = M.classification_metrics(lab)
    return out.select("tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in
                      ("accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision")])


@register("score_auc", """
WITH s AS (SELECT l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
  per AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
          FROM s GROUP BY score),
  cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cpos,
                 sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cneg FROM per),
  t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM per)
SELECT round(CASE WHEN P > 0 AND N > 0 THEN sum(pos * (N - cneg) + 0.5 * pos * neg) / (P * N) END, 6) AS roc_auc,
       round(CASE WHEN P > 0 THEN sum(pos / P * (cpos / (cpos + cneg))) END, 6) AS avg_precision,
       CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives
FROM cum, t GROUP BY P, N""")
def score_auc(spark, sf):
    s = (table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
         .select(F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score")))
    out = M.score_auc(s)
    return out.select(r6("roc_auc").alias("roc_auc"), r6("avg_precision").alias("avg_precision"),
                      "positives", "negatives")
