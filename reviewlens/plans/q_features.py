"""Registered queries: bag of words, TF-IDF, phrases, neighbours, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import NEIGHBOURS_PER_SEED, PHRASE_MIN_COUNT, PHRASE_THRESHOLD, SEED_PHRASES, W2V_MIN_COUNT, W2V_WINDOW
from ..functions import text as T
from ..operators import cooccurrence as CO
from ..operators import features as FT
from ..operators import low_rank as LR
from ..operators import metrics as M
from ..operators import similarity as S
from ..operators import text_ops as X
from ..session import materialize
from .registry import r6, register, sq, sql_list
from .tables import PIVOT_TERMS, TEST_SEEDS, rated_documents, table

WORD = sq(T.WORD_TOKEN)
RUN = r"([\p{L}\p{N}_]+)"

TF_SQL = f"""tf AS (SELECT doc_id, w AS term, count(*) AS tf
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORD}, 1)) AS w FROM documents)
    GROUP BY doc_id, w),
  nd AS (SELECT count(*) AS n FROM documents)"""
IDF_SQL = "idf AS (SELECT term, count(*) AS df, ln((1 + nd.n) / (1 + count(*))) + 1 AS idf FROM tf, nd GROUP BY term, nd.n)"
WEIGHT_SQL = """w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)),
  tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _doc_terms(spark, sf):
    return FT.bow(_docs(spark, sf), "doc_id", "text")


def _n_docs(spark, sf):
    return table(spark, sf, "documents", spread_text=False).select(F.count(F.lit(1))).scalar()


@register("bow", f"WITH {TF_SQL} SELECT doc_id, term, CAST(tf AS BIGINT) AS tf FROM tf")
def bow(spark, sf):
    return _doc_terms(spark, sf)


@register("bow_pivot", "SELECT doc_id, " + ", ".join(
    f"CAST(len(list_filter(t, lambda x: x = {sq(w)})) AS BIGINT) AS tf_{w}" for w in PIVOT_TERMS)
    + f" FROM (SELECT doc_id, regexp_extract_all(lower(text), {WORD}, 1) AS t FROM documents)")
def bow_pivot(spark, sf):
    return FT.bow_fixed_terms(_docs(spark, sf), "doc_id", "text", PIVOT_TERMS)


@register("vocabulary", f"""
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {WORD}, 1)) AS term FROM documents)""")
def vocabulary(spark, sf):
    return FT.vocabulary(_doc_terms(spark, sf))


@register("idf", f"""
WITH {TF_SQL}, {IDF_SQL}
SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf""")
def idf(spark, sf):
    out = FT.idf(_doc_terms(spark, sf), _n_docs(spark, sf))
    return out.select("term", "df", r6("idf").alias("idf"))


@register("tfidf", f"""
WITH {TF_SQL}, {IDF_SQL}, {WEIGHT_SQL}
SELECT doc_id, term, round(weight, 6) AS weight FROM tfidf""")
def tfidf(spark, sf):
    out = FT.tfidf(_doc_terms(spark, sf), _n_docs(spark, sf))
    return out.select("doc_id", "term", r6("weight").alias("weight"))


@register("top_terms", f"""
WITH {TF_SQL}, {IDF_SQL}, {WEIGHT_SQL}
SELECT term, round(total, 6) AS total
FROM (SELECT term, sum(weight) AS total FROM tfidf GROUP BY term ORDER BY total DESC, term LIMIT 10)""")
def top_terms(spark, sf):
    out = FT.top_terms(FT.tfidf(_doc_terms(spark, sf), _n_docs(spark, sf)), 10)
    return out.select("term", r6("total").alias("total"))


@register("gamma_scale", f"""
WITH {TF_SQL},
  s AS (SELECT CAST(sum(tf) AS DOUBLE) AS s1, CAST(sum(tf * tf) AS DOUBLE) AS s2,
               count(DISTINCT term) AS v FROM tf),
  z AS (SELECT nd.n, s.v, s.s2 / (CAST(nd.n AS DOUBLE) * s.v) - pow(s.s1 / (CAST(nd.n AS DOUBLE) * s.v), 2) AS var
        FROM s, nd)
SELECT CAST(n AS BIGINT) AS n_docs, CAST(v AS BIGINT) AS n_terms, round(var, 9) AS variance,
       round(1.0 / (v * var), 12) AS gamma FROM z""")
def gamma_scale(spark, sf):
    out = FT.gamma_scale(_doc_terms(spark, sf), _n_docs(spark, sf))
    return out.select("n_docs", "n_terms", r6("variance", 9).alias("variance"), r6("gamma", 12).alias("gamma"))


# ------------------------------------------------------------------ phrases

PHRASE_BASE_SQL = f"""
  tok AS (SELECT doc_id, regexp_extract_all(lower(text), {sq(RUN)}, 1) AS t FROM documents),
  uni AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM tok) GROUP BY w),
  pairs AS (SELECT doc_id, i, t[i] AS a, t[i + 1] AS b
            FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tok)),
  bi AS (SELECT a, b, count(*) AS c_ab FROM pairs GROUP BY a, b),
  nv AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM bi) AS n),
  ph AS (SELECT bi.a, bi.b, ua.c AS c_a, ub.c AS c_b, bi.c_ab,
                CAST(bi.c_ab - {PHRASE_MIN_COUNT} AS DOUBLE) * nv.n / CAST(ua.c * ub.c AS DOUBLE) AS score
         FROM bi JOIN uni ua ON ua.w = bi.a JOIN uni ub ON ub.w = bi.b CROSS JOIN nv
         WHERE bi.c_ab > {PHRASE_MIN_COUNT}
           AND CAST(bi.c_ab - {PHRASE_MIN_COUNT} AS DOUBLE) * nv.n / CAST(ua.c * ub.c AS DOUBLE) > {PHRASE_THRESHOLD})"""


def _run_tokens(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(RUN), 1).alias("tokens"))


@register("phrase_scores", f"""
WITH {PHRASE_BASE_SQL}
SELECT a || ' ' || b AS phrase, CAST(c_a AS BIGINT) AS c_a, CAST(c_b AS BIGINT) AS c_b,
       CAST(c_ab AS BIGINT) AS c_ab, round(score, 6) AS score FROM ph""")
def phrase_scores(spark, sf):
    out = FT.phrase_scores(_run_tokens(spark, sf), "tokens")
    return out.select("phrase", "c_a", "c_b", "c_ab", r6("score").alias("score"))


@register("merge_phrases", f"""
WITH {PHRASE_BASE_SQL},
  flags AS (SELECT p.doc_id, p.i, (ph.a IS NOT NULL) AS f
            FROM pairs p LEFT JOIN ph ON p.a = ph.a AND p.b = ph.b),
  isl AS (SELECT doc_id, i, f, i - row_number() OVER (PARTITION BY doc_id, f ORDER BY i) AS g FROM flags),
  st AS (SELECT doc_id, i, f AND (i - min(i) OVER (PARTITION BY doc_id, f, g)) % 2 = 0 AS ms FROM isl),
  toks AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS p FROM tok),
  m AS (SELECT k.doc_id, k.p,
               CASE WHEN coalesce(s.ms, false) THEN k.t[k.p] || '_' || k.t[k.p + 1] ELSE k.t[k.p] END AS v,
               coalesce(prev.ms, false) AS consumed
        FROM toks k
        LEFT JOIN st s ON s.doc_id = k.doc_id AND s.i = k.p
        LEFT JOIN st prev ON prev.doc_id = k.doc_id AND prev.i = k.p - 1)
SELECT d.doc_id, coalesce(string_agg(m.v, ' ' ORDER BY m.p), '') AS merged
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND NOT m.consumed
GROUP BY d.doc_id""")
def merge_phrases(spark, sf):
    toks = materialize(_run_tokens(spark, sf), "tokens")   # tokenised once, read by three steps
    phrases = FT.phrase_scores(toks, "tokens")
    out = X.merge_phrases(toks, "tokens", phrases, "doc_id", "merged_tokens")
    return out.select("doc_id", T.join_tokens("merged_tokens").alias("merged"))


# ------------------------------------------------------------------ neighbours

SEEDS_SQL = """
  seeds AS (SELECT e.vec_id AS seed_id, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e
            JOIN (SELECT label, min(vec_id) AS seed_id FROM embeddings GROUP BY label) s
              ON e.vec_id = s.seed_id),
  ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  p AS (SELECT CAST(seeds.seed_id AS VARCHAR) AS seed, CAST(ev.vec_id AS VARCHAR) AS neighbor,
               round(list_dot_product(seeds.v, ev.v)
                     / (sqrt(list_dot_product(seeds.v, seeds.v)) * sqrt(list_dot_product(ev.v, ev.v))), 6)
                 AS similarity
        FROM seeds CROSS JOIN ev WHERE seeds.seed_id <> ev.vec_id),
  topk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, neighbor)
                                      AS BIGINT) AS rank FROM p) WHERE rank <= """ + str(NEIGHBOURS_PER_SEED) + ")"


def _neighbours(spark, sf):
    emb = table(spark, sf, "embeddings")
    seed_ids = emb.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    seeds = emb.join(seed_ids.select("vec_id"), "vec_id", "left_semi").select(
        F.col("vec_id").cast("string").alias("seed"), "embedding")
    return S.similar_topk(emb, seeds, NEIGHBOURS_PER_SEED, word_col="vec_id", vec_col="embedding")


@register("similar_topk", f"WITH {SEEDS_SQL} SELECT seed, neighbor, similarity, rank FROM topk")
def similar_topk(spark, sf):
    return _neighbours(spark, sf)


@register("similar_topk_table", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  p AS (SELECT CAST(a.vec_id AS VARCHAR) AS seed, CAST(b.vec_id AS VARCHAR) AS neighbor,
               round(list_dot_product(a.v, b.v)
                     / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT seed, neighbor, similarity, CAST(row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, neighbor)
       AS BIGINT) AS rank FROM p QUALIFY rank <= """ + str(NEIGHBOURS_PER_SEED))
def similar_topk_table(spark, sf):
    """A seed table that grows with the data (every hundredth vector): blocks, nothing inlined."""
    emb = table(spark, sf, "embeddings")
    seeds = emb.filter("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("seed"), "embedding")
    return S.similar_topk(emb, seeds, NEIGHBOURS_PER_SEED, word_col="vec_id", vec_col="embedding", inline=0)


@register("expand_features", f"""
WITH {SEEDS_SQL}
SELECT DISTINCT feature, similarity FROM (
  SELECT unnest({sql_list(sorted(SEED_PHRASES))}) AS feature, CAST(NULL AS DOUBLE) AS similarity
  UNION ALL SELECT neighbor AS feature, similarity FROM topk)""")
def expand_features(spark, sf):
    return S.expand_features(_neighbours(spark, sf), SEED_PHRASES)


@register("sorted_neighbours", f"""
WITH {SEEDS_SQL}
SELECT feature, similarity FROM (SELECT DISTINCT feature, similarity FROM (
  SELECT unnest({sql_list(sorted(SEED_PHRASES))}) AS feature, CAST(NULL AS DOUBLE) AS similarity
  UNION ALL SELECT neighbor AS feature, similarity FROM topk)) ORDER BY similarity DESC NULLS LAST, feature""")
def sorted_neighbours(spark, sf):
    """The expanded features by falling similarity."""
    return S.sorted_neighbours(S.expand_features(_neighbours(spark, sf), SEED_PHRASES))


@register("seed_in_vocab", f"""
SELECT DISTINCT w AS seed FROM (SELECT unnest(regexp_extract_all(lower(text), {WORD}, 1)) AS w FROM documents)
WHERE w IN ({", ".join(sq(s) for s in sorted(set(S.seed_words(SEED_PHRASES)) | set(TEST_SEEDS)))})""")
def seed_in_vocab(spark, sf):
    vocab = _doc_terms(spark, sf).select(F.col("term").alias("word"))
    seeds = sorted(set(S.seed_words(SEED_PHRASES)) | set(TEST_SEEDS))
    return S.seeds_in_vocabulary(vocab, seeds)


@register("mean_pool", """
SELECT label, CAST(i - 1 AS BIGINT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean
FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
GROUP BY label, i""")
def mean_pool(spark, sf):
    out = FT.mean_pool(table(spark, sf, "embeddings"), "label", "embedding")
    return out.select("label", F.col("pos").cast("bigint").alias("pos"), r6("mean").alias("mean"))


@register("term_log_odds", f"""
WITH lab AS (SELECT l.doc_id, l.quality AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
  dt AS (SELECT DISTINCT doc_id, w AS term
         FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORD}, 1)) AS w FROM documents)),
  per AS (SELECT term, count(*) FILTER (WHERE label = 1) AS a1, count(*) FILTER (WHERE label <> 1) AS a0
          FROM dt JOIN lab USING (doc_id) GROUP BY term),
  cls AS (SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label <> 1) AS n0 FROM lab)
SELECT term, CAST(a1 AS BIGINT) AS docs_pos, CAST(a0 AS BIGINT) AS docs_neg,
       round(CASE WHEN n1 > 0 THEN a1 / n1 ELSE 0 END, 6) AS rate_pos,
       round(CASE WHEN n0 > 0 THEN a0 / n0 ELSE 0 END, 6) AS rate_neg,
       round(ln((a1 + 0.5) / (n1 - a1 + 0.5)) - ln((a0 + 0.5) / (n0 - a0 + 0.5)), 6) AS log_odds
FROM per, cls""")
def term_log_odds(spark, sf):
    docs = _docs(spark, sf)
    labs = (table(spark, sf, "labels").join(docs.select("doc_id"), "doc_id")
            .select("doc_id", F.col("quality").alias("label")))
    out = M.term_log_odds(_doc_terms(spark, sf), labs)
    return out.select("term", "docs_pos", "docs_neg", r6("rate_pos").alias("rate_pos"),
                      r6("rate_neg").alias("rate_neg"), r6("log_odds").alias("log_odds"))


# ------------------------------------------------------------------ PPMI expansion

PPMI_SQL = f"""
  tok AS (SELECT doc_id, regexp_extract_all(lower(text), {WORD}, 1) AS t FROM documents),
  pos AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM tok),
  pairs AS (SELECT t[i] AS w, t[i + d] AS c FROM pos, range(1, {W2V_WINDOW + 1}) AS r(d) WHERE i + d <= len(t)
            UNION ALL
            SELECT t[i + d] AS w, t[i] AS c FROM pos, range(1, {W2V_WINDOW + 1}) AS r(d) WHERE i + d <= len(t)),
  cnt AS (SELECT w, c, count(*) AS n FROM pairs GROUP BY w, c),
  tot AS (SELECT sum(n) AS total FROM cnt),
  marg AS (SELECT w, sum(n) AS n_w FROM cnt GROUP BY w),
  pm AS (SELECT cnt.w, cnt.c, ln(CAST(cnt.n AS DOUBLE) * tot.total / CAST(mw.n_w * mc.n_w AS DOUBLE)) AS ppmi
         FROM cnt JOIN marg mw ON mw.w = cnt.w JOIN marg mc ON mc.w = cnt.c CROSS JOIN tot),
  pp AS (SELECT * FROM pm WHERE ppmi > 0),
  nrm AS (SELECT w, sqrt(sum(ppmi * ppmi)) AS nw FROM pp GROUP BY w),
  sd AS (SELECT w AS seed, c, ppmi AS sv FROM pp WHERE w IN ({", ".join(sq(s) for s in sorted(TEST_SEEDS))})),
  dots AS (SELECT sd.seed, pp.w, sum(pp.ppmi * sd.sv) AS dot FROM pp JOIN sd ON pp.c = sd.c GROUP BY sd.seed, pp.w),
  sims AS (SELECT dots.seed, dots.w AS neighbor, round(dot / (a.nw * b.nw), 6) AS similarity
           FROM dots JOIN nrm a ON a.w = dots.w JOIN nrm b ON b.w = dots.seed WHERE dots.seed <> dots.w),
  topk AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, neighbor)
                                      AS BIGINT) AS rank FROM sims) WHERE rank <= {NEIGHBOURS_PER_SEED})"""


def _ppmi_neighbours(spark, sf):
    toks = _docs(spark, sf).select(T.tokenize_word("text").alias("tokens"))
    coded, words = CO.code_words(toks, "tokens")
    weights = CO.ppmi(CO.cooccurrence_counts(coded, "tokens", W2V_WINDOW))
    seeds = [r.idx for r in words.filter(F.col("word").isin(list(TEST_SEEDS))).collect()]
    return CO.name_words(CO.ppmi_neighbors(weights, seeds, NEIGHBOURS_PER_SEED), words, "seed", "neighbor")


@register("expand_ppmi", f"WITH {PPMI_SQL} SELECT seed, neighbor, similarity, rank FROM topk")
def expand_ppmi(spark, sf):
    """Seed words' nearest words by PPMI cosine (deterministic expansion)."""
    return _ppmi_neighbours(spark, sf)


@register("expand_svd")
def expand_svd(spark, sf):
    """Seed words' nearest words by a low-rank factor of the PPMI table."""
    toks = _docs(spark, sf).select(T.tokenize_word("text").alias("tokens"))
    coded, words = CO.code_words(toks, "tokens", W2V_MIN_COUNT)
    vecs = LR.low_rank_vectors(CO.ppmi(CO.cooccurrence_counts(coded, "tokens", W2V_WINDOW)), words=words)
    seeds = vecs.filter(F.col("word").isin(list(TEST_SEEDS))).select(F.col("word").alias("seed"), "vector")
    return S.similar_topk(vecs, seeds, NEIGHBOURS_PER_SEED)


@register("expansion_label", f"""
WITH {PPMI_SQL},
  feats AS (SELECT DISTINCT feature FROM (
              SELECT unnest({sql_list(sorted(TEST_SEEDS))}) AS feature UNION ALL SELECT neighbor FROM topk))
SELECT doc_id, {"CAST(1 + doc_id % 5 AS DOUBLE)"} AS rating,
       CAST(CAST(1 + doc_id % 5 AS DOUBLE) = 5 AND EXISTS (
            SELECT 1 FROM feats WHERE contains(array_to_string(regexp_extract_all(lower(d.text), {WORD}, 1), ' '),
                                               feats.feature)) AS BIGINT) AS is_inducing
FROM documents d""")
def expansion_label(spark, sf):
    """Seeds widened by their PPMI neighbours, then the feature label
    (rating 5 and any feature in the processed text)."""
    from ..operators import label as L
    feats = S.expand_features(_ppmi_neighbours(spark, sf), TEST_SEEDS)
    d = rated_documents(spark, sf).withColumn("processed", T.join_tokens(T.tokenize_word("text")))
    return L.feature_label(d, text_col="processed", rating_col="rating", features=feats).select(
        "doc_id", "rating", "is_inducing")


@register("positional_zip", f"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, t[i] AS term, CAST(length(t[i]) AS BIGINT) AS value
FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(lower(text), {WORD}, 1) AS t FROM documents))""")
def positional_zip(spark, sf):
    """Token names paired by position with a per-token value (its length)."""
    from ..operators import model as MD
    d = _docs(spark, sf).select("doc_id", T.tokenize_word("text").alias("t"))
    d = d.select("doc_id", "t", F.transform("t", lambda x: F.length(x).cast("bigint")).alias("v"))
    return MD.positional_zip_arrays(d, "doc_id", "t", "v")
