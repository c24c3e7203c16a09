"""Registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from ..session import scratch_path
from .anchor_dedup import remove_repeats
from .common import load
from .decontaminate import leaks
from .hard_negatives import hard_negatives
from .hpylm import score_documents
from .jaccard_join import similarity_groups
from .line_spread import remove_common_lines
from .mixing import Mix
from .outlier_rules import quality_verdicts
from .page_text import main_texts
from .site_quality import site_posteriors
from .spelling_variants import spelling_variants
from .token_files import read_token_files, write_token_files
from .toxicity import toxicity_scores

#: id that closes every document in the token files
END_ID = 2

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_substring_dedup(spark, sf_dir):
    """Words of 13-word repeats of earlier documents removed from every document."""
    return remove_repeats(load(spark, sf_dir, "documents")).drop("kept_text")


@query
def op5_ngram_jaccard_join(spark, sf_dir):
    """Shingle set size, near-duplicate class and component, and number of links of every document."""
    return similarity_groups(load(spark, sf_dir, "documents")).drop("row_key")


@query
def op4_token_binary(spark, sf_dir):
    """Every document encoded into bit-packed files, and read back from them."""
    import public_tokenizers
    path = write_token_files(load(spark, sf_dir, "documents"), scratch_path(spark, "token-files"),
                             public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return read_token_files(spark, path)


@query
def op9_source_mixing(spark, sf_dir):
    """Words of every document that a mix of the sources to their target weights takes."""
    return Mix(load(spark, sf_dir, "documents")).taken().select(
        "doc_id", "size", "source_size", "target", "taken", "source")


@query
def op7_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity_scores(load(spark, sf_dir, "documents"),
                           load(spark, sf_dir, "labels")).drop("row_key")


@query
def op8_quality_rules(spark, sf_dir):
    """Base statistics of every document and the robust-outlier verdict."""
    return quality_verdicts(load(spark, sf_dir, "documents"))


@query
def op2_benchmark_decontamination(spark, sf_dir):
    """Documents into which benchmark items leak, with the best window of each item."""
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("row_key")


@query
def op1_hpylm_scoring(spark, sf_dir):
    """Log-probability of every document under the hierarchical Pitman-Yor model."""
    return score_documents(load(spark, sf_dir, "documents"))


@query
def op3_site_quality(spark, sf_dir):
    """Quality posterior of every document from its text, host (source) and path (language)."""
    return site_posteriors(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op6_line_dedup(spark, sf_dir):
    """Lines that stand on many sources removed from every document."""
    return remove_common_lines(load(spark, sf_dir, "documents")).drop("kept_text")


@query
def op11_html_extraction(spark, sf_dir):
    """Main text of every page by the wrapper of its host."""
    return main_texts(load(spark, sf_dir, "pages"))


@query
def op12_spelling_variants(spark, sf_dir):
    """Frequent words with their more frequent near word, root and number of near words."""
    return spelling_variants(load(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of every anchor and positive."""
    return hard_negatives(load(spark, sf_dir, "embeddings"))


# --- oracles: DuckDB SQL for the results that SQL can state ----------------------

_WORD = r"'[^\x20\x09-\x0D]+'"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op10_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS t FROM documents),
  g AS (SELECT doc_id, i, t[i:i + 12] AS g FROM w, unnest(range(1, len(t) - 11)) AS u(i)),
  f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
  c AS (SELECT DISTINCT g.doc_id, g.i + k AS p FROM g JOIN f USING (g), range(13) AS r(k)
        WHERE f.first < g.doc_id),
  m AS (SELECT x.doc_id, x.p, x.word, c.p IS NOT NULL AS gone
        FROM (SELECT doc_id, p, t[p] AS word FROM w, unnest(range(1, len(t) + 1)) AS u(p)) x
        LEFT JOIN c USING (doc_id, p)),
  o AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM m),
  a AS (SELECT doc_id, count_if(gone) AS n_removed, count_if(opens) AS n_spans,
               string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM o GROUP BY doc_id)
SELECT w.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)"""

ORACLES["op5_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_WORD}) AS t FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(t) >= 5 THEN list_distinct(list_transform(range(1, len(t) - 3),
               lambda i: array_to_string(t[i:i + 4], ' ')))
               WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g FROM w),
  e AS (SELECT doc_id, unnest(g) AS g FROM s),
  n AS (SELECT doc_id, len(g) AS n FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY 1, 2),
  l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
        WHERE 100 * c >= 80 * (x.n + y.n - c)),
  reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.r)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id,
       least(n.doc_id, coalesce(twin, n.doc_id)) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links
FROM n JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS twin FROM l WHERE same GROUP BY a) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM l GROUP BY a) USING (doc_id)"""

ORACLES["op6_line_dedup"] = r"""
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS t FROM documents),
  x AS (SELECT doc_id, source, p, t[p] AS line FROM l, unnest(range(1, len(t) + 1)) AS u(p)),
  c AS (SELECT line FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line
        HAVING count(DISTINCT coalesce(source, 'no source')) >= 8)
SELECT doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
       sha256(coalesce(string_agg(x.line, chr(10) ORDER BY p) FILTER (c.line IS NULL), '')) AS kept_sha256
FROM x LEFT JOIN c USING (line) GROUP BY doc_id"""

ORACLES["op2_benchmark_decontamination"] = f"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), {_WORD}) AS t FROM benchmark),
  ig AS (SELECT item_id, len(t) - 4 AS n, q - 1 AS q, t[q:q + 4] AS g FROM iw, unnest(range(1, len(t) - 3)) AS u(q)),
  dw AS (SELECT doc_id, regexp_extract_all(lower(text), {_WORD}) AS t FROM documents),
  dg AS (SELECT doc_id, len(t) - 4 AS m, p - 1 AS p, t[p:p + 4] AS g FROM dw, unnest(range(1, len(t) - 3)) AS u(p)),
  a AS (SELECT DISTINCT doc_id, item_id, n, m, p - q AS s FROM dg JOIN ig USING (g)),
  c AS (SELECT DISTINCT doc_id, item_id, n, m, greatest(0, least(s + d, m - n)) AS s FROM a, (VALUES (-1), (0), (1)) v(d)),
  h AS (SELECT c.doc_id, c.item_id, c.n, c.m, c.s, dg.g, count(*) AS there FROM c JOIN dg
          ON dg.doc_id = c.doc_id AND dg.p >= c.s AND dg.p < c.s + c.n GROUP BY ALL),
  k AS (SELECT item_id, g, count(*) AS here FROM ig GROUP BY ALL),
  z AS (SELECT doc_id, item_id, s, n, least(n, m) AS size, sum(least(here, there)) AS shared
        FROM h JOIN k USING (item_id, g) GROUP BY ALL),
  r AS (SELECT doc_id, item_id, s, shared / (size + n - shared) AS similarity,
               max(shared / (size + n - shared)) OVER (PARTITION BY doc_id, item_id) AS best
        FROM z WHERE 100 * shared >= 80 * (size + n - shared))
SELECT doc_id, item_id, CAST(max(best) AS DOUBLE) AS similarity,
       CAST(min(s) FILTER (similarity = best) AS INTEGER) AS start, count(*) AS windows
FROM r GROUP BY doc_id, item_id"""

_CRC_TABLE = """SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))"""
_BYTES = """list_transform(range(1, 1 + octet_length(encode(k))),
      lambda i: CAST(('0x' || hex(encode(k))[2 * i - 1:2 * i]) AS BIGINT))"""

ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
  x AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents),
  d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS k, r, count(*) AS n
        FROM x WHERE length(r) >= 6 GROUP BY ALL),
  h AS (SELECT r, n, xor(list_reduce(list_prepend(4294967295, {_BYTES}),
        lambda c, b: xor(c >> 8, t[1 + xor(c, b) % 256])), 4294967295) AS h FROM d, tab),
  m AS (SELECT CASE WHEN h % 199 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM h),
  w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  v AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS rest FROM w, unnest(range(1, length(word) + 1)) AS u(p)),
  o AS (SELECT a.word, b.word AS near, b.n FROM v a JOIN v b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word
        UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
  c AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'near': near}}) AS top FROM o GROUP BY word),
  f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.n >= 5 * w.n THEN top.near END AS form,
               CASE WHEN -top.n >= 5 * w.n THEN -top.n END AS form_n FROM w LEFT JOIN c USING (word)),
  g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root
        WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g USING (word) JOIN f e ON e.word = g.root
WHERE e.form IS NULL"""

ORACLES["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.*, other AS negative_id, score AS negative_score, CAST(row_number() OVER (
    PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
