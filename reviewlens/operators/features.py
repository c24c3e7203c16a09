"""Text features as long tables: bag of words, vocabulary, IDF, TF-IDF,
phrase statistics and vector pooling.

The sparse document x term matrix is held as ``(doc_id, term, value)`` rows;
``SparseVector`` appears only at the ML boundary (see ``model.py``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PHRASE_DELIMITER, PHRASE_MIN_COUNT, PHRASE_THRESHOLD
from ..functions import text as T
from ..functions.text import let
from ..session import materialize
from .ordering import dense_index


def doc_terms(df: DataFrame, id_col: str, tokens: Column, tf_col: str = "tf") -> DataFrame:
    """Bag of words: one row per (document, term) with its count.

    Explode + count with map-side partial aggregation.  When the input is
    already hash-partitioned by document (see ``session.spread``) the
    aggregate needs no further shuffle.
    """
    return (df.select(F.col(id_col), F.explode(tokens).alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias(tf_col)))


def bow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Vectoriser bag of words over the word tokeniser.

    Whole texts are dealt by document before they are cut into terms: a text is
    smaller than its (document, term) rows, and the count needs no further shuffle.
    """
    dealt = df.select(id_col, text_col).repartition(id_col)
    return doc_terms(dealt, id_col, T.tokenize_word(F.col(text_col)))


def bow_fixed_terms(df: DataFrame, id_col: str, text_col: str, terms: Iterable[str],
                    prefix: str = "tf_") -> DataFrame:
    """Wide doc x term counts for a short, fixed term list (every document kept).

    Each count is a per-row expression, so there is no pivot and no shuffle.
    """
    def equals(word):
        return lambda t: t == word

    toks = df.select(id_col, T.tokenize_word(F.col(text_col)).alias("__t"))
    return toks.select(id_col, *[
        F.size(F.filter("__t", equals(w))).cast("bigint").alias(f"{prefix}{w}") for w in terms])


def vocabulary(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """Distinct terms with a dense 0-based index in term order."""
    distinct = terms.select(term_col).distinct()
    return dense_index(distinct, [term_col], "idx")


def document_frequency(doc_term: DataFrame) -> DataFrame:
    """Documents per term.  (doc, term) pairs are unique, so a plain count."""
    return doc_term.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def smoothed_idf(df_col: Column, n_docs: Column) -> Column:
    """``ln((1 + n) / (1 + df)) + 1`` - the smoothed IDF with the +1 term."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def idf(doc_term: DataFrame, n_docs: Column) -> DataFrame:
    return document_frequency(doc_term).withColumn("idf", smoothed_idf(F.col("df"), n_docs))


def tfidf(doc_term: DataFrame, n_docs: Column, id_col: str = "doc_id") -> DataFrame:
    """Raw tf x smoothed idf, L2-normalised per document.

    The idf side is vocabulary-sized; adaptive execution broadcasts it when
    its runtime size is under the threshold and otherwise splits hot term
    partitions of the sort-merge join.  The norm is a window partitioned by
    document (one document is bounded by its text).  The counts are written in
    term order, task by task, so that equal terms lie side by side in the files
    and in the join's shuffle, where they compress to little.
    """
    # counted once, read for idf and for weights
    doc_term = materialize(doc_term.sortWithinPartitions("term"), "doc_terms")
    weights = (doc_term.join(idf(doc_term, n_docs).select("term", "idf"), "term")
               .select(id_col, "term", (F.col("tf") * F.col("idf")).alias("__w")))
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(id_col)))
    return weights.select(id_col, "term", (F.col("__w") / norm).alias("weight"))


def top_terms(weights: DataFrame, k: int = 10, value_col: str = "weight") -> DataFrame:
    """Terms with the largest summed value; ties keep term order."""
    return (weights.groupBy("term").agg(F.sum(value_col).alias("total"))
            .orderBy(F.col("total").desc(), F.col("term")).limit(k))


def gamma_scale(doc_term: DataFrame, n_docs: Column, value_col: str = "tf") -> DataFrame:
    """``1 / (V * var(X))`` with the variance over all n x V entries (zeros too)."""
    s = doc_term.agg(F.sum(value_col).cast("double").alias("s1"),
                     F.sum(F.col(value_col) * F.col(value_col)).cast("double").alias("s2"),
                     F.countDistinct("term").alias("v"))
    cells = n_docs.cast("double") * F.col("v")
    var = F.col("s2") / cells - F.pow(F.col("s1") / cells, 2)
    return s.select(n_docs.cast("bigint").alias("n_docs"), F.col("v").alias("n_terms"),
                    var.alias("variance"), F.try_divide(F.lit(1.0), F.col("v") * var).alias("gamma"))


def ngram_counts(tokens_df: DataFrame, tokens_col: str) -> DataFrame:
    """Counts of (a, b) for every token a and its successor b (null at the end).

    One explode of ``arrays_zip(tokens, next tokens)`` and one aggregate give
    both bigram counts (b not null) and, summed over b, unigram counts.
    """
    def with_next(toks):
        nxt = F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0)))
        return F.arrays_zip(toks.alias("a"), nxt.alias("b"))

    z = tokens_df.select(F.explode(let(F.col(tokens_col), with_next)).alias("p"))
    return z.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("c"))


def phrase_scores(tokens_df: DataFrame, tokens_col: str, min_count: int = PHRASE_MIN_COUNT,
                  threshold: float = PHRASE_THRESHOLD, delimiter: str = PHRASE_DELIMITER) -> DataFrame:
    """Bigram phrase detection by the original score of Mikolov et al. (2013).

    ``score = (c_ab - min_count) * N / (c_a * c_b)`` with N = distinct
    unigrams + distinct adjacent bigrams; a pair is a phrase when score >
    threshold.  The (a, next) counts are taken in one pass and written once,
    then unigram counts, N and the two unigram joins read that table.
    """
    counts = materialize(ngram_counts(tokens_df, tokens_col), "ngram_counts")
    uni = counts.groupBy("a").agg(F.sum("c").alias("c_a"))
    bi = counts.filter(F.col("b").isNotNull()).select("a", "b", F.col("c").alias("c_ab"))
    n_vocab = uni.select(F.count(F.lit(1))).scalar() + bi.select(F.count(F.lit(1))).scalar()
    cb = uni.select(F.col("a").alias("b"), F.col("c_a").alias("c_b"))
    scored = (bi.filter(F.col("c_ab") > min_count)
              .join(uni, "a").join(cb, "b")
              .withColumn("score", (F.col("c_ab") - min_count).cast("double") * n_vocab
                          / (F.col("c_a") * F.col("c_b")).cast("double")))
    return (scored.filter(F.col("score") > threshold)
            .select(F.concat_ws(" ", "a", "b").alias("phrase"),
                    F.concat_ws(delimiter, "a", "b").alias("merged"),
                    "a", "b", F.col("c_a").cast("bigint").alias("c_a"),
                    F.col("c_b").cast("bigint").alias("c_b"), "c_ab", "score"))


def mean_pool(vectors: DataFrame, group_col: str, vec_col: str) -> DataFrame:
    """Element-wise mean of vectors per group, as (group, pos, mean) rows.

    Positions are exploded and averaged with partial aggregation, so a hot
    group is combined map-side and no group's vectors are collected.
    """
    return (vectors.select(group_col, F.posexplode(vec_col).alias("pos", "x"))
            .groupBy(group_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean")))
