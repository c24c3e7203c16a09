"""End-to-end flows: the original scripts' stages as DataFrame-to-DataFrame calls.

* :func:`rule_labelled_reviews` - read collected reviews, resolve dates, drop
  empty and machine-translated reviews, label promotions (rating 5 AND a
  promotion pattern), clean and tokenise.
* :func:`expansion_labelled_reviews` - the seed-expansion labelling: phrases
  mined and merged, neighbours of the seed words (Word2Vec or PPMI), label by
  "rating 5 AND any expanded feature in the text".
* :func:`train_and_evaluate` - split, featurise (fit on the training rows),
  train, predict, six-metric report and the top words.

Each step is an operator from :mod:`reviewlens.operators`; nothing here is
collected except bounded configuration (seed vectors, feature lists).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .config import MORE_TOKEN, PHRASE_DELIMITER, SEED_PHRASES, TOP_WORDS, W2V_MIN_COUNT, W2V_WINDOW
from .functions import text as T
from .operators import cooccurrence as CO
from .operators import embed as E
from .operators import features as FT
from .operators import label as L
from .operators import low_rank as LR
from .operators import metrics as M
from .operators import model as MD
from .operators import similarity as S
from .operators import split as SP
from .operators import text_ops as X
from .schema import RAW_REVIEWS, parse_scrape_time
from .session import materialize
from .sources import files as FS


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Collected reviews from CSV (header, quoted multi-line fields).

    The scrape time is stored as ``yyyy/MM/dd HH:mm:ss`` text and parsed
    after the read; the other columns take their ``RAW_REVIEWS`` types.
    """
    as_text = StructType([StructField(f.name, StringType() if f.name == "ScrapeTime" else f.dataType)
                          for f in RAW_REVIEWS.fields])
    return parse_scrape_time(FS.read_csv(spark, path, as_text))


def read_stopwords(spark: SparkSession, path: str | None) -> list[str]:
    """Stop words from a one-per-line file (configuration, collected once)."""
    return [r[0] for r in FS.read_lines(spark, path).collect()] if path else []


def rule_labelled_reviews(raw: DataFrame, stopwords: Iterable[str] = (), tokenizer="cjk_ngram",
                          keep_empty: bool = True) -> DataFrame:
    """Cleaned reviews labelled by the promotion rule (schema ``CLEANED_REVIEWS``)."""
    return X.clean_review_table(raw, stopwords=stopwords, tokenizer=tokenizer, keep_empty=keep_empty)


def expansion_labelled_reviews(raw: DataFrame, stopwords: Iterable[str] = (),
                               seed_phrases: Iterable[str] = SEED_PHRASES, provider: str = "word2vec",
                               tokenizer="cjk_ngram", epochs: int | None = None,
                               merge: bool = True) -> DataFrame:
    """Cleaned reviews labelled by seed phrases widened with neighbour words.

    Tokens of the processed text are merged into phrases (mined on the same
    text; ``merge=False`` leaves that step out), neighbours of every known seed
    word are found with ``provider`` ('word2vec', or the deterministic 'ppmi' and 'svd'),
    and a review is labelled when its rating is 5 and its processed text
    contains any feature.  Mined phrases match the text with a space at the
    joint.
    """
    cleaned = X.clean_review_table(raw, stopwords=stopwords, tokenizer=tokenizer, keep_empty=False,
                                   drop_token=MORE_TOKEN, with_restaurant=True).drop("IsInducing")
    # ids are written once with the rows: recomputed ids could move after a shuffle
    keyed = materialize(cleaned.withColumn("__id", F.monotonically_increasing_id()), "keyed_reviews")
    toks = materialize(keyed.select("__id", T.tokenize_whitespace("ProcessedReview").alias("tokens")), "tokens")
    if merge:
        merged = X.merge_phrases(toks, "tokens", FT.phrase_scores(toks, "tokens"), "__id", "merged")
    else:
        merged = toks.withColumnRenamed("tokens", "merged")
    words = S.seed_words(seed_phrases)
    if provider == "ppmi":
        # same vocabulary rule as the embedding trainer: words seen < min count are dropped
        counts = CO.cooccurrence_counts(merged, "merged", W2V_WINDOW, min_count=W2V_MIN_COUNT)
        neighbours = CO.ppmi_neighbors(CO.ppmi(counts), words)
    else:
        if provider == "svd":
            vecs = LR.low_rank_vectors(CO.ppmi(CO.cooccurrence_counts(
                merged, "merged", W2V_WINDOW, min_count=W2V_MIN_COUNT)))
        else:
            kwargs = {"epochs": epochs} if epochs else {}
            vecs = E.word_vectors(E.train_word2vec(merged, "merged", **kwargs))
        known = S.seeds_in_vocabulary(vecs, words)
        seeds = vecs.join(known.select(F.col("seed").alias("word")), "word").select(
            F.col("word").alias("seed"), "vector")
        neighbours = S.similar_topk(vecs, seeds)
    features = S.expand_features(neighbours, seed_phrases).select("feature")
    labelled = L.feature_label(keyed, text_col="ProcessedReview", rating_col="ReviewRating",
                               features=features, label_col="IsInducing", id_col="__id",
                               delimiter_as_space=PHRASE_DELIMITER if merge else None)
    return labelled.select("RestName", "ReviewActualDate", "Reviewer", "ReviewRating", "ProcessedReview",
                           F.col("IsInducing").cast("int").alias("IsInducing"))


def train_and_evaluate(cleaned: DataFrame, kind: str = "rf", features: str = "tfidf",
                       text_col: str = "ProcessedReview", label_col: str = "IsInducing",
                       id_col: str | None = None, grid: dict | None = None, top_k: int = TOP_WORDS):
    """80/20 split, fit features and a classifier on the training rows,
    predict the test rows.  Returns (six-metric row, predictions, top words
    or None); ``grid`` runs the random-forest cross-validated search."""
    df = X.fill_text(cleaned, text_col)
    if id_col is None:
        id_col = "__id"
        df = materialize(df.withColumn(id_col, F.monotonically_increasing_id()), "keyed_reviews")
    df = df.withColumn("label", F.col(label_col).cast("double")).withColumn("tokens", T.tokenize_word(text_col))
    data = SP.exact_split(df, id_col)
    train, test = data.filter("is_test = 0"), data.filter("is_test = 1")
    if grid is not None:
        folds = SP.stratified_folds(train, id_col, "label", 5)
        found, feats = MD.rf_grid_search(folds, grid, id_col=id_col)
        model = found.bestModel
        pred = model.transform(feats.transform(test, id_col))
    else:
        pred, model, feats = MD.train_and_predict(train, test, kind, features, id_col)
    report = M.classification_metrics(pred.select("label", "prediction"))
    top = MD.top_importances(model, feats, top_k) if kind == "rf" else None
    return report, pred, top
