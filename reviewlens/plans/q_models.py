"""Registered queries with learned results.

Predictions on real labels are returned as they are, without an oracle.  The
``*_word`` queries learn a target that the features decide (a document holds a
word), where every learner has to predict the label of each test row.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..config import RF_FOLDS, SEED_PHRASES, TOP_WORDS
from ..functions import text as T
from ..operators import embed as E
from ..operators import features as FT
from ..operators import metrics as M
from ..operators import model as MD
from ..operators import split as SP
from ..operators.ordering import dense_index
from ..operators.similarity import seed_words
from ..session import materialize
from .registry import r6, register, sq
from .tables import TEST_SEEDS, table


WORD = sq(T.WORD_TOKEN)
HASH_SQL = "('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT"
#: the exact split over the labelled documents
SPLIT_SQL = f"""s AS (
  SELECT doc_id, CAST(quality AS BIGINT) AS quality,
         row_number() OVER (ORDER BY {HASH_SQL}, doc_id) <= ceil(0.2 * count(*) OVER ()) AS is_test
  FROM documents JOIN labels USING (doc_id))"""

def _labelled(spark, sf):
    """documents with a label, word tokens and an exact 80/20 split, written once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    joined = docs.join(lab, "doc_id").withColumn("tokens", T.tokenize_word("text"))
    rows = joined.select("doc_id", "tokens", F.col("quality").cast("double").alias("label"))
    return materialize(SP.exact_split(rows, "doc_id"), "labelled")


def _sides(data):
    return data.filter(F.col("is_test") == 0), data.filter(F.col("is_test") == 1)


def _predict(spark, sf, kind, feature_kind="tfidf", **params):
    pred, _, _ = MD.train_and_predict(*_sides(_labelled(spark, sf)), kind, feature_kind, "doc_id", **params)
    return pred


def _scored(pred):
    return pred.select("doc_id", F.col("label").cast("bigint").alias("label"),
                       F.col("prediction").cast("bigint").alias("prediction"))


@register("rf_model")
def rf_model(spark, sf):
    return _scored(_predict(spark, sf, "rf"))


@register("tree_model")
def tree_model(spark, sf):
    return _scored(_predict(spark, sf, "tree"))


@register("gbt_model")
def gbt_model(spark, sf):
    return _scored(_predict(spark, sf, "gbt"))


@register("mlp_model")
def mlp_model(spark, sf):
    return _scored(_predict(spark, sf, "mlp"))


@register("svm_linear")
def svm_linear(spark, sf):
    return _scored(_predict(spark, sf, "svm", feature_kind="bow"))


@register("svm_tfidf")
def svm_tfidf(spark, sf):
    return _scored(_predict(spark, sf, "svm", feature_kind="tfidf"))


REPORT = ("accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision", "score_auc", "score_ap")


@register("model_report")
def model_report(spark, sf):
    """Six metrics of a model's test predictions, and AUC and AP of its scores."""
    pred = materialize(_predict(spark, sf, "tree").select(
        "label", "prediction", vector_to_array("probability")[1].alias("score")), "predictions")
    curve = M.score_auc(pred).select(F.col("roc_auc").alias("score_auc"), F.col("avg_precision").alias("score_ap"))
    both = M.classification_metrics(pred).join(F.broadcast(curve))        # one row each
    return both.select("tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in REPORT))


@register("svm_rff")
def svm_rff(spark, sf):
    """RBF-kernel SVM approximated by random Fourier features + linear SVM;
    gamma = 1 / (V * var(X)) over the training bag-of-words."""
    return _scored(_rff_predictions(_labelled(spark, sf)))


def _rff_predictions(data, **params):
    bag = FT.doc_terms(data, "doc_id", F.col("tokens"))
    train_ids = data.filter(F.col("is_test") == 0).select("doc_id")
    g = FT.gamma_scale(bag.join(train_ids, "doc_id", "left_semi"),
                       train_ids.select(F.count(F.lit(1))).scalar()).first()["gamma"]
    terms = bag.groupBy("doc_id").agg(F.collect_list(F.struct(
        "term", F.col("tf").cast("double").alias("weight"))).alias("terms"))
    full = materialize(MD.rff_features(data.join(terms, "doc_id", "left"), float(g or 1.0)).select(
        "doc_id", "label", "is_test", "features"), "rff")
    svm = MD.learner("svm", 0, **params).fit(full.filter(F.col("is_test") == 0))
    return svm.transform(full.filter(F.col("is_test") == 1))


@register("rf_grid")
def rf_grid(spark, sf):
    """Test predictions of the best of the grid's 60 points, by 5-fold accuracy."""
    train, test = _sides(_labelled(spark, sf))
    folds = materialize(SP.stratified_folds(train, "doc_id", "label", RF_FOLDS), "folds")
    found, feats = MD.rf_grid_search(folds, folds=RF_FOLDS, id_col="doc_id")
    pred = _scored(found.bestModel.transform(feats.transform(test, "doc_id")))
    best = {k: F.lit(v) for k, v in found.best.items()}
    return pred.withColumns(best | {"cv_accuracy": F.round(F.lit(max(found.accuracy)), 6)})


@register("top_importances")
def top_importances(spark, sf):
    _, model, feats = MD.train_and_predict(*_sides(_labelled(spark, sf)), "rf", id_col="doc_id")
    return MD.top_importances(model, feats).select("term", r6("importance").alias("importance"))


# ------------------------------------------------------------------ a target that the words decide

TARGET_WORD = "the"
WORD_TARGET_SQL = f"""{SPLIT_SQL},
  t AS (SELECT doc_id, is_test, list_distinct(regexp_extract_all(lower(text), {WORD}, 1)) AS words
        FROM s JOIN documents USING (doc_id))"""
EXACT_SQL = f"""WITH {WORD_TARGET_SQL}
SELECT doc_id, CAST(list_contains(words, '{TARGET_WORD}') AS BIGINT) AS label,
       CAST(list_contains(words, '{TARGET_WORD}') AS BIGINT) AS prediction FROM t WHERE is_test"""


def _word_target(spark, sf):
    """The labelled documents' distinct words; the label says whether the target word is one of them."""
    words = F.array_distinct("tokens")
    return materialize(_labelled(spark, sf).select("doc_id", "is_test", words.alias("tokens"), F.array_contains(
        words, TARGET_WORD).cast("double").alias("label")), "word_target")


def _predict_word(spark, sf, kind, **params):
    pred, _, _ = MD.train_and_predict(*_sides(_word_target(spark, sf)), kind, "bow", "doc_id", **params)
    return _scored(pred)


@register("tree_word", EXACT_SQL)
def tree_word(spark, sf):
    return _predict_word(spark, sf, "tree")


@register("gbt_word", EXACT_SQL)
def gbt_word(spark, sf):
    return _predict_word(spark, sf, "gbt", max_iter=5)


@register("svm_word", EXACT_SQL)
def svm_word(spark, sf):
    """The word is one of the hundred most frequent ones, the features; no regularisation."""
    train, test = _sides(_word_target(spark, sf))
    feats = MD.fit_features(train, kind="bow", vocab_size=100)
    model = MD.learner("svm", feats.size, reg=0.0, max_iter=100).fit(feats.transform(train, "doc_id"))
    return _scored(model.transform(feats.transform(test, "doc_id")))


@register("rff_word", EXACT_SQL)
def rff_word(spark, sf):
    """The kernel sees the target word alone: a document without it has no terms."""
    data = _word_target(spark, sf)
    few = data.withColumn("tokens", F.filter("tokens", lambda t: t == TARGET_WORD))
    return _scored(_rff_predictions(few, reg=0.0, max_iter=200))


@register("top_importances_word", f"""
WITH {WORD_TARGET_SQL}, v AS (SELECT DISTINCT unnest(words) AS term FROM t WHERE NOT is_test)
SELECT term, CAST(term = '{TARGET_WORD}' AS DOUBLE) AS importance FROM v
ORDER BY importance DESC, term LIMIT {TOP_WORDS}""")
def top_importances_word(spark, sf):
    """The deciding word has all the importance, the others follow in order."""
    _, model, feats = MD.train_and_predict(*_sides(_word_target(spark, sf)), "tree", "bow", "doc_id")
    return MD.top_importances(model, feats).select("term", r6("importance").alias("importance"))


# ------------------------------------------------------------------ embeddings

def _tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.tokenize_word("text").alias("tokens"))


def _word2vec(spark, sf):
    """A model with the original settings (100 dims, window 5, min count 5, 50 epochs)."""
    return E.train_word2vec(materialize(_tokens(spark, sf), "w2v_tokens"))


@register("table_vectors", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORD}, 1)) AS word FROM documents),
  v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT word FROM t)),
  e AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
  x AS (SELECT v.word, e.embedding FROM v JOIN e ON v.i % e.n = e.i WHERE v.i % 3 > 0),
  u AS (SELECT doc_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM t JOIN x USING (word)),
  m AS (SELECT doc_id, pos, round(avg(CAST(x AS DOUBLE)), 5) + 0.0 AS mean FROM u GROUP BY doc_id, pos)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, mean FROM documents LEFT JOIN m USING (doc_id)""")
def table_vectors(spark, sf):
    """Document vectors from a token-vector table: two words of three get one of the embeddings."""
    toks = materialize(_tokens(spark, sf), "tokens")
    vocab = FT.vocabulary(toks.select(F.explode("tokens").alias("term")))
    emb = dense_index(table(spark, sf, "embeddings"), ["vec_id"], "i")
    n = table(spark, sf, "embeddings").count()
    vectors = vocab.filter("idx % 3 > 0").join(emb, F.col("idx") % max(1, n) == F.col("i")).select(
        F.col("term").alias("word"), F.col("embedding").alias("vector"))
    out = E.embed_documents(toks, vectors)
    return out.select("doc_id", F.posexplode_outer("vector").alias("pos", "mean")).withColumn(
        "mean", r6("mean", 5) + F.lit(0.0))                # no minus zero


@register("word2vec_vectors")
def word2vec_vectors(spark, sf):
    """The trained words and their vectors."""
    return E.word_vectors(_word2vec(spark, sf))


SEEDS = sorted(set(seed_words(SEED_PHRASES)) | set(TEST_SEEDS))


@register("expand_word2vec")
def expand_word2vec(spark, sf):
    """Every known seed word's nearest words, ranked by similarity."""
    return E.neighbours(_word2vec(spark, sf), SEEDS)


@register("doc_vectors")
def doc_vectors(spark, sf):
    """Documents and their mean word vectors; null without tokens."""
    return E.document_vectors(_word2vec(spark, sf), _tokens(spark, sf))
