"""Classifiers on text features with ``pyspark.ml``.

Features: the vocabulary is fitted on the training rows only (every term, as in
the original) and stays a table; sparse vectors are assembled per document by
joins and aggregation.  TF-IDF is ``tf * (ln((n+1)/(df+1)) + 1)``, L2-normalised.
Trees, forests and boosted trees grow over the words that rows hold
(:mod:`.sparse_trees`); the other learners are Spark's, and what they hold per
feature is theirs.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..config import RF_FOLDS, RF_GRID, SPLIT_SEED, TOP_WORDS
from ..functions.text import let
from ..session import materialize, row_name, scratch_path
from .features import doc_terms, smoothed_idf
from .nested_forest import nested_accuracy
from .ordering import dense_index
from .sparse_trees import Points, SparseTreeLearner

MAX_SPARK_DEPTH = 30


class TextVectors:
    """A fitted vectoriser whose vocabulary is a table.

    ``terms`` holds (term, idx, idf) with a dense index in term order, written
    once; only its row count (``size``) reaches the driver.  Vectors are put
    together per document: counted terms meet the table by a join, and a
    document's (index, value) pairs are gathered, which its text bounds.
    """

    def __init__(self, terms: DataFrame, size: int, kind: str, tokens_col: str):
        self.terms, self.size, self.kind, self.tokens_col = terms, size, kind, tokens_col

    def transform(self, df: DataFrame, id_col: str | None = None, out_col: str = "features") -> DataFrame:
        """``df`` with a sparse vector per row, written; terms that were not fitted are left out.

        ``id_col`` is a unique key; without one the rows get a written key first.
        """
        key = id_col
        if key is None:
            key = row_name(df)
            df = materialize(df.withColumn(key, F.monotonically_increasing_id()), "keyed")
        counted = doc_terms(df.select(F.col(key).alias("row"), F.col(self.tokens_col).alias("tokens")),
                            "row", F.col("tokens"))
        value = F.col("tf").cast("double") * (F.col("idf") if self.kind == "tfidf" else F.lit(1.0))
        rows = (counted.join(self.terms, "term")
                .groupBy(F.col("row").alias("at"))
                .agg(F.sort_array(F.collect_list(F.struct("idx", value.alias("w")))).alias("p")))
        at, pairs = row_name(df, "at"), row_name(df, "p")
        rows = rows.select(F.col("at").alias(at), F.col("p").alias(pairs))
        held = F.coalesce(pairs, F.array().cast("array<struct<idx:int,w:double>>"))
        length = F.sqrt(F.aggregate(held, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        weights = F.transform(held, lambda x: x["w"])
        if self.kind == "tfidf":
            weights = let(length, lambda n: F.transform(held, lambda x: x["w"] / n))
        # the layout of a sparse vector; Parquet hands it back as one, without Python
        vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(max(1, self.size)).alias("size"),
                          F.transform(held, lambda x: x["idx"]).alias("indices"), weights.alias("values"))
        kept = [c for c in df.columns if c != out_col and (id_col is not None or c != key)]
        out = df.join(rows, F.col(key) == F.col(at), "left").select(*kept, vector.alias(out_col))
        path = scratch_path(df.sparkSession, "vectors")
        out.write.mode("overwrite").parquet(path)
        schema = StructType([f for f in df.schema.fields if f.name in kept] + [StructField(out_col, VectorUDT())])
        return df.sparkSession.read.schema(schema).parquet(path)


def fit_features(train: DataFrame, tokens_col: str = "tokens", kind: str = "tfidf",
                 vocab_size: int | None = None, min_df: int = 1) -> TextVectors:
    """Fit the vectoriser on ``train``: every term, its index and its smoothed IDF.

    Terms are only dropped by an explicit ``vocab_size`` (most frequent first,
    ties in term order) or ``min_df`` (documents that hold the term).
    """
    words = train.select(F.monotonically_increasing_id().alias("row"), F.explode(
        F.array_distinct(tokens_col) if not vocab_size else F.col(tokens_col)).alias("term"))
    if vocab_size:
        found = words.groupBy("term").agg(F.countDistinct("row").alias("df"), F.count("*").alias("n"))
        found = found.filter(F.col("df") >= min_df).orderBy(F.desc("n"), "term").limit(vocab_size)
    else:
        found = words.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    found = materialize(found.filter("term is not null").select("term", "df"), "terms")
    idf = smoothed_idf(F.col("df"), F.lit(float(train.count())))
    terms = materialize(dense_index(found.withColumn("idf", idf), ["term"], "idx").select(
        "term", F.col("idx").cast("int").alias("idx"), "idf"), "vocabulary")
    return TextVectors(terms, terms.count(), kind, tokens_col)


def vocabulary_frame(feature_model: TextVectors) -> DataFrame:
    """(idx, term) of the fitted vectoriser."""
    return feature_model.terms.select("idx", "term")


def positional_zip(spark, names: list[str], values: list[float],
                   name_col: str = "term", value_col: str = "value") -> DataFrame:
    """Pair two equally long, bounded lists by position."""
    if len(names) != len(values):
        raise ValueError("lists differ in length")
    rows = [(i, n, float(v)) for i, (n, v) in enumerate(zip(names, values))]
    return spark.createDataFrame(rows, f"idx int, {name_col} string, {value_col} double")


def positional_zip_arrays(df: DataFrame, id_col: str, names_col: str, values_col: str,
                          name_col: str = "term", value_col: str = "value") -> DataFrame:
    """Pair two array columns of each row by position: (id, pos, name, value).

    ``arrays_zip`` + ``posexplode`` inside the row - no join, no shuffle;
    the shorter array is padded with nulls.
    """
    z = df.select(id_col, F.posexplode(F.arrays_zip(F.col(names_col).alias("n"),
                                                    F.col(values_col).alias("v"))).alias("pos", "__z"))
    return z.select(id_col, F.col("pos").cast("bigint").alias("pos"),
                    F.col("__z.n").alias(name_col), F.col("__z.v").alias(value_col))


def learner(kind: str, n_features: int, seed: int = SPLIT_SEED, **params):
    if kind == "rf":
        return _forest(params.get("num_trees", 100), params.get("max_depth", MAX_SPARK_DEPTH),
                       params.get("min_instances", 1), seed, {})
    if kind == "tree":
        return SparseTreeLearner("tree", maxDepth=params.get("max_depth", MAX_SPARK_DEPTH), seed=seed)
    if kind == "gbt":
        return SparseTreeLearner("gbt", maxIter=params.get("max_iter", 20), maxDepth=params.get("max_depth", 5),
                                 seed=seed)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, params.get("hidden", 32), 2],
                                              maxIter=params.get("max_iter", 100), seed=seed)
    if kind == "svm":
        return LinearSVC(maxIter=params.get("max_iter", 50), regParam=params.get("reg", 0.01))
    raise ValueError(kind)


def train_and_predict(train: DataFrame, test: DataFrame, kind: str, feature_kind: str = "tfidf",
                      id_col: str | None = None, **params) -> tuple[DataFrame, object, TextVectors]:
    feats = fit_features(train, kind=feature_kind)
    model = learner(kind, max(1, feats.size), **params).fit(feats.transform(train, id_col))
    return model.transform(feats.transform(test, id_col)), model, feats


def rf_grid_points(grid: dict = RF_GRID) -> list[dict]:
    """The random-forest grid in Spark terms, equal points collapsed.

    ``max_depth=None`` maps to Spark's deepest tree (30).  A split needs at
    least ``min_samples_split`` rows, which a node with children of at
    least ``ceil(split / 2)`` rows guarantees, so both map to
    ``minInstancesPerNode = max(leaf, ceil(split / 2))``.
    """
    points = set()
    for n in grid["n_estimators"]:
        for d in grid["max_depth"]:
            for s in grid["min_samples_split"]:
                for leaf in grid["min_samples_leaf"]:
                    points.add((n, MAX_SPARK_DEPTH if d is None else d, max(leaf, math.ceil(s / 2))))
    return [dict(num_trees=n, max_depth=d, min_instances=m) for n, d, m in sorted(points)]


@dataclass
class GridResult:
    """The searched points, their mean accuracy over the folds, and the best one refitted."""

    points: list[dict]
    accuracy: list[float]
    best: dict
    bestModel: object


def rf_grid_search(train: DataFrame, grid: dict = RF_GRID, folds: int = RF_FOLDS, fold_col: str = "fold",
                   parallelism: int = 4, seed: int = SPLIT_SEED, id_col: str | None = None,
                   **forest) -> tuple[GridResult, TextVectors]:
    """Cross-validated grid search by accuracy over nested forests; the best point is refitted.

    Per fold and leaf size one forest is grown, with the most trees and the
    deepest ones.  Its first n trees are a forest of n, and its trees cut at a
    depth are trees of that depth (:mod:`.nested_forest`), so the 60 points of
    the full grid need 25 forests.  Ties go to the first point.
    """
    feats = fit_features(train)
    data = feats.transform(train, id_col)
    points = rf_grid_points(grid)
    counts, depths = (sorted({p[k] for p in points}) for k in ("num_trees", "max_depth"))
    made, locks = {}, [Lock() for _ in range(folds)]

    def fold_scores(job):
        fold, leaf = job
        rf = _forest(counts[-1], depths[-1], leaf, seed, forest)
        rows = data.filter(F.col(fold_col) != fold)
        with locks[fold]:                                    # made once a fold, for all leaf sizes
            if fold not in made:
                made[fold] = Points(rows)
        model = rf.fit(rows, made[fold])
        return leaf, nested_accuracy(model, data.filter(F.col(fold_col) == fold), counts, depths)

    jobs = [(f, leaf) for leaf in sorted({p["min_instances"] for p in points}) for f in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(inheritable_thread_target(data.sparkSession)(fold_scores), jobs))
    accuracy = []
    for p in points:
        held = [s[p["num_trees"], p["max_depth"]] for leaf, s in scores if leaf == p["min_instances"]]
        held = [a for a in held if a is not None]            # folds without rows
        accuracy.append(sum(held) / len(held) if held else 0.0)
    best = points[max(range(len(points)), key=lambda i: accuracy[i])]
    model = _forest(best["num_trees"], best["max_depth"], best["min_instances"], seed, forest).fit(data)
    return GridResult(points, accuracy, best, model), feats


def _forest(trees, depth, leaf, seed, params):
    return SparseTreeLearner("rf", **{
        "numTrees": trees, "maxDepth": depth, "minInstancesPerNode": leaf, "featureSubsetStrategy": "sqrt",
        "seed": seed, **params})


def top_importances(model, feats: TextVectors, k: int = TOP_WORDS) -> DataFrame:
    """Top-k words by importance; ties keep term order.

    Only the features that the trees split on reach the driver; their words come by a join.
    """
    spark = feats.terms.sparkSession
    imp = model.featureImportances                       # sparse: only the split words matter
    used = [int(i) for i in imp.indices]
    pairs = positional_zip(spark, [str(i) for i in used], [imp[i] for i in used], "at", "importance")
    scored = pairs.join(feats.terms, F.col("at").cast("int") == feats.terms["idx"]).select("term", "importance")
    rest = feats.terms.join(scored, "term", "left_anti").orderBy("term").limit(k).select(
        "term", F.lit(0.0).alias("importance"))
    return scored.union(rest).orderBy(F.col("importance").desc(), F.col("term")).limit(k)


def rff_features(docs: DataFrame, gamma: float, dims: int = 64, seed: int = SPLIT_SEED,
                 terms_col: str = "terms", out_col: str = "features") -> DataFrame:
    """Random Fourier features of an RBF kernel (Rahimi & Recht, 2007).

    ``terms_col`` holds each row's (term, weight) structs.
    ``z(x) = sqrt(2/D) cos(W x + b)``, ``W ~ N(0, 2 gamma)``, ``b ~ U(0, 2pi)``.
    W's entries are derived from hashes of (term, dimension, seed), so no
    matrix is built; the projection is summed inside the row, without
    exploding, and a row without terms gets ``cos(b)`` in every dimension.
    """
    def unit(*cols):
        return (F.pmod(F.xxhash64(*cols), F.lit(2 ** 52)).cast("double") + 0.5) / float(2 ** 52)

    def one(d):
        def add(acc, t):
            u1 = unit(t["term"], d, F.lit(seed), F.lit(1))
            u2 = unit(t["term"], d, F.lit(seed), F.lit(2))
            return acc + t["weight"] * F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)
        wx = F.aggregate(F.coalesce(terms_col, F.array().cast("array<struct<term:string,weight:double>>")),
                         F.lit(0.0), add)
        phase = 2.0 * math.pi * unit(d, F.lit(seed), F.lit(3))
        return math.sqrt(2.0 / dims) * F.cos(math.sqrt(2.0 * gamma) * wx + phase)

    return docs.withColumn(out_col, array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), one)))
