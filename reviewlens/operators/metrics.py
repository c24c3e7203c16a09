"""Evaluation metrics as single aggregations over prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running_totals


def _ratio(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def classification_metrics(pred: DataFrame, label_col: str = "label",
                           prediction_col: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 (positive class 1) plus ROC-AUC and
    average precision computed from hard 0/1 predictions, in one pass.

    A zero denominator gives 0.  With hard labels, ROC-AUC is the mean of
    TPR and TNR, and average precision is ``R * P + (1 - R) * prevalence``;
    ROC-AUC is null when only one class is present.
    """
    y = F.col(label_col) == 1
    p = F.col(prediction_col) == 1
    c = pred.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    tpr, fpr = recall, _ratio(fp, fp + tn)
    auc = F.when((tp + fn > 0) & (fp + tn > 0), (tpr + 1 - fpr) / 2)
    prevalence = _ratio(tp + fn, n)
    ap = F.when(tp + fp > 0, recall * precision + (1 - recall) * prevalence).otherwise(prevalence)
    return c.select(
        tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
        fn.cast("bigint").alias("fn"), tn.cast("bigint").alias("tn"),
        _ratio(tp + tn, n).alias("accuracy"), precision.alias("precision"),
        recall.alias("recall"), f1.alias("f1"), auc.alias("roc_auc"), ap.alias("avg_precision"))


def score_auc(scored: DataFrame, label_col: str = "label", score_col: str = "score") -> DataFrame:
    """Exact ROC-AUC and average precision from real-valued scores.

    Scores are first reduced to (score, positives, negatives) - hot scores
    collapse to one row - and cumulative counts over the distinct scores come
    from per-partition totals plus offsets.  AUC counts ties as one half.
    AP is the step-wise sum over descending score thresholds.
    """
    per = scored.groupBy(F.col(score_col).alias("score")).agg(
        F.count_if(F.col(label_col) == 1).alias("pos"),
        F.count_if(F.col(label_col) != 1).alias("neg"))
    cum = running_totals(per, [F.col("score").desc()], {"cpos": F.col("pos"), "cneg": F.col("neg")})
    # the running totals are written: their largest values are the class sizes
    sizes = cum.agg(F.max("cpos").alias("P"), F.max("cneg").alias("N"))
    big_p = F.coalesce(sizes.select("P").scalar(), F.lit(0))
    big_n = F.coalesce(sizes.select("N").scalar(), F.lit(0))
    # positives at this score beat every negative with a lower score
    lower_neg = big_n - F.col("cneg")
    pairs = F.col("pos") * lower_neg + 0.5 * F.col("pos") * F.col("neg")
    # without positives or negatives the ratios are null, not an error
    step = F.try_divide(F.col("pos"), big_p) * (F.col("cpos") / (F.col("cpos") + F.col("cneg")))
    return cum.agg(
        F.try_divide(F.sum(pairs), (big_p * big_n).cast("double")).alias("roc_auc"),
        F.when(F.max("cpos") > 0, F.sum(step)).alias("avg_precision"),
        F.coalesce(F.max("cpos"), F.lit(0)).cast("bigint").alias("positives"),
        F.coalesce(F.max("cneg"), F.lit(0)).cast("bigint").alias("negatives"))


def term_log_odds(doc_term: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  label_col: str = "label", alpha: float = 0.5) -> DataFrame:
    """Per-term document rates in each class and the smoothed log-odds ratio.

    rate_c = docs of class c with the term / docs of class c;
    log_odds = ln((a1 + alpha) / (n1 - a1 + alpha)) - ln((a0 + alpha) / (n0 - a0 + alpha)).
    """
    joined = doc_term.join(labels.select(id_col, label_col), id_col)
    per = joined.groupBy("term").agg(
        F.count_if(F.col(label_col) == 1).alias("docs_pos"),
        F.count_if(F.col(label_col) != 1).alias("docs_neg"))
    cls = labels.agg(F.count_if(F.col(label_col) == 1).alias("n1"),
                     F.count_if(F.col(label_col) != 1).alias("n0"))
    n1 = cls.select("n1").scalar()
    n0 = cls.select("n0").scalar()
    a1, a0 = F.col("docs_pos"), F.col("docs_neg")
    lo = (F.log((a1 + alpha) / (n1 - a1 + alpha)) - F.log((a0 + alpha) / (n0 - a0 + alpha)))
    return per.select("term", "docs_pos", "docs_neg",
                      _ratio(a1, n1).alias("rate_pos"), _ratio(a0, n0).alias("rate_neg"),
                      lo.alias("log_odds"))
