"""End-to-end flows on an inline review fixture written as CSV."""

import datetime
import random

from reviewlens import flows
from reviewlens.functions.text import lexicon_segmenter
from reviewlens.schema import RAW_REVIEWS
from reviewlens.session import scratch_path
from reviewlens.sources import files as FS

PROMO = ["打卡送飲料", "五星好評送小菜", "加入line會員送折扣"]
PLAIN = ["餐點好吃", "服務很好", "環境乾淨", "價格便宜", "上菜很慢"]


def reviews(spark, n=120):
    rnd = random.Random(1)
    ts = datetime.datetime(2024, 3, 1, 10, 5, 0)
    rows = []
    for i in range(n):
        promo = i % 4 == 0
        text = " ".join([rnd.choice(PROMO) if promo else rnd.choice(PLAIN), rnd.choice(PLAIN)])
        rows.append((ts, f"店{i % 5}", "N", f"user{i}", "", 5.0 if promo or i % 3 == 0 else 4.0,
                     f"{1 + i % 9} 天前", text))
    return spark.createDataFrame(rows, RAW_REVIEWS)


def test_rule_flow_from_csv(spark):
    path = scratch_path(spark, "t_reviews")
    FS.write_csv(reviews(spark).withColumn("ScrapeTime",
                                           __import__("pyspark.sql.functions", fromlist=["x"])
                                           .date_format("ScrapeTime", "yyyy/MM/dd HH:mm:ss")), path)
    raw = flows.read_reviews(spark, path)
    out = flows.rule_labelled_reviews(raw)
    rows = out.collect()
    assert len(rows) == 120
    assert sum(r.IsInducing for r in rows) == 30
    assert rows[0].ReviewActualDate.startswith("2024/02/")
    # the default segments: a review has several tokens, and stop words apply to them
    assert all(len(r.ProcessedReview.split(" ")) > 2 for r in rows)
    stopped = flows.rule_labelled_reviews(raw, stopwords=["好吃"]).collect()
    assert not any("好吃" in r.ProcessedReview.split(" ") for r in stopped)


def test_expansion_flow_ppmi_and_training(spark):
    seg = lexicon_segmenter(["打卡", "送", "飲料", "五星", "好評", "小菜", "加入", "會員", "折扣", "line",
                             "餐點", "好吃", "服務", "很好", "環境", "乾淨", "價格", "便宜", "上菜", "很慢"])
    raw = reviews(spark)
    from reviewlens.operators import text_ops as X
    cleaned = X.clean_review_table(raw, tokenizer=seg, with_restaurant=True)
    assert cleaned.filter("ProcessedReview LIKE '%打卡 送%'").count() > 0
    out = flows.expansion_labelled_reviews(raw, provider="ppmi", tokenizer=seg)
    labelled = {r.Reviewer: r.IsInducing for r in out.collect()}
    assert sum(labelled.values()) >= 30 and len(labelled) == 120
    plain = flows.expansion_labelled_reviews(raw, provider="ppmi", tokenizer=seg, merge=False)
    assert plain.count() == 120
    report, pred, top = flows.train_and_evaluate(cleaned, kind="tree", features="bow")
    m = report.first()
    assert m.tp + m.fp + m.fn + m.tn == 24 and 0.0 <= m.accuracy <= 1.0
    assert top is None
