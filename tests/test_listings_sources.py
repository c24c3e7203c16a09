import pytest
"""Listings, exclusions, file sources/sinks and incremental ingest."""

import os

from pyspark.sql import functions as F

from reviewlens.config import CLOSED_STATUS
from reviewlens.operators import listings as LS
from reviewlens.operators import model as MD
from reviewlens.session import scratch_path
from reviewlens.sources import files as FS
from reviewlens.sources.html import html_records
from reviewlens.streaming.ingest import ingest_available

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_eligible_listings(spark):
    df = spark.createDataFrame([("A", None), ("B", CLOSED_STATUS), (" ", None), ("C", "營業中")],
                               "name string, status string")
    assert sorted(r[0] for r in LS.eligible_listings(df).collect()) == ["A", "C"]


def test_listing_conditions_with_hours(spark):
    rows = [("open sat noon", 4.6, [(7, 600, 900)]), ("closed at noon", 4.8, [(7, 0, 700)]),
            ("low rating", 4.0, [(7, 600, 900)]), ("weekday only", 4.9, [(2, 600, 900)])]
    df = spark.createDataFrame(rows, "name string, rating double, hours array<struct<dow:int,open:int,close:int>>")
    got = [r[0] for r in LS.listing_conditions(df, "rating", hours_col="hours").collect()]
    assert got == ["open sat noon"]


def test_exclude_and_keyword(spark):
    df = spark.createDataFrame([("米樂",), ("新竹巨城",), ("好餐廳",)], "name string").withColumn("city", F.lit("新竹"))
    assert sorted(r[0] for r in LS.exclude_names(df, "name", ["新竹巨城"]).collect()) == ["好餐廳", "米樂"]
    kw = {r["name"]: r["keyword"] for r in LS.search_keyword(df, "name", "city", ["米樂"]).collect()}
    assert kw["米樂"] == "米樂 新竹" and kw["好餐廳"] == "好餐廳"


def test_unseen_and_union_distinct(spark):
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    seen = spark.createDataFrame([("b",)], "name string")
    assert [r[0] for r in LS.unseen_entities(new, seen, "name").collect()] == ["a"]
    assert sorted(r[0] for r in LS.union_distinct(new, seen).collect()) == ["a", "b"]


def test_positional_zip(spark):
    out = MD.positional_zip(spark, ["x", "y"], [0.5, 0.25]).orderBy("idx").collect()
    assert [(r.idx, r.term, r.value) for r in out] == [(0, "x", 0.5), (1, "y", 0.25)]


def test_csv_round_trip_keeps_newlines_quotes_and_spaces(spark):
    rows = [(1, 'line one\nline "two"', "en", " s ", 3), (2, "", "de", "x", 0)]
    df = spark.createDataFrame(rows, DOCS)
    path = scratch_path(spark, "t_csv")
    FS.write_csv(df, path)
    back = sorted(tuple(r) for r in FS.read_csv(spark, path, DOCS).collect())
    assert back[0] == rows[0]
    assert back[1][1] in ("", None)


def test_tolerant_scan_and_aligned_append(spark):
    empty = FS.tolerant_scan(spark, scratch_path(spark, "missing"), "a int, b string")
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    path = scratch_path(spark, "t_append")
    FS.aligned_append(spark, spark.createDataFrame([(1, "x")], "a int, b string"), path)
    FS.aligned_append(spark, spark.createDataFrame([("y", 9.0)], "b string, extra double"), path)
    got = sorted((tuple(r) for r in spark.read.parquet(path).collect()), key=repr)
    assert spark.read.parquet(path).columns == ["a", "b"]
    assert got == sorted([(1, "x"), (None, "y")], key=repr)


def test_read_lines(spark, tmp_path):
    p = os.path.join(str(tmp_path), "stop.txt")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("  的 \n了\n\n的\n　是　\n")
    assert sorted(r[0] for r in FS.read_lines(spark, p).collect()) == sorted(["的", "了", "是"])


def test_html_records(spark):
    html = ('<html><head><title>T &amp; T</title><script>var x="<p>no</p>";</script></head><body>'
            '<div class="ad">ad</div><article><h1>Head</h1><p><b>One</b> &lt;1&gt;<br><p>Two</p>'
            '<p class="x">Three</p></article></body></html>')
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    rows = html_records(df, flag_marker='class="ad"').orderBy("para_pos").collect()
    assert [(r.title, r.heading, r.flag) for r in rows][0] == ("T & T", "Head", "Y")
    assert [r.paragraph for r in rows] == ["One <1>", "Two", "Three"]


def test_incremental_ingest_twice_adds_nothing(spark):
    base = scratch_path(spark, "t_ingest")
    a = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(10)], DOCS)
    a.write.parquet(f"{base}/in/a")
    ingest_available(spark, f"{base}/in/*", DOCS, f"{base}/store", f"{base}/ck", "doc_id")
    assert spark.read.parquet(f"{base}/store").count() == 10
    ingest_available(spark, f"{base}/in/*", DOCS, f"{base}/store", f"{base}/ck", "doc_id")
    assert spark.read.parquet(f"{base}/store").count() == 10
    b = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(5, 15)], DOCS)
    b.write.parquet(f"{base}/in/b")
    ingest_available(spark, f"{base}/in/*", DOCS, f"{base}/store", f"{base}/ck", "doc_id")
    ids = sorted(r[0] for r in spark.read.parquet(f"{base}/store").collect())
    assert ids == list(range(15))


def test_character_references(spark):
    from reviewlens.sources.html import clean_text
    vals = ["&#39;a&#x27; &#128512; &copy;&middot; &amp;#39; &#xZZ; &#0; &#55296; &", "", None, "plain"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = {r.i: r.o for r in df.select("i", clean_text(F.col("v")).alias("o")).collect()}
    assert got == {0: "'a' \U0001F600 ©· &#39; &#xZZ; &#0; &#55296; &", 1: "", 2: None, 3: "plain"}


def test_review_blocks_from_nested_markup(spark):
    """Nested elements, missing fields, void and self-closed tags, text after the last block."""
    from reviewlens.sources.html import page_reviews, review_blocks
    page = """<html><head><title>Caf&eacute; &amp; Bar</title><style>.a{}</style></head><body><header>x</header>
      <div class="WMbnJf vY6njf"><div class="TSUbDb"><a>Ann <b>Lee</b></a></div><span class="A503be">1,234 則評論</span>
      <g-img class='lTi8oc z3HNkc' aria-label="評等：4.0 (最高：5)，"/><span class="PuaHbe">2 週前<br>最新</span>
      <div class="DQBZx"><img src=a><br></div><div class="Jtu6Td"><div><span class="review-snippet">short</span>
      <span class="review-full-text">all of <div>the &lt;text&gt;</div></span></div> more</div></div>
      <div class="vY6njf x WMbnJf"><div class="TSUbDb">Bob</div><div class="lTi8oc z3HNkc" aria-label="評等：1.0 (最高：5)，">
      </div><div class="PuaHbe">3 天前</div><div class="Jtu6Td">only <i>this</i></div></div>
      <div class="TSUbDb">not in a block</div></body></html>"""
    df = spark.createDataFrame([(1, page), (1, page), (2, None), (3, ""), (4, "<p>no block</p>")], "id int, html string")
    got = sorted(tuple(r) for r in review_blocks(df).select(
        "place", "reviewer", "count", "rating", "age", "snippet", "full", "picture").fillna("-").collect())
    place = "Caf&eacute; & Bar"
    one = (place, "Ann Lee", "1,234 則評論", "評等：4.0 (最高：5)，", "2 週前\n最新",
           "short\n      all of the <text> more", "all of the <text>", "Y")
    two = (place, "Bob", "-", "評等：1.0 (最高：5)，", "3 天前", "only this", "-", "N")
    assert got == sorted([one, two] * 2)
    rows = page_reviews(df).orderBy("ReviewerName").collect()
    assert [(r.ReviewerName, r.TotalReviewsByUser, r.ReviewRating, r.ReviewDate, r.ReviewDescription) for r in rows[1:3]] \
        == [("Ann Lee", "1234", 4.0, "2 週前", "all of the <text>"), ("Bob", "", 1.0, "3 天前", "only this")]


def test_only_a_missing_path_is_absent(spark, tmp_path):
    from reviewlens.sources.files import tolerant_scan
    assert tolerant_scan(spark, str(tmp_path / "none"), "a int").collect() == []
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        tolerant_scan(spark, "nosuchfs://host/table", "a int")
