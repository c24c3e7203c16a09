"""Registered queries: file sources and sinks, HTML records, streaming ingest.

Intermediate files go to a fresh folder under the session's shared
checkpoint directory (``spark.checkpoint.dir``), never a machine-local one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import scratch_path
from ..sources import files as FS
from ..config import NEWEST_SUFFIX, RATING_PREFIX, RATING_SUFFIX, REVIEW_CLASSES, REVIEW_COUNT_SUFFIX
from ..sources.html import html_records as extract_records
from ..sources.html import page_reviews, review_records
from ..streaming.ingest import ingest_available
from .registry import register, sq
from .tables import table

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WANTED_CUSTOMER = "c_custkey bigint, c_name string, c_phone string"


@register("csv_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv_round_trip")
    FS.write_csv(table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), path)
    return FS.read_csv(spark, path, DOC_SCHEMA)


@register("tolerant_scan", """
SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone FROM customer""")
def tolerant_scan(spark, sf):
    """A missing path reads as an empty table; a wanted column the files lack
    (c_phone) comes back null instead of failing the read."""
    missing = FS.tolerant_scan(spark, scratch_path(spark, "never_written"), WANTED_CUSTOMER)
    present = FS.tolerant_scan(spark, f"{sf.rstrip('/')}/customer.parquet", WANTED_CUSTOMER)
    return missing.unionByName(present)


@register("stopword_scan", f"""
SELECT DISTINCT w AS value FROM (
  SELECT unnest(regexp_extract_all(lower(text), {sq(T.WORD_TOKEN)}, 1)) AS w FROM documents)""")
def stopword_scan(spark, sf):
    """A word list written one entry per line (padded with spaces and tabs),
    read back stripped and de-duplicated."""
    path = scratch_path(spark, "word_list")
    words = table(spark, sf, "documents").select(F.explode(T.tokenize_word("text")).alias("w"))
    words.select(F.concat(F.lit("  "), "w", F.lit(" \t")).alias("value")).write.text(path)
    return FS.read_lines(spark, path)


@register("aligned_append", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM supplier""")
def aligned_append(spark, sf):
    path = scratch_path(spark, "aligned_append")
    FS.aligned_append(spark, table(spark, sf, "customer"), path)
    # supplier columns mapped to the stored names; s_acctbal has no mapping
    # (dropped) and c_acctbal / c_mktsegment are missing (null-filled).
    sup = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), "s_acctbal")
    FS.aligned_append(spark, sup, path)
    return spark.read.parquet(path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


ENT = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"),
       ("&nbsp;", " "), ("&amp;", "&")]


def _clean_sql(expr: str) -> str:
    out = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    for ent, ch in ENT:
        out = f"replace({out}, {sq(ent)}, {sq(ch)})"
    return f"regexp_replace({out}, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"


HTML_SQL = f"""
WITH v AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'),
                        '(?is)<style\\b.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS vis
  FROM pages),
  p AS (
  SELECT page_id, html, vis, regexp_split_to_array(vis, '<[pP](?:\\s[^>]*)?>') AS pieces FROM v),
  e AS (
  SELECT page_id,
         {_clean_sql("regexp_extract(vis, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
         {_clean_sql("regexp_extract(vis, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS heading,
         CASE WHEN contains(html, '<img') THEN 'Y' ELSE 'N' END AS flag,
         unnest(pieces[2:]) AS raw, unnest(range(1, len(pieces))) AS para_pos
  FROM p)
SELECT page_id, title, heading, flag, CAST(para_pos AS BIGINT) AS para_pos,
       {_clean_sql("split_part(split_part(raw, '</p>', 1), '</article>', 1)")} AS paragraph
FROM e"""


@register("html_records", HTML_SQL)
def html_records(spark, sf):
    return extract_records(table(spark, sf, "pages"))


@register("review_records", f"""
WITH h AS ({HTML_SQL})
SELECT TIMESTAMP '2024-03-01 10:05:00' AS ScrapeTime, title AS RestName, flag AS PicAttached, heading AS ReviewerName,
       CAST(para_pos * 1234 AS VARCHAR) AS TotalReviewsByUser, CAST(1 + para_pos % 5 AS DOUBLE) AS ReviewRating,
       para_pos || ' 天前' AS ReviewDate,
       CASE WHEN para_pos % 2 = 0 AND paragraph <> '' THEN paragraph ELSE source_text END AS ReviewDescription
FROM (SELECT *, 'snippet: ' || paragraph AS source_text FROM h)""")
def review_records_q(spark, sf):
    """Review rows in the collector's schema from page blocks; labels as the site writes them."""
    n = F.col("para_pos")
    blocks = extract_records(table(spark, sf, "pages")).withColumns({
        "count": F.concat(F.format_number(n * 1234, 0), F.lit(REVIEW_COUNT_SUFFIX)),
        "rating": F.concat(F.lit(RATING_PREFIX), (1 + n % 5).cast("string"), F.lit(".0" + RATING_SUFFIX)),
        "age": F.concat(n.cast("string"), F.lit(" 天前" + NEWEST_SUFFIX)),
        "snippet": F.concat(F.lit("snippet: "), "paragraph"), "full": F.when(n % 2 == 0, F.col("paragraph"))})
    return review_records(blocks, place="title", reviewer="heading", count="count", rating="rating", age="age",
                          snippet="snippet", full="full", picture="flag",
                          scrape_time=F.lit("2024-03-01 10:05:00").cast("timestamp"))


def review_pages(docs):
    """A review page per document: a block per line that is not blank, in the site's markup."""
    def escaped(c):
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(char), F.lit(entity))
        return c

    def tag(cls, *inner, extra=""):
        return F.concat(F.lit(f'<span class="{cls}"{extra}>'), *inner, F.lit("</span>"))

    def block(line, i):
        c = REVIEW_CLASSES
        stars = F.concat(F.lit(f'<div role="img" class="x {c["rating"]}" aria-label="{RATING_PREFIX}'),
                         (1 + i % 5).cast("string"), F.lit(f'.0{RATING_SUFFIX}"><i></i></div>'))
        body = F.concat(
            F.lit(f'<div class="{c["body"]}">'),
            F.when(i % 2 == 1, tag(c["full"], escaped(line), extra=' style="display:none"')).otherwise(
                tag("review-snippet", F.lit("<b>"), escaped(F.substring(line, 1, 30)), F.lit("</b><br>…"))),
            F.lit("</div>"))
        return F.concat(
            F.lit(f'<div class="{c["block"]}">'), tag(c["reviewer"], F.lit('<a href="/u">user '), "doc_id", F.lit("-"),
                                                     i.cast("string"), F.lit("</a>")),
            F.when(i % 3 > 0, tag(c["count"], F.format_number(i * 1234, 0), F.lit(REVIEW_COUNT_SUFFIX)))
            .otherwise(""), stars, tag(c["age"], i.cast("string"), F.lit(" 天前<br>最新")),
            F.when(i % 4 == 0, tag(c["picture"], F.lit('<img src="a.png">'))).otherwise(""), body, F.lit("</div>"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\r]"))
    return docs.select(F.concat(
        F.lit("<html><head><title>"), escaped(F.coalesce("source", F.lit("no name"))),
        F.lit('</title><script>var a = "<div>";</script></head><body><!-- list --><div id="all">'),
        F.array_join(F.transform(lines, block), "\n"), F.lit("</div><p>end</p></body></html>")).alias("html"))


@register("page_reviews", """
WITH l AS (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]')) AS t
           FROM documents),
  x AS (SELECT doc_id, coalesce(source, 'no name') AS place, t[i + 1] AS line, i FROM l, unnest(range(len(t))) AS u(i))
SELECT TIMESTAMP '2024-03-01 10:05:00' AS ScrapeTime, place AS RestName,
  CASE WHEN i % 4 = 0 THEN 'Y' ELSE 'N' END AS PicAttached, 'user ' || doc_id || '-' || i AS ReviewerName,
  CASE WHEN i % 3 > 0 THEN CAST(i * 1234 AS VARCHAR) ELSE '' END AS TotalReviewsByUser,
  CAST(1 + i % 5 AS DOUBLE) AS ReviewRating, i || ' 天前' AS ReviewDate,
  CASE WHEN i % 2 = 1 THEN trim(line, ' ' || chr(9) || chr(13))
       ELSE regexp_replace(substring(line, 1, 30), '^[ \\t\\r]+', '') || chr(10) || '…' END AS ReviewDescription
FROM x""")
def page_reviews_q(spark, sf):
    """Reviews cut from stored pages: every field comes out of the HTML."""
    return page_reviews(review_pages(table(spark, sf, "documents")),
                        scrape_time=F.lit("2024-03-01 10:05:00").cast("timestamp"))


@register("incremental_ingest", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def incremental_ingest(spark, sf):
    """documents arrive as two overlapping folders of files: the first is
    ingested, then the second lands and is ingested, then a rerun finds
    nothing new.  The store must hold each row exactly once."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    base = scratch_path(spark, "ingest")
    store, ckpt, source = f"{base}/store", f"{base}/checkpoint", f"{base}/in/*"
    docs.filter(F.col("doc_id") % 3 != 0).write.parquet(f"{base}/in/a")
    ingest_available(spark, source, DOC_SCHEMA, store, ckpt, "doc_id")
    docs.filter(F.col("doc_id") % 3 != 1).write.parquet(f"{base}/in/b")
    ingest_available(spark, source, DOC_SCHEMA, store, ckpt, "doc_id")
    ingest_available(spark, source, DOC_SCHEMA, store, ckpt, "doc_id")
    return spark.read.parquet(store).select("doc_id", "text", "lang", "source", "n_chars")
