"""Review records from stored HTML pages (the data half of the collector).

Everything is regex work on the ``html`` column, so pages are processed
where they are read, one row at a time, with no Python in the plan.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import REVIEW_CLASSES, SCRAPE_TIME_FORMAT
from ..functions import text as T
from ..operators.listings import prefer_full_text

# Character references decoded in paragraph text; "&amp;" goes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
            ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&nbsp;", " "), ("&amp;", "&"))

VOID_TAG = r"(?i)^<(area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)\b"

EDGE_SPACE = r"^[ \t\n\r]+|[ \t\n\r]+$"


def decode_numeric(c: Column) -> Column:
    """Decimal and hexadecimal character references (``&#39;``, ``&#x27;``); others stay as they are."""
    def piece(x, i):
        hexed, digits = F.regexp_extract(x, r"^[xX]([0-9a-fA-F]{1,6});", 1), F.regexp_extract(x, r"^([0-9]{1,7});", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10)).when(digits != "", digits).try_cast("int")
        held = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(held, code)), 8, "0")), "UTF-32")
        return F.when(i == 0, x).when(held, F.concat(char, F.regexp_replace(x, r"^[0-9a-fA-FxX]+;", ""))) \
            .otherwise(F.concat(F.lit("&#"), x))
    return F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(F.split(c, "&#"), piece), "")).otherwise(c)


def decode_entities(c: Column) -> Column:
    c = decode_numeric(c)
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def visible_html(html: Column) -> Column:
    """HTML without scripts, styles and comments (they may hold fake tags)."""
    c = F.regexp_replace(html, r"(?is)<script\b.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style\b.*?</style>", "")
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def clean_text(c: Column) -> Column:
    return F.regexp_replace(decode_entities(strip_tags(c)), EDGE_SPACE, "")


def html_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                 flag_marker: str = "<img", with_scrape_time: bool = False) -> DataFrame:
    """One row per ``<p>`` block: page title, first heading, a Y/N presence
    flag and the paragraph text with its 1-based position.

    A paragraph runs from its ``<p>`` to the closing tag or the next ``<p>``;
    inner tags are removed and character references decoded.
    """
    vis = visible_html(F.col(html_col))
    title = clean_text(F.regexp_extract(vis, r"(?is)<title[^>]*>(.*?)</title>", 1))
    h1 = clean_text(F.regexp_extract(vis, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    flag = F.when(F.contains(F.col(html_col), F.lit(flag_marker)), "Y").otherwise("N")
    pieces = F.split(vis, r"<[pP](?:\s[^>]*)?>")
    paras = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    base = pages.select(F.col(id_col), title.alias("title"), h1.alias("heading"),
                        flag.alias("flag"), paras.alias("__p"))
    out = base.select(id_col, "title", "heading", "flag",
                      F.posexplode("__p").alias("__pos", "__raw"))
    body = F.element_at(F.split("__raw", "</[pP]\\s*>", 2), 1)
    body = F.split_part(body, F.lit("</article>"), F.lit(1))
    out = out.select(id_col, "title", "heading", "flag",
                     (F.col("__pos") + 1).cast("bigint").alias("para_pos"),
                     clean_text(body).alias("paragraph"))
    if with_scrape_time:
        out = out.withColumn("scrape_time", F.date_format(F.current_timestamp(), SCRAPE_TIME_FORMAT))
    return out


def _has_class(tag: Column, names: str) -> Column:
    """An opening tag whose class attribute holds all the names."""
    return functools.reduce(lambda a, b: a & b, (tag.rlike(
        rf"(?is)^<[a-z][^>]*\sclass\s*=\s*(\"[^\"]*(?<![\w-]){n}(?![\w-])|'[^']*(?<![\w-]){n}(?![\w-])|{n}[\s/>])")
        for n in names.split()))


def page_tokens(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(row, title, pos, token, depth): tags and texts of every page in order.

    ``depth`` is the number of elements open after the token, a running sum of
    the tag stack's pushes and pops; void and self-closed elements do not push.
    """
    vis = visible_html(F.col(html_col))
    title = clean_text(F.regexp_extract(vis, r"(?is)<title[^>]*>(.*?)</title>", 1))
    cut = F.regexp_extract_all(vis, F.lit(r"(?s)(<[^>]*>|[^<]+)"), 1)
    rows = (pages.select(F.monotonically_increasing_id().alias("row"), title.alias("title"), cut.alias("cut"))
            .select("row", "title", F.posexplode("cut").alias("pos", "token")))
    step = (F.when(F.col("token").startswith("</"), -1)
            .when(F.col("token").rlike(VOID_TAG) | F.col("token").rlike(r"(?s)^<[^>]*/>$"), 0)
            .when(F.col("token").rlike(r"^<[A-Za-z]"), 1).otherwise(0))
    return rows.withColumn("depth", F.sum(step).over(Window.partitionBy("row").orderBy("pos")))


def review_blocks(pages: DataFrame, html_col: str = "html", classes: dict = REVIEW_CLASSES) -> DataFrame:
    """One row per review block of stored pages, with the raw strings of its fields.

    Columns place (the page's title), reviewer, count, rating (the label of the
    stars), age, snippet, full and picture (Y / N).  A field is the first
    element of its class inside the block, from its tag to the tag that closes
    it, inner elements included; a missing one is null.  A page is bounded, and
    so is what is gathered for a block.
    """
    by_page = Window.partitionBy("row").orderBy("pos")
    opens = _has_class(F.col("token"), classes["block"])
    numbered = page_tokens(pages, html_col).withColumn("block", F.sum(opens.cast("int")).over(by_page))
    held = numbered.filter("block > 0").groupBy("row", "block").agg(
        F.min("title").alias("place"), F.sort_array(F.collect_list(F.struct("pos", "depth", "token"))).alias("all"))

    def until_closed(tokens, start):
        """The tokens after ``start`` and before its element closes."""
        after = F.filter(tokens, lambda x: x["pos"] > start["pos"])
        end = F.get(F.filter(after, lambda x: x["depth"] < start["depth"]), F.lit(0))["pos"]
        return T.let(end, lambda e: F.filter(after, lambda x: F.coalesce(x["pos"] < e, F.lit(True))))

    def said(tokens):
        return clean_text(F.array_join(F.transform(tokens, lambda x: F.when(
            x["token"].rlike(r"(?i)^<br\b"), "\n").when(x["token"].startswith("<"), "").otherwise(x["token"])), ""))

    def field(name, read):
        def found(tokens):
            start = F.get(F.filter(tokens, lambda x: _has_class(x["token"], classes[name])), F.lit(0))
            return T.let(start, lambda s: F.when(s.isNotNull(), read(tokens, s)))
        return T.let(F.col("own"), found).alias(name)

    def text(tokens, start):
        return said(until_closed(tokens, start))

    own = T.let(F.col("all"), lambda a: until_closed(a, F.get(a, F.lit(0))))
    label = r"(?is)\saria-label\s*=\s*\"([^\"]*)\""
    blocks = held.select("row", "block", "place", own.alias("own")).select(
        "row", "block", "place", *(field(n, text) for n in ("reviewer", "count", "age", "full")),
        field("body", text).alias("snippet"),
        field("rating", lambda _, s: decode_entities(F.regexp_extract(s["token"], label, 1))),
        F.coalesce(field("picture", lambda _, s: F.lit("Y")), F.lit("N")).alias("picture"))
    return blocks.drop("row", "block")


def page_reviews(pages: DataFrame, html_col: str = "html", scrape_time: Column | None = None,
                 classes: dict = REVIEW_CLASSES) -> DataFrame:
    """Stored review pages -> rows of ``schema.RAW_REVIEWS``."""
    return review_records(review_blocks(pages, html_col, classes), place="place", reviewer="reviewer", count="count",
                          rating="rating", age="age", snippet="snippet", full="full", picture="picture",
                          scrape_time=scrape_time)


def review_records(blocks: DataFrame, *, place: str, reviewer: str, count: str, rating: str, age: str,
                   snippet: str, full: str, picture: str, scrape_time: Column | None = None) -> DataFrame:
    """Text blocks of a review page -> rows of ``schema.RAW_REVIEWS``.

    The named columns hold the page's raw strings: the review count and rating
    labels are parsed, the "newest" marker is cut from the age, the full text
    is preferred to the snippet.  ``scrape_time`` defaults to now.
    """
    at = F.current_timestamp() if scrape_time is None else scrape_time
    return blocks.select(at.alias("ScrapeTime"), F.col(place).alias("RestName"), F.col(picture).alias("PicAttached"),
                      F.col(reviewer).alias("ReviewerName"),
                      F.coalesce(T.parse_count(count).cast("string"), F.lit("")).alias("TotalReviewsByUser"),
                      T.parse_rating(rating).alias("ReviewRating"), T.strip_suffix(age).alias("ReviewDate"),
                      prefer_full_text(F.col(full), F.col(snippet)).alias("ReviewDescription"))
