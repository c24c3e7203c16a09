"""Table-level text operators: cleaning pipeline, stop words, phrase merge."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MORE_TOKEN, PHRASE_DELIMITER, TRANSLATION_MARKER
from ..functions import text as T
from ..session import counted_broadcast, materialize, row_name


def drop_null_text(df: DataFrame, text_col: str) -> DataFrame:
    return df.filter(F.col(text_col).isNotNull())


def drop_marked_text(df: DataFrame, text_col: str, marker: str = TRANSLATION_MARKER) -> DataFrame:
    """Drop rows whose text holds ``marker`` (null text is kept)."""
    return df.filter(~F.coalesce(F.contains(F.col(text_col), F.lit(marker)), F.lit(False)))


def drop_equal_null_safe(df: DataFrame, col: str, value: str = MORE_TOKEN) -> DataFrame:
    """Keep rows whose value is not ``value``; nulls are kept (``NaN != x``)."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def fill_text(df: DataFrame, cols) -> DataFrame:
    return df.na.fill("", [cols] if isinstance(cols, str) else list(cols))


def clean_reviews(df: DataFrame, *, text_col: str, rating_col: str,
                  stopwords: Iterable[str] = (), marker: str = TRANSLATION_MARKER,
                  removed_class: str = T.NOT_CJK_CLASS, tokenizer="word",
                  patterns=None, keep_empty: bool = False, drop_token: str | None = None,
                  age_col: str | None = None, anchor_col: str | None = None,
                  date_col: str = "review_date",
                  processed_col: str = "processed", label_col: str = "is_inducing") -> DataFrame:
    """The rule-labelling cleaning plan in one chained DataFrame plan.

    relative date (when ``age_col``) -> null filter -> marker filter ->
    promotion flag on the raw text -> label (rating 5 AND promotion) ->
    charset filter -> tokens -> stop words -> space-joined text.  Empty
    processed text is dropped unless ``keep_empty`` (the original kept it);
    ``drop_token`` drops rows whose processed text equals it (nulls kept).
    Catalyst pushes the filters below the date projection.
    """
    from .label import rule_label

    if age_col:
        df = df.withColumn(date_col, T.relative_time(F.col(age_col),
                                                     F.col(anchor_col) if anchor_col else None))
    kept = drop_marked_text(drop_null_text(df, text_col), text_col, marker)
    labelled = rule_label(kept, text_col=text_col, rating_col=rating_col,
                          patterns=patterns, label_col=label_col, keep_promo=False)
    cleaned = T.keep_charset(F.col(text_col), removed_class)
    tokens = T.remove_terms(T.tokenize(cleaned, tokenizer), stopwords)
    processed = T.join_tokens(tokens)
    if keep_empty:
        out = labelled.withColumn(processed_col, processed)
    else:
        # a generator cannot be copied into a pushed-down filter, so the text is cleaned once
        out = labelled.select("*", F.explode(F.filter(F.array(processed), lambda t: t != ""))
                              .alias(processed_col))
    if drop_token is not None:
        out = drop_equal_null_safe(out, processed_col, drop_token)
    return out


def clean_review_table(raw: DataFrame, stopwords: Iterable[str] = (), tokenizer="cjk_ngram",
                       with_restaurant: bool = False, keep_empty: bool = True,
                       drop_token: str | None = None) -> DataFrame:
    """Collected reviews (``schema.RAW_REVIEWS``) -> the cleaned review table.

    Reviewer names are renamed by the alias map, the relative age is
    resolved against the stored scrape time, and the output columns are
    those of ``schema.CLEANED_REVIEWS`` (with RestName first if asked).
    ``tokenizer`` is a mode of ``functions.text.tokenize``; the default cuts
    CJK text, from which the charset filter has taken every space.
    """
    from ..schema import apply_aliases, parse_scrape_time

    df = parse_scrape_time(apply_aliases(raw))
    out = clean_reviews(df, text_col="ReviewDescription", rating_col="ReviewRating",
                        stopwords=stopwords, tokenizer=tokenizer, keep_empty=keep_empty,
                        drop_token=drop_token, age_col="ReviewDate", anchor_col="ScrapeTime",
                        date_col="ReviewActualDate", processed_col="ProcessedReview",
                        label_col="IsInducing")
    cols = ["ReviewActualDate", "Reviewer", "ReviewRating", "ProcessedReview",
            F.col("IsInducing").cast("int").alias("IsInducing")]
    return out.select(*(["RestName"] if with_restaurant else []), *cols)


#: bits of the hashes that stand for a table beyond the broadcast bound
BITS = 1 << 26


def _keyed(df: DataFrame, id_col: str | None) -> tuple[DataFrame, str]:
    """``df`` with a unique key: ``id_col``, or one that is written with the rows."""
    if id_col is not None:
        return df, id_col
    key = row_name(df)
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _may_stand_in(entries: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``entries`` without most of those that ``table`` does not hold; none that it holds is lost.

    Hashes of the table's rows are bits of at most ``BITS / 64`` numbers, which are broadcast.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(BITS))
    at, bit = F.expr("shiftright(place, 6)"), F.expr("shiftleft(1L, cast(place % 64 AS int))").alias("bit")
    masks = table.select(place.alias("place")).select(at.alias("at"), bit).groupBy("at").agg(
        F.bit_or("bit").alias("mask"))
    marked = entries.withColumn("place", place).select("*", at.alias("word_at"), bit)
    # a semi join: the exact one after it would be pushed below an inner join
    return marked.join(F.broadcast(masks), (F.col("word_at") == F.col("at")) & (
        F.col("mask").bitwiseAND(F.col("bit")) != 0), "left_semi").select(entries.columns)


def _hits(held: DataFrame, entries, table: DataFrame, on: list[str]) -> DataFrame:
    """(at, hits): positions of each ``row`` whose entry stands in ``table``, in order.

    The table is broadcast within a counted bound and joined by a shuffle
    beyond it, which entries of other hashes do not take part in; only positions
    that hit travel on.
    """
    table = materialize(table.select(*on).dropna().distinct(), "table")
    near = counted_broadcast(table)
    places = (held.select("row", F.posexplode(T.let(F.col("t"), entries)).alias("pos", "e"))
              .select("row", "pos", *(F.col("e")[c].alias(c) for c in on)))
    if near is table:
        places = _may_stand_in(places, table, on)
    return (places.join(near, on, "left_semi")
            .groupBy(F.col("row").alias("at")).agg(F.sort_array(F.collect_list("pos")).alias("hits")))


def remove_stopwords(df: DataFrame, tokens_col: str, stop_df: DataFrame,
                     out_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """Stop-word removal against a stop-word table (first column) of any size.

    The positions of stop words travel back to their row and are taken out in
    place.  Null arrays stay null, null tokens and null stop words are dropped.
    ``id_col`` is a unique key; without one the rows are written with a key first.
    """
    columns = df.columns
    df, key = _keyed(df, id_col)
    held = df.select(F.col(key).alias("row"), F.col(tokens_col).alias("t"))
    found = _hits(held, lambda t: F.transform(t, lambda x: F.struct(x.alias("word"))),
                  stop_df.select(F.col(stop_df.columns[0]).alias("word")), ["word"])
    at, hits = row_name(df, "at"), row_name(df, "hits")
    found = found.select(F.col("at").alias(at), F.col("hits").alias(hits))

    def rest(t):
        n = F.size(t)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array_except(places, F.coalesce(hits, F.array().cast("array<int>"))),
                           lambda i: F.get(t, i))
    kept = F.when(F.col(tokens_col).isNotNull(), F.filter(T.let(F.col(tokens_col), rest), lambda x: x.isNotNull()))
    out = df.join(found, F.col(key) == F.col(at), "left").withColumn(out_col or tokens_col, kept)
    return out.select(*columns, *([out_col] if out_col and out_col not in columns else []))


def merge_phrases(df: DataFrame, tokens_col: str, phrases: DataFrame, id_col: str,
                  out_col: str = "merged", delimiter: str = PHRASE_DELIMITER) -> DataFrame:
    """Greedy left-to-right bigram merge against a phrase table (columns a, b).

    Neighbouring pairs are joined with the phrases; only the positions that hit
    travel back to their row, where the greedy choice and the merge happen in
    place.  A null or empty array gives an empty one.  ``id_col`` is unique;
    write the tokens first if they are dear to compute (they are read twice).
    """
    def pairs(t):
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.arrays_zip(F.slice(t, 1, n).alias("a"), F.slice(t, 2, n).alias("b"))

    # the key and the tokens get own names, so those of the caller cannot clash
    held = df.select(F.col(id_col).alias("row"),
                     F.coalesce(tokens_col, F.array().cast("array<string>")).alias("t"))
    found = _hits(held, pairs, phrases, ["a", "b"])
    merged = F.when(F.col("hits").isNull(), F.col("t")).otherwise(T.merge_at("t", "hits", delimiter))
    return held.join(found, F.col("row") == F.col("at"), "left").select("row", merged.alias("m")).toDF(
        id_col, out_col)
