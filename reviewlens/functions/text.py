"""Scalar text functions: ``Column -> Column``, all JVM-side.

Regex classes are written so that Java regex (Spark) and RE2 (the SQL
oracle) read them the same way as Python's ``re`` did in the original
scripts; see ``PY_SPACE_CLASS`` in :mod:`reviewlens.config`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    CJK_RANGE, EMOJI_RANGES, NEWEST_SUFFIX, PHRASE_DELIMITER,
    PROMO_PATTERNS, PY_SPACE_CLASS, RATING_PREFIX, RATING_SUFFIX,
    RELATIVE_UNITS, REVIEW_DATE_FORMAT,
)

ColumnOrName = Column | str

FULL_WIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"

WORD_TOKEN = r"([\p{L}\p{N}_]{2,})"
NON_SPACE = f"[^{PY_SPACE_CLASS}]"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    A lambda that refers to an outer expression re-evaluates it for every
    array element; binding it first keeps per-row work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _cp(code: int) -> str:
    return f"\\x{{{code:X}}}"


def code_point_class(ranges: Iterable[tuple[int, int]], negate: bool = False) -> str:
    parts = "".join(_cp(a) if a == b else f"{_cp(a)}-{_cp(b)}" for a, b in ranges)
    return f"[{'^' if negate else ''}{parts}]"


EMOJI_CLASS = code_point_class(EMOJI_RANGES)
NOT_CJK_CLASS = code_point_class([CJK_RANGE], negate=True)
CJK_RUN = "-".join(_cp(code) for code in CJK_RANGE)

#: ages of more units than this are not dates
MOST_UNITS = 100_000


def python_regex(pattern: str) -> str:
    """Translate the Python ``\\S`` / ``\\s`` shorthands to explicit classes.

    Python treats U+3000 and the other Unicode spaces as whitespace; Java's
    and RE2's shorthands do not, so the classes are spelled out.
    """
    return pattern.replace(r"\S", NON_SPACE).replace(r"\s", f"[{PY_SPACE_CLASS}]")


# --------------------------------------------------------------------- parsing

def first_int(c: ColumnOrName) -> Column:
    """First run of digits as a bigint (full-width digits count), else null."""
    digits = F.regexp_extract(F.translate(_col(c), FULL_WIDTH_DIGITS, ASCII_DIGITS),
                              r"([0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def parse_count(c: ColumnOrName) -> Column:
    """"1,234 則評論" -> 1234: keep the digits and cast."""
    digits = F.regexp_replace(_col(c), r"[^0-9]", "")
    return F.when(digits != "", digits.try_cast("bigint"))


def parse_rating(c: ColumnOrName) -> Column:
    """"評等：5.0 (最高：5)，" -> 5.0."""
    bare = F.replace(F.replace(_col(c), F.lit(RATING_PREFIX), F.lit("")),
                     F.lit(RATING_SUFFIX), F.lit(""))
    return bare.try_cast("double")


def strip_suffix(c: ColumnOrName, suffix: str = NEWEST_SUFFIX) -> Column:
    """Remove every occurrence of ``suffix`` (the "newest" marker)."""
    return F.replace(_col(c), F.lit(suffix), F.lit(""))


def relative_time(c: ColumnOrName, anchor: ColumnOrName | None = None,
                  fmt: str = REVIEW_DATE_FORMAT) -> Column:
    """Resolve "3 天前" style ages against ``anchor`` (default: now).

    Units are tested by containment in the fixed order; the count is the
    first integer in the text.  Text without a known unit passes through
    unchanged; a known unit without a number gives null.
    """
    text = _col(c)
    at = F.current_timestamp() if anchor is None else F.coalesce(_col(anchor), F.current_timestamp())
    n = first_int(text)
    out = None
    for unit, days, hours, minutes in RELATIVE_UNITS:
        # an age no calendar can hold gives null, it must not end the job
        held = F.when(n.between(0, MOST_UNITS), n)
        shifted = at - F.make_dt_interval((held * days).cast("int"), (held * hours).cast("int"),
                                          (held * minutes).cast("int"), F.lit(0))
        value = F.date_format(shifted, fmt)
        out = F.when(text.contains(unit), value) if out is None else out.when(text.contains(unit), value)
    return out.otherwise(text)


# -------------------------------------------------------------------- cleaning

def strip_emoji(c: ColumnOrName) -> Column:
    return F.regexp_replace(_col(c), EMOJI_CLASS + "+", "")


def keep_charset(c: ColumnOrName, removed_class: str = NOT_CJK_CLASS) -> Column:
    """Delete every character of ``removed_class`` (default: all but CJK)."""
    return F.regexp_replace(_col(c), removed_class, "")


def contains_marker(c: ColumnOrName, marker: str) -> Column:
    return F.contains(_col(c), F.lit(marker))


# ------------------------------------------------------------------ tokenising

def tokenize_word(c: ColumnOrName) -> Column:
    """Vectoriser tokens: lower case, runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_TOKEN), 1)


def tokenize_whitespace(c: ColumnOrName) -> Column:
    """``str.split()``: split on whitespace runs, no empty tokens."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), f"[{PY_SPACE_CLASS}]+")
    return F.filter(parts, lambda t: t != "")


def char_ngrams(c: ColumnOrName, n: int) -> Column:
    """All character n-grams of the whole text, in order.

    The text is split into code points once (linear), and each gram is a
    slice of that array, so long texts stay linear in their length.
    """
    def grams(chars):
        count = F.size(chars) - (n - 1)
        idx = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(idx, lambda i: F.array_join(F.slice(chars, i, n), ""))
    return let(F.regexp_extract_all(_col(c), F.lit("(?s)(.)"), 1), grams)


def join_tokens(tokens: ColumnOrName, sep: str = " ") -> Column:
    return F.array_join(_col(tokens), sep)


def cjk_ngrams(c: ColumnOrName, n: int = 2) -> Column:
    """Segment without a dictionary: CJK runs become overlapping ``n``-grams.

    Other runs of non-space characters stay whole; a CJK run shorter than
    ``n`` is one token.  Linear in the text.
    """
    pieces = F.regexp_extract_all(_col(c), F.lit(f"([{CJK_RUN}]+|[^{CJK_RUN}{PY_SPACE_CLASS}]+)"), 1)

    def cut(piece):
        def grams(chars):
            last = F.size(chars) - (n - 1)
            return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i:
                                                F.array_join(F.slice(chars, i, n), ""))).otherwise(F.array(piece))
        return F.when(piece.rlike(f"^[{CJK_RUN}]"), let(
            F.regexp_extract_all(piece, F.lit("(?s)(.)"), 1), grams)).otherwise(F.array(piece))
    return F.flatten(F.transform(pieces, cut))


def lexicon_segmenter(words: Iterable[str]):
    """Forward maximum matching over a dictionary, as one regular expression.

    Alternatives stand longest first, then any single character, so every
    position takes the longest word that starts there; white space separates.
    The dictionary is configuration: it travels in the plan.
    """
    words = sorted({w for w in words if w}, key=lambda w: (-len(w), w))
    pattern = "|".join([*(re.escape(w) for w in words), f"[^{PY_SPACE_CLASS}]"])
    return lambda c: F.regexp_extract_all(_col(c), F.lit(f"({pattern})"), 1)


#: the tokeniser modes by name; a dictionary segmenter is passed as a function
TOKENIZERS = {"word": tokenize_word, "whitespace": tokenize_whitespace, "cjk_ngram": cjk_ngrams}


def tokenize(c: ColumnOrName, mode="cjk_ngram") -> Column:
    """Tokens by mode: 'word', 'whitespace', 'cjk_ngram' or a function (lexicon_segmenter)."""
    if callable(mode):
        return mode(_col(c))
    if mode not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {mode!r}; use one of {sorted(TOKENIZERS)} or a function")
    return TOKENIZERS[mode](c)


def remove_terms(tokens: ColumnOrName, terms: Iterable[str]) -> Column:
    """Drop listed terms (and null tokens) from a token array, keeping order and duplicates.

    The list is inlined whatever its size; Catalyst turns the membership test
    into a hash set (``INSET``) inside the lambda.  A null array stays null.
    """
    terms = sorted(set(terms))
    if not terms:
        return F.filter(_col(tokens), lambda t: t.isNotNull())
    return F.filter(_col(tokens), lambda t: ~t.isin(terms))


def adjacent_pairs(tokens: ColumnOrName, sep: str = " ") -> Column:
    """["a","b","c"] -> ["a b", "b c"]; empty for fewer than two tokens."""
    t = _col(tokens)
    m = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, 1, m), F.slice(t, 2, m), lambda a, b: F.concat_ws(sep, a, b))


def merge_at(tokens: ColumnOrName, positions: ColumnOrName, delimiter: str = PHRASE_DELIMITER) -> Column:
    """Greedy left-to-right merge of the pairs that start at ``positions`` (0-based, ascending).

    Within a run of neighbouring positions the greedy scan merges the 1st, 3rd,
    5th ... pair; a left-to-right replace of "11" by "SX" over the flag string
    marks exactly those starts, in linear time.
    """
    def body(t, p):
        def ones(x, j):
            last = F.when(j > 0, F.get(p, j - 1)).otherwise(-1)
            return F.concat(F.repeat(F.lit("0"), x - last - 1), F.lit("1"))
        head = F.array_join(F.transform(p, ones), "")
        bits = let(head, lambda h: F.concat(h, F.repeat(F.lit("0"), F.size(t) - F.length(h))))
        marks = F.split(F.regexp_replace(bits, "11", "SX"), "")
        return let(marks, lambda m: _emit(t, m, F.size(t), delimiter))

    return let(_col(tokens), lambda t: let(_col(positions), lambda p: body(t, p)))


def merge_phrases(tokens: ColumnOrName, phrases: Iterable[str], sep: str = " ",
                  delimiter: str = PHRASE_DELIMITER) -> Column:
    """Merge adjacent tokens forming a listed phrase ("a b" -> "a_b").

    Three passes over the tokens: flag each pair with a hashed set lookup,
    mark the greedy starts with one regex replace over the flag string (see
    :func:`merge_at`), then keep and join.
    """
    phrases = sorted(set(phrases))
    if not phrases:
        return _col(tokens)

    def body(t):
        n = F.size(t)
        pairs = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        bits = F.array_join(F.transform(pairs, lambda i: F.when(
            F.concat(F.element_at(t, i), F.lit(sep), F.element_at(t, i + 1)).isin(phrases), "1")
            .otherwise("0")), "")
        marks = F.split(F.regexp_replace(F.concat(bits, F.lit("0")), "11", "SX"), "")
        return let(marks, lambda m: _emit(t, m, n, delimiter))

    return let(_col(tokens), body)


def _emit(t: Column, marks: Column, n: Column, delimiter: str) -> Column:
    def start(i):
        return F.element_at(marks, i).isin("S", "1")

    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    kept = F.filter(idx, lambda i: ~F.when(i > 1, start(i - 1)).otherwise(F.lit(False)))
    return F.transform(kept, lambda i: F.when(
        start(i) & (i < n), F.concat(F.element_at(t, i), F.lit(delimiter), F.element_at(t, i + 1)))
        .otherwise(F.element_at(t, i)))


# ------------------------------------------------------------------- matching

def promo_regex(patterns: Iterable[str] = PROMO_PATTERNS) -> str:
    """One alternation of all patterns: a single pass over the text."""
    return "|".join(f"(?:{python_regex(p)})" for p in patterns)


def matches_any(c: ColumnOrName, patterns: Iterable[str] = PROMO_PATTERNS) -> Column:
    return F.coalesce(_col(c).rlike(promo_regex(patterns)), F.lit(False))


def contains_any(c: ColumnOrName, features: Iterable[str]) -> Column:
    """True when any feature string is a substring of the text.

    One native path for any number; empty features are no features (every
    text would hold them).
    """
    feats = sorted({f for f in features if f})
    if not feats:
        return F.lit(False)
    # one literal, folded to an array once: thousands of literals would slow the planner
    arr = F.split(F.lit("\0".join(feats)), "\0")
    return F.coalesce(let(_col(c), lambda text: F.exists(arr, lambda f: F.contains(text, f))), F.lit(False))
