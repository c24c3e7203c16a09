"""Column -> Column functions (scalar, JVM-side unless noted)."""

from .text import (  # noqa: F401
    adjacent_pairs, char_ngrams, contains_any, first_int, join_tokens,
    keep_charset, matches_any, merge_at, merge_phrases,
    parse_count, parse_rating, promo_regex, python_regex, relative_time,
    remove_terms, strip_emoji, strip_suffix, tokenize_whitespace,
    tokenize_word,
)
