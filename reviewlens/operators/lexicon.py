"""Dictionary segmentation (forward maximum matching) against a word table of any size.

At every place of a text the longest dictionary word that starts there is a
token, else any single character that is not white space; then the scan goes
on behind it.

Words that fit a bound (counted first) become one regular expression, the tree
of their common beginnings, so that a place costs its longest match and no
substring leaves its row.  More words go in three steps, all native:

1. the substrings of every length that the dictionary has are joined with the
   words (left semi), which leaves (row, place, length) for the places that hit;
2. these travel back to their row, which gets a string with a flag before each
   character: the longest word's length, or "1" (a character alone) or "0"
   (white space alone);
3. one regular expression, an alternative a flag, walks over that string.  It
   depends on the distinct lengths, not on the words, and is linear in the text.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PY_SPACE_CLASS
from ..functions.text import let
from ..session import counted_broadcast, materialize, row_name
from .text_ops import _keyed

#: flags of word lengths, ascending (any run of letters without meaning in a regular expression)
FIRST_FLAG = 0x4E00
ALONE, SPACE = "1", "0"


#: words and characters of a dictionary that is walked as one regular expression
TREE_WORDS, TREE_CHARS, TREE_DEPTH = 1 << 16, 1 << 20, 64


def _tree(words: list[str]) -> str:
    """A regular expression of the longest of ``words`` at a place: the tree of their characters."""
    def branch(part: list[str], at: int) -> str:
        ends = len(part[0]) == at
        groups = [(c, list(g)) for c, g in groupby(part[ends:], lambda w: w[at])]
        if not groups:
            return ""
        below = [_literal(c) + branch(g, at + 1) for c, g in groups]
        return f"(?:{'|'.join(below)}){'?' if ends else ''}" if ends or len(below) > 1 else below[0]
    return branch(sorted(set(words)), 0)


def _literal(c: str) -> str:
    """One character as it is, in a regular expression."""
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}"


def _bounded(words: DataFrame) -> list[str] | None:
    """The dictionary's words if they fit the bounds of a tree, else None."""
    n, chars, longest = words.agg(F.count("*"), F.sum(F.char_length("piece")),
                                  F.max(F.char_length("piece"))).first()
    if n > TREE_WORDS or (chars or 0) > TREE_CHARS or (longest or 0) > TREE_DEPTH:
        return None
    return [r[0] for r in words.collect()]


def _chars(text) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)


def _pieces(flags: dict[int, str]):
    """(pos, flag, piece) for every substring of the dictionary's lengths."""
    def cut(chars):
        def sized(n, flag):
            count = F.size(chars) - (n - 1)
            places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.struct(
                i.alias("pos"), F.lit(flag).alias("flag"),
                F.array_join(F.slice(chars, i, n), "").alias("piece")))
        return F.concat(*(sized(n, flag) for n, flag in flags.items()))
    return cut


def _walk(chars, hits, flags: dict[int, str]) -> Column:
    """Tokens of one text from its characters and its sorted hits (pos, flag)."""
    def flagged(longest):
        def body(plain):
            def upto(hit, j):
                before = F.when(j > 0, F.get(longest, j - 1)["pos"]).otherwise(F.lit(0))
                return F.concat(F.array_join(F.slice(plain, before + 1, hit["pos"] - before - 1), ""),
                                hit["flag"], F.element_at(chars, hit["pos"]))
            last = F.coalesce(F.get(longest, F.size(longest) - 1)["pos"], F.lit(0))
            return F.concat(F.array_join(F.transform(longest, upto), ""),
                            F.array_join(F.slice(plain, last + 1, F.size(plain) - last), ""))
        plain = F.transform(chars, lambda c: F.concat(
            F.when(c.rlike(f"^[{PY_SPACE_CLASS}]"), SPACE).otherwise(ALONE), c))
        return let(plain, body)

    # of the words that start at one place the longest comes last
    longest = F.filter(hits, lambda x, j: F.coalesce(F.get(hits, j + 1)["pos"] != x["pos"], F.lit(True)))
    steps = "|".join([f"[{ALONE}{SPACE}].", *(f"{flag}.{{{2 * n - 1}}}" for n, flag in flags.items())])
    found = F.regexp_extract_all(let(longest, flagged), F.lit(f"(?s)({steps})"), 1)
    return F.transform(F.filter(found, lambda x: ~F.startswith(x, F.lit(SPACE))),
                       lambda x: F.regexp_replace(x, "(?s).(.)", "$1"))


def segment(df: DataFrame, text_col: str, words: DataFrame, out_col: str = "tokens",
            id_col: str | None = None) -> DataFrame:
    """``df`` with the tokens of ``text_col`` by the dictionary ``words`` (its first column).

    Null and empty words are no words; a null text gives null, an empty one an
    empty array; an empty dictionary leaves single characters.  ``id_col`` is a
    unique key; without one the rows are written with a key first if a join is
    needed.  The word table is one regular expression within a counted bound,
    broadcast within a larger one and joined by a shuffle beyond.
    """
    columns = [c for c in df.columns if c != out_col]
    words = materialize(words.select(F.col(words.columns[0]).cast("string").alias("piece"))
                        .filter("piece <> ''").distinct(), "lexicon")
    listed = _bounded(words)
    if listed is not None:
        steps = "|".join([*([_tree(listed)] if listed else []), f"[^{PY_SPACE_CLASS}]"])
        return df.select(*columns, F.regexp_extract_all(text_col, F.lit(f"(?s)({steps})"), 1).alias(out_col))
    sizes = sorted(r[0] for r in words.select(F.char_length("piece")).distinct().collect())
    flags = {n: chr(FIRST_FLAG + j) for j, n in enumerate(sizes)}
    df, key = _keyed(df, id_col)
    at, hits, text = row_name(df, "at"), row_name(df, "hits"), F.col(text_col)
    none = F.array().cast("array<struct<pos:int,flag:string>>")
    if not sizes:
        out = df.withColumn(hits, none)
    else:
        found = (df.select(F.col(key).alias("row"), F.explode(let(_chars(text), _pieces(flags))).alias("p"))
                 .select("row", "p.*").join(counted_broadcast(words), "piece", "left_semi")
                 .groupBy(F.col("row").alias(at))
                 .agg(F.sort_array(F.collect_list(F.struct("pos", "flag"))).alias(hits)))
        out = df.join(found, F.col(key) == F.col(at), "left")
    tokens = F.when(text.isNotNull(), let(_chars(text), lambda c: let(
        F.coalesce(F.col(hits), none), lambda h: _walk(c, h, flags))))
    return out.select(*columns, tokens.alias(out_col))
