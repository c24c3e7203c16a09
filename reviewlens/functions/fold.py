"""ASCII folding (NFKD without marks) as native expressions.

Dropping everything beyond ASCII after a compatibility decomposition can be
done per code point: the order of marks, which the decomposition may change,
does not matter once they are dropped.  The map from code points to their ASCII
letters comes from Python's Unicode tables when the plan is built:

* code points without any ASCII part are removed by one regex class;
* code points that become one character are translated in one pass;
* the few hundred that become several (ligatures, fractions, units) are looked
  up one by one, in texts that hold any.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _col, code_point_class, let

NON_BMP = r"[\x{10000}-\x{10FFFF}]"


@functools.lru_cache(maxsize=1)
def _folds() -> dict[int, str]:
    """Code point -> its ASCII part, of all code points beyond ASCII that have one."""
    out = {}
    for code in range(128, sys.maxunicode + 1):
        if unicodedata.decomposition(chr(code)):
            part = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode("ascii")
            if part:
                out[code] = part
    return out


def _ranges(codes) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [tuple(r) for r in out]


def fold_to_ascii(c: ColumnOrName) -> Column:
    """NFKD-decomposed text without what is not ASCII."""
    folds = _folds()
    one = {k: v for k, v in folds.items() if len(v) == 1}
    many = {k: v for k, v in folds.items() if len(v) > 1}
    # the class has some hundred ranges, which ASCII characters need not be held against
    dropped = f"(?![\\x00-\\x7F]){code_point_class(_ranges(folds), negate=True)}"
    kept = F.regexp_replace(_col(c), dropped, "")
    single = F.translate(kept, "".join(map(chr, one)), "".join(one.values()))
    several = code_point_class(_ranges(many))
    table = F.str_to_map(F.lit("\x1f".join(f"{chr(k)}\x1e{v}" for k, v in many.items())),
                         F.lit("\x1f"), F.lit("\x1e"))

    def spelled(pieces):
        return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.element_at(table, p), p)), "")

    def whole(text):
        pieces = F.regexp_extract_all(text, F.lit(f"({several}|[\\x00-\\x7F]+)"), 1)
        return F.when(text.rlike(several), let(pieces, spelled)).otherwise(text)
    return let(single, whole)


def ascii_fold(c: ColumnOrName) -> Column:
    """Text holding any character beyond the BMP is folded to ASCII; other text stays as it is."""
    col = _col(c)
    return F.when(col.rlike(NON_BMP), fold_to_ascii(col)).otherwise(col)
