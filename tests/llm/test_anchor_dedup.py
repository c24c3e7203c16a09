import hashlib
from collections import Counter

import pytest
from corpora import frame, words
from reviewlens.llm.anchor_dedup import remove_repeats


def expected(rows, window):
    """Brute force: every window against all documents with a smaller id."""
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, y in zip(w, gone) if not y)
        out[i, len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [5, 13])
def test_matches_brute_force(docs, rows, window):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text, r.kept_sha256)
                  for r in remove_repeats(docs, window).collect())
    assert got == expected(rows, window)
    assert sum(n for (_, _, gone, *_), n in got.items() if gone) > 10


def test_empty_table(empty):
    assert remove_repeats(empty).collect() == []


def test_spans_are_maximal(spark):
    shared = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(shared), "en", "s", 0),
            (2, " ".join(["x"] + shared[:14] + ["y"] + shared[14:] + ["z"]), "en", "s", 0)]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows)).collect()}
    assert (got[2].n_spans, got[2].n_removed, got[2].kept_text) == (2, 30, "x y z")
    assert got[1].n_removed == 0
