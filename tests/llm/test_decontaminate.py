import random
from collections import Counter

import numpy as np
import pytest
from corpora import frame, words
from pyspark.sql import functions as F
from reviewlens.llm.decontaminate import clean_documents, leaks

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]


def text(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


ITEMS = [(1, text(30)), (2, text(60)), (3, text(5)), (4, "a b c a b c a b c a b c a b c"),
         (5, None), (6, "only four words here"), (7, text(200)), (1, text(25))]
ITEMS.append((8, ITEMS[0][1]))


def noisy(t, edits):
    w = t.split()
    for k, kind in edits:
        if kind == "drop":
            del w[k]
        else:
            w.insert(k, "zzz")
    return " ".join(w)


LEAKY = [(1, text(40) + " " + ITEMS[0][1].upper() + " " + text(40)),
         (2, text(10) + "\n" + noisy(ITEMS[6][1], [(100, "drop"), (30, "add"), (150, "add")])),
         (3, noisy(ITEMS[1][1], [(30, "add")]) + " " + text(5)),
         (4, ITEMS[1][1] + " " + text(9) + " " + ITEMS[1][1] + " " + ITEMS[7][1]),
         (5, "x a b c a b c a b c a b c a b c a y"), (6, text(100)), (7, None), (8, ""),
         (9, ITEMS[2][1]), (10, " ".join(ITEMS[0][1].split()[:27])), (11, "only four words here"),
         (None, ITEMS[0][1]), (12, text(3) + " " + ITEMS[0][1]), (12, text(2) + " " + ITEMS[1][1]),
         (13, noisy(ITEMS[0][1], [(15, "add")]))]


def grams(t):
    w = [x.lower() for x in words(t)]
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def expected(docs, items, percent=80):
    """Best window over every start, for every document and item."""
    out = Counter()
    for i, t in docs:
        g = grams(t)
        for k, it in items:
            want = Counter(grams(it))
            n, best = sum(want.values()), None
            if not n or not g:
                continue
            for s in range(max(1, len(g) - n + 1)):
                have = Counter(g[s:s + n])
                shared = sum((have & want).values())
                union = sum(have.values()) + n - shared
                if 100 * shared >= percent * union and (best is None or shared / union > best[0]):
                    best = (shared / union, s)
            if best:
                out[i, k, round(best[0], 9)] += 1
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in LEAKY])
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("gram", F.lit("x"))
    return docs, items


def test_matches_brute_force(tables):
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in leaks(*tables).collect())
    assert got == expected(LEAKY, ITEMS)
    assert len(got) >= 8


def inserted(n, added):
    """An item, and a text that holds it with edited ends and words added in its middle."""
    item = text(n)
    w = item.split()
    w[1] = w[-2] = "zzz"
    w[n // 2:n // 2] = text(added).split()
    return item, text(40) + " " + " ".join(w) + " " + text(40)


def test_best_window_between_anchors(spark):
    """Words added inside or halves swapped: the best window starts at no shared shingle's start."""
    pairs = [inserted(n, k) for n, k in ((76, 4), (80, 4), (94, 6), (120, 8), (200, 12))]
    w = text(90).split()
    pairs.append((" ".join(w), text(30) + " " + " ".join(w[45:] + w[:45]) + " " + text(30)))
    items = [(i, item) for i, (item, _) in enumerate(pairs)]
    texts = [(i, t) for i, (_, t) in enumerate(pairs)]
    want = expected(texts, items)
    assert {(0, 0), (2, 2), (5, 5)} <= {(i, k) for i, k, _ in want}
    got = leaks(frame(spark, [(i, t, "en", "s", 0) for i, t in texts]),
                spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got) == want


def test_plan_has_no_python(tables, capsys):
    leaks(*tables).explain()
    assert "Python" not in capsys.readouterr().out


def test_clean_documents_drop_exactly_the_leaks(tables):
    bad = {i for i, _, _ in expected(LEAKY, ITEMS)}
    kept = clean_documents(*tables)
    assert kept.columns == tables[0].columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        i for i, _ in LEAKY if i not in bad)


def test_empty_tables(tables, empty):
    docs, items = tables
    assert leaks(empty, items).collect() == []
    assert leaks(docs, items.limit(0)).collect() == []
    assert clean_documents(docs, items.limit(0)).count() == len(LEAKY)


def near_sets(rng, n, repeats):
    """Two shingle lists of size ``n`` at the least shared part that reaches 0.8; ``repeats`` of each shingle."""
    changed = n - -(-8 * n // 9)
    draw = np.repeat(rng.integers(-2 ** 63, 2 ** 63, -(-n // repeats)), repeats)[:n]
    other = draw.copy()
    for i in rng.choice(n, changed, replace=False):     # single occurrences change
        other[i] = rng.integers(-2 ** 63, 2 ** 63)
    return draw.tolist(), other.tolist()


def test_radius_keeps_pairs_at_the_threshold(spark):
    from reviewlens.llm.decontaminate import RADIUS, simhash
    rng = np.random.default_rng(9)
    rows = [(n, *near_sets(rng, n, repeats)) for n in (9, 18, 27, 45, 90, 180) for repeats in (1, 2, 3)
            for _ in range(100)]
    far = spark.createDataFrame(rows, "n int, a array<bigint>, b array<bigint>").select(
        "n", F.bit_count(simhash(F.col("a")).bitwiseXOR(simhash(F.col("b")))).alias("far"))
    assert [r for r in far.collect() if r.far > RADIUS] == []
