import itertools
import random
from collections import Counter

import pytest
from corpora import FOLD, frame, words
from reviewlens.llm import jaccard_join
from reviewlens.llm.components import components
from reviewlens.llm.jaccard_join import similarity_groups


def shingles(text, k=5):
    w = words((text or "").translate(FOLD))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def expected(rows, percent=80):
    """Brute force over all pairs of rows."""
    sets = [shingles(t) for _, t, *_ in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i), r[0]) if sets[i] and r[0] is not None
                    else r[0], links[i]) for i, r in enumerate(rows))


def groups(docs, **options):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links)
                   for r in similarity_groups(docs, **options).collect())


@pytest.mark.parametrize("percent", [80, 60])
def test_matches_brute_force(docs, rows, percent):
    got = groups(docs, percent=percent)
    assert got == expected(rows, percent)
    assert sum(n for (i, _, c, _), n in got.items() if i != c) > 20


@pytest.mark.parametrize("long_list, chunk", [(16384, 2048), (2, 3), (3, 1)])
def test_all_links_of_a_large_group(spark, monkeypatch, long_list, chunk):
    """Near copies with one to three edits, copies of them, and two groups that share a passage."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rng = random.Random(7)
    n = 260 if chunk > 1000 else 40
    base = [[f"{g}w{i}" for i in range(90)] for g in "ab"]
    base[1][:60] = base[0][:60]
    rows = []
    for i in range(n):
        w = list(base[i % 2])
        for e in range(rng.randint(0, 3)):
            w[rng.randrange(90)] = f"x{i}e{e}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = groups(frame(spark, rows))
    assert got == expected(rows)
    assert sum(links for *_, links in got.elements()) > 3 * n
    pairs = jaccard_join.link_pairs(frame(spark, rows)).collect()
    sets = {}
    for i, text, *_ in rows:
        sets.setdefault(shingles(text), i)
    assert {(r.a, r.b): round(r.similarity, 9) for r in pairs} == {
        (min(i, j), max(i, j)): round(len(a & b) / len(a | b), 9)
        for (a, i), (b, j) in itertools.combinations(sets.items(), 2) if 100 * len(a & b) >= 80 * len(a | b)}
    assert len({(r.a, r.b) for r in pairs}) == len(pairs)


def test_chain_of_near_copies(spark, monkeypatch):
    """A links b, b links c, a does not link c: one component, through every splitting step."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 2)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(12):
        w = list(base)
        w[10:10 + 3 * i] = [f"v{j}" for j in range(3 * i)]
        rows.append((i, " ".join(w), "en", "s", 0))
    assert groups(frame(spark, rows)) == expected(rows)


def test_no_partner_and_empty(spark, empty):
    rows = [(1, "a b c d e f g", "en", "s", 0), (2, "h i j k l m n", "en", "s", 0)]
    assert groups(frame(spark, rows)) == expected(rows)
    assert similarity_groups(empty).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55)],
                                  "a long, b long")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50}
