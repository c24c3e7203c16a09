import hashlib
from collections import Counter, defaultdict

from corpora import ODD, frame, words
from reviewlens.llm.line_spread import common_lines, remove_common_lines


def build():
    rows = []
    for i in range(300):
        lines = [f"own line {i}", f"site line {i % 20}", "everywhere\t!"]
        if i % 20 < 8:
            lines.append("on eight sites")
        if i % 20 < 7:
            lines += ["on seven sites"] * 3
        rows.append((i, "\n".join(lines) + ("\n" if i % 2 else ""), "en", f"s{i % 20}", 0))
    return rows + ODD + [(950, "everywhere\t!\n\n everywhere\t!", "en", None, 0)]


ROWS = build()


def expected(rows, least):
    sites = defaultdict(set)
    for _, t, _, s, _ in rows:
        for line in (t or "").split("\n"):
            if words(line):
                sites[line].add(s)
    out = Counter()
    for i, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if not (words(x) and len(sites[x]) >= least)]
        text = "\n".join(kept)
        out[i, len(lines), len(lines) - len(kept), text,
            hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_matches_brute_force(spark):
    got = Counter(tuple(r) for r in remove_common_lines(frame(spark, ROWS)).collect())
    assert got == expected(ROWS, 8)


def test_every_threshold_is_exact(spark):
    docs = frame(spark, ROWS)
    for least in (2, 7, 9, 21):
        got = Counter(tuple(r) for r in remove_common_lines(docs, min_sites=least).collect())
        assert got == expected(ROWS, least)


def test_many_sites(spark):
    """Far above the threshold the sketch decides, near it the exact count."""
    rows = [(i, f"common\nhalf {i % 2}", "en", f"s{i}", 0) for i in range(3000)]
    assert common_lines(frame(spark, rows), min_sites=1500).count() == 3
    assert common_lines(frame(spark, rows), min_sites=1501).count() == 1


def test_empty(empty):
    assert remove_common_lines(empty).collect() == []
