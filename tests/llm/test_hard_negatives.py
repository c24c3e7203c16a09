import math
import random

import pytest
from reviewlens.llm import hard_negatives as hn

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3) \
        .selectExpr("*", "'x' AS key", "'y' AS slice", "'z' AS vec", "1 AS block", "2 AS cell")


def brute(rows, every=100):
    held = []
    for vec_id, vec, label in rows:
        if vec_id is None or vec is None or label is None or any(
                x is None or not math.isfinite(x) for x in vec):
            continue
        row = (vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in vec))
        if row not in held:
            held.append(row)
    out = []
    for a in held:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in held if b is not a)
        for s, pid, _ in [x for x in scored if x[2] == a[1]][:5]:
            fit = [x for x in scored if x[2] != a[1] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a[0], pid, r + 1, n[1], -s, -n[0]) for r, n in enumerate(fit)]
    return sorted(out)


def rows_of(seed, n, dim, scale=1.0, labels=4):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        head = rng.choice(heads)
        # sixteenths are exact as floats and give many ties
        out.append((i * 10 + rng.randrange(3), [round(16 * (h + rng.gauss(0, scale / 3))) / 16 for h in head],
                    rng.randrange(labels)))
    return out


ODD = [(None, [1.0, 2.0], 1), (5000, None, 1), (5100, [1.0, None], 1), (5200, [1.0, float("nan")], 1),
       (5300, [float("inf"), 0.0], 1), (5400, [0.0, 0.0], 2), (5500, [], 2), (5600, [1.0], None),
       (5700, [0.5, 0.25, 1.0], 3), (5800, [-1.0, -1.0], 2), (5801, [-1.0, -2.0], 2)]


@pytest.mark.parametrize("block, step, region", [(512, 1024, 1 << 16), (3, 7, 40)])
def test_equals_brute_force(spark, monkeypatch, block, step, region):
    for name, value in (("BLOCK", block), ("STEP", step), ("REGION", region), ("SLICE", 2)):
        monkeypatch.setattr(hn, name, value)
    rows = rows_of(3, 260, 5) + ODD
    rows += rows[:12] + [(rows[0][0], [0.5] * 5, 1)] + [(20000 + i, rows[3][1], i % 3) for i in range(60)]
    got = sorted(tuple(r) for r in hn.hard_negatives(table(spark, rows), every=10).select(*COLUMNS).collect())
    want = brute(rows, every=10)
    assert len(want) > 200 and got == want


@pytest.mark.parametrize("scale", [0.01, 300.0, 200000.0])
def test_scores_are_exact_at_every_size(spark, scale):
    rows = rows_of(9, 60, 12, scale)
    got = sorted(tuple(r) for r in hn.hard_negatives(table(spark, rows), every=5).select(*COLUMNS).collect())
    assert got == brute(rows, every=5) and got


def test_empty_and_without_anchors(spark):
    assert hn.hard_negatives(table(spark, [])).collect() == []
    assert hn.hard_negatives(table(spark, [(1, [1.0], 1), (2, [1.0], 1)])).collect() == []
