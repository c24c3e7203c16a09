import random
from collections import Counter

import numpy as np
import pytest
from corpora import ODD, frame, words
from reviewlens.llm.outlier_rules import chi2_cdf, chi2_quantile, fit, quality_verdicts

RNG = random.Random(8)
VOCAB = ["".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randint(2, 9))) for _ in range(900)]


def prose(n):
    return "\n".join(" ".join(RNG.choice(VOCAB) for _ in range(12)) for _ in range(n // 12 + 1))


def build():
    rows = [(i, prose(RNG.randint(60, 300)), ["en", "de"][i % 2], f"s{i % 4}", 0)
            for i in range(400)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(100).split()), "en", "s0", 0)
            for i in range(20)]
    rare = [(2000 + i, prose(100), "fr", None, 0) for i in range(3)]
    rare += [(2100, prose(100), None, "s0", 0)]
    return rows + junk + rare + ODD


ROWS = build()


@pytest.fixture(scope="module")
def verdicts(spark):
    return quality_verdicts(frame(spark, ROWS)).collect()


def base(text):
    w = words(text)
    runs = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    cover = {k + t for k in range(len(w) - 2) if runs[tuple(w[k:k + 3])] > 1 for t in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(cover),
            len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_base_statistics(verdicts):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                   r.n_repeat_words, r.base_failed) for r in verdicts)
    assert got == Counter((r[0], *base(r[1])) for r in ROWS)


def test_junk_goes_and_prose_stays(verdicts):
    kept = {r.doc_id: r.kept for r in verdicts if not r.base_failed}
    assert not any(kept[1000 + i] for i in range(20))
    assert np.mean([kept[i] for i in range(400)]) > 0.99
    assert all(kept[i] for i in (2000, 2001, 2002, 2100))
    assert not any(r.kept for r in verdicts if r.base_failed)


def test_each_statistic_rejects_alone(spark):
    """Symbols, repeated lines or repeated runs suffice, in a small and in a larger group."""
    rows = []
    for source, n in (("small", 80), ("large", 400)):
        first = len(rows)
        rows += [(first + i, prose(RNG.randint(60, 300)), "en", source, 0) for i in range(n)]
        for i in range(4):
            # as many short lines of one kind as prose lines: words stand in no repeated run
            lines = "\n".join(line + "\nread more" for line in prose(240).split("\n"))
            run = " ".join(prose(22).split()[:22])
            runs = prose(60) + " " + run + " " + prose(12) + " " + run
            symbols = " ".join(w + "#" * (k % 5 == 0) for k, w in enumerate(prose(100).split()))
            rows += [(10000 + first + 3 * i + k, t, "en", source, 0)
                     for k, t in enumerate((lines, runs, symbols))]
    got = quality_verdicts(frame(spark, rows)).collect()
    assert not any(r.base_failed for r in got)
    assert [r.doc_id for r in got if r.doc_id >= 10000 and r.kept] == []
    assert np.mean([r.kept for r in got if r.doc_id < 10000]) > 0.99
    for r in got:
        if r.doc_id >= 10000:
            assert [r.n_dup_lines > 0, r.n_repeat_words > 20, r.n_symbols > 0].count(True) == 1


def test_estimate_resists_outliers(spark):
    """A quarter of far rows must not move the fitted centre or widen the ellipse."""
    rng = np.random.default_rng(3)
    cov = np.array([[1, .5, 0, 0], [.5, 1, 0, 0], [0, 0, 1, -.3], [0, 0, -.3, 1]]) * 100
    x = rng.multivariate_normal([5, 1, -2, 0], cov, 6000)
    x[:1200] += 300
    rows = [(g, *map(float, v)) for g in (1, 2) for v in x]
    got = fit(spark.createDataFrame(rows, "g long, x0 double, x1 double, x2 double, x3 double"))
    for r in got.collect():
        assert np.abs(np.array(r.mean) - [5, 1, -2, 0]).max() < 1.5
        found = np.linalg.inv(np.array(r.inverse).reshape(4, 4))
        assert np.abs(found - cov).max() < 20


def test_quantiles():
    assert chi2_cdf(chi2_quantile(0.75, 4), 4) == pytest.approx(0.75)
    assert chi2_quantile(0.5, 4) == pytest.approx(3.35669, abs=1e-4)


def test_empty(empty):
    assert quality_verdicts(empty).collect() == []


def reference_mcd(x, rng, starts=300):
    """Smallest covariance determinant over many random starts, then the reweighted estimate."""
    from reviewlens.llm import outlier_rules as R
    dims, n = R.DIMS, len(x)
    h = int(np.ceil(R.SUPPORT * n))

    def estimate(rows, scale):
        cov = np.cov(rows.T, bias=True) * scale + np.diag(np.square(R.FLOOR))
        return rows.mean(0), np.linalg.inv(cov)

    def distance(mean, inverse):
        return np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
    half, wide = R.chi2_quantile(R.SUPPORT, dims), R.chi2_quantile(0.975, dims)
    raw, best = R.SUPPORT / R.chi2_cdf(half, dims + 2), None
    for _ in range(starts):
        chosen = rng.choice(n, dims + 1, replace=False)
        for _ in range(50):
            again = np.argsort(distance(*estimate(x[chosen], raw)), kind="stable")[:h]
            if set(again) == set(chosen):
                break
            chosen = again
        inverse = estimate(x[chosen], raw)[1]
        if best is None or np.linalg.slogdet(inverse)[1] > best[0]:
            best = np.linalg.slogdet(inverse)[1], chosen
    inside = distance(*estimate(x[best[1]], raw)) <= wide
    mean, inverse = estimate(x[inside], 0.975 / R.chi2_cdf(wide, dims + 2))
    return mean, inverse, distance(mean, inverse)


def test_fit_agrees_with_reference_determinant_search(spark):
    from reviewlens.llm import outlier_rules as R
    rng = np.random.default_rng(4)
    groups, names = {}, [f"x{i}" for i in range(R.DIMS)]
    for g, (n, bad) in enumerate([(240, 0.0), (300, 0.1), (200, 0.2)]):
        mix = rng.normal(size=(R.DIMS, R.DIMS)) + 2 * np.eye(R.DIMS)
        x = rng.normal(size=(n, R.DIMS)) @ mix + rng.normal(size=R.DIMS)
        x[:int(n * bad)] += 40 + rng.normal(size=(int(n * bad), R.DIMS))
        groups[g] = x
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    df = spark.createDataFrame(rows, "g long, " + ", ".join(f"{n} double" for n in names))
    fits = {r.g: (np.array(r["mean"]), np.array(r.inverse).reshape(R.DIMS, R.DIMS)) for r in R.fit(df).collect()}
    assert set(fits) == set(groups)
    for g, x in groups.items():
        mean, inverse, d2 = reference_mcd(x, rng)
        got_mean, got_inverse = fits[g]
        got = np.einsum("ni,ij,nj->n", x - got_mean, got_inverse, x - got_mean)
        spread = np.sqrt(np.diag(np.linalg.inv(inverse)))
        assert (np.abs(got_mean - mean) < 0.1 * spread).all()
        assert 0.8 < np.linalg.det(got_inverse) / np.linalg.det(inverse) < 1.25
        assert ((got > R.CUTOFF) == (d2 > R.CUTOFF)).all()
