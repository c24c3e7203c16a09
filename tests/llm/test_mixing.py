from collections import Counter, defaultdict

import numpy as np
import pytest
from corpora import frame, words
from hypothesis import given, settings
from hypothesis import strategies as st
from reviewlens.llm.mixing import Mix, permute, quota, shard_counts, targets


@given(st.integers(1, 5000), st.integers(0, 2**63))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    got = permute(np.arange(n), n, key)
    assert sorted(got.tolist()) == list(range(n))
    assert (permute(got, n, key, inverse=True) == np.arange(n)).all()


@given(st.integers(1, 3000), st.integers(0, 3), st.integers(1, 64))
@settings(max_examples=100, deadline=None)
def test_quota_is_exact(size, times, block):
    for words_ in {size * times, min(3 * size, size * times + size // 3), max(size * times - 1, 0)}:
        if not words_:
            continue
        slots, trim = quota(size, words_, block, 7, 3)
        n = -(-size // block)
        from reviewlens.llm.mixing import _key
        got = 0
        for j in range(slots):
            b = int(permute(np.array([j % n]), n, _key(7, 3, j // n))[0])
            got += min(block, size - b * block)
        assert got - trim == words_ and 0 <= trim < block


def test_targets():
    got = targets({"a": 100, "b": 1000, "c": 10}, {"a": 1, "b": 2, "c": 3})
    assert got["c"] == 30 and got["a"] == 300
    assert sum(got.values()) == 1110 and got["b"] == 780
    assert targets({"a": 0, "b": 5}, {"a": 1, "b": 1}) == {"a": 0, "b": 5}
    assert targets({}, {}) == {}


def test_shards_use_up_every_slot():
    slots = np.array([0, 5, 1000, 37])
    got = shard_counts(slots, 16, 3)
    assert (got.sum(axis=0) == slots).all() and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 1


@pytest.fixture(scope="module", params=[4, 64])
def mix(docs, request):
    return Mix(docs, block_words=request.param, shards=7)


def test_taken_meets_targets(mix, rows):
    got = mix.taken().collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter(
        (i, s, len(words(t))) for i, t, _, s, _ in rows)
    size, taken, goal = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = targets(size, {s: i % 3 + 1 for i, s in enumerate(order)})
    for s in order:
        assert goal[s] == pytest.approx(float(want[s])) and abs(taken[s] - goal[s]) <= 0.5
    assert all(r.source_size == size[r.source] for r in got)


def test_blocks_and_documents_hold_the_same_words(mix, rows):
    taken = defaultdict(int)
    for r in mix.taken().collect():
        taken[r.source] += r.taken
    blocks = mix.blocks().collect()
    per = Counter()
    for r in blocks:
        per[r.source] += len(words(r.text))
    assert {s: n for s, n in taken.items() if n} == dict(per)
    slots = Counter((r.shard, r.slot) for r in blocks)
    assert max(slots.values()) == 1
    documents = mix.documents().collect()
    assert Counter(w for r in blocks for w in words(r.text)) == Counter(
        w for r in documents for w in words(r.text))
    whole = {(i, t) for i, t, *_ in rows}
    sizes = Counter()
    for r in documents:
        sizes[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    by_doc = Counter()
    for r in mix.taken().collect():
        by_doc[r.doc_id] += r.taken
    assert dict(+by_doc) == dict(+sizes)
    assert any((r.doc_id, r.text) in whole for r in documents)


def test_reruns_agree(docs):
    one, two = (Counter(tuple(r) for r in Mix(d, block_words=8).taken().collect())
                for d in (docs, docs.repartition(5)))
    assert one == two


def test_empty_and_wordless(spark, empty):
    assert Mix(empty).taken().collect() == []
    got = Mix(frame(spark, [(1, None, "en", "s", 0), (2, " ", "en", "s", 1)])).taken().collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2
