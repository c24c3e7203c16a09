import numpy as np
import pyarrow as pa
from corpora import FOLD, words
from hypothesis import given, settings
from hypothesis import strategies as st
from reviewlens.llm import common as C

TEXT = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbé ß\t\n\x0b\x1c 日🙂."), max_size=30)),
                max_size=8)


@given(TEXT)
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts):
    data, offs = C.text_buffer(pa.array(texts, pa.string()))
    start, end, ptr = C.word_spans(data, offs)
    found = [[data[a:b].tobytes().decode() for a, b in zip(start[x:y], end[x:y])]
             for x, y in zip(ptr[:-1], ptr[1:])]
    assert found == [words(t) for t in texts]
    for lower in (False, True):
        h = C.word_hashes(data, start, end, lower)
        flat = [w.translate(FOLD) if lower else w for t in found for w in t]
        assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


@given(st.lists(st.integers(0, 40), max_size=6), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_window_starts(counts, k):
    ptr = np.append(0, np.cumsum(counts)).astype(np.int64)
    want = [p + i for p, n in zip(ptr, counts) for i in range(n - k + 1)]
    assert C.window_starts(ptr, k).tolist() == want


def test_long_texts_hash_in_blocks(monkeypatch):
    text = pa.array(["ab cd " * 500 + "x" * 300 + " ab"])
    data, offs = C.text_buffer(text)
    start, end, _ = C.word_spans(data, offs)
    whole = C.word_hashes(data, start, end)
    monkeypatch.setattr(C, "BLOCK", 64)
    assert (C.word_hashes(data, start, end) == whole).all()
    assert whole[0] == whole[2] == whole[-1]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), max_size=30))
@settings(max_examples=80, deadline=None)
def test_dealt_rows_keep_segments(segments):
    bucket = np.array([b for b, _ in segments], np.uint64)
    counts = np.array([n for _, n in segments], np.int64)
    values = np.arange(counts.sum(), dtype=np.uint32)
    out = C.deal(bucket, counts, {"v": values}, i=np.arange(len(segments), dtype=np.int64))
    if not segments:
        assert out is None
        return
    got = {}
    for b, i, n, v in zip(*(out.column(c) for c in ("bucket", "i", "counts", "v"))):
        at = 0
        v = np.frombuffer(v.as_py(), np.uint32)
        for k, m in zip(np.frombuffer(i.as_py(), np.int64), np.frombuffer(n.as_py(), np.uint32)):
            got[int(k)] = (b.as_py(), v[at:at + m].tolist())
            at += m
    first = np.cumsum(counts) - counts
    assert got == {i: (b, values[first[i]:first[i] + n].tolist())
                   for i, (b, n) in enumerate(segments)}
