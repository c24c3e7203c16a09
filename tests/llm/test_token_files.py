import zlib

import numpy as np
import pytest
from corpora import frame
from hypothesis import given, settings
from hypothesis import strategies as st
from reviewlens.llm.token_files import (Segment, WordEncoder, pack, read_token_files, segment,
                                        segments, unpack, write_token_files)

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=80, deadline=None)
def test_pack_round_trip(bits, ids):
    ids = np.array(ids, np.uint64) & np.uint64((1 << bits) - 1)
    data = pack(ids, bits)
    assert len(data) == -(-len(ids) // 64) * bits * 8
    assert (unpack(data, bits, len(ids)) == ids).all()


def test_segment_random_access():
    rng = np.random.default_rng(0)
    sizes = [1, 5000, 0, 3, 9000]
    ids = rng.integers(0, 49408, sum(sizes)).astype(np.uint32)
    ends = np.cumsum(sizes)
    buf = segment([7, 8, None, 9, 10], ends, ids, 16) + b"\n" + segment([1], np.array([2]),
                                                                        ids[:2], 16) + b"\n"
    both = list(segments(buf))
    assert len(both) == 2 and both[1].ids(0, 2).tolist() == ids[:2].tolist()
    one = Segment(buf)
    assert one.known.tolist() == [1, 1, 0, 1, 1] and one.blocks == 4
    for i, (a, z) in enumerate(zip(np.append(0, ends[:-1]), ends)):
        assert (one.document(i) == ids[a:z]).all()
    for a, z in ((0, 1), (4095, 4097), (5000, 14000), (14003, 14004)):
        assert (one.ids(a, z) == ids[a:z]).all()


def test_words_encode_like_whole_texts():
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(PATH)
    texts = ["It's the ÉCOLE, don't!! 42 a|b <|endoftext|> x", "Straße... ÀÖ ÿ·µ ª ﬂ İstanbul Σας",
             "naïve été     tabs\tand\x0blines\x85 a​b 日本語 🙂👍 don't'll ",
             "", "   ", "|||", "word.,;:", "ALL CAPS!?", "x" * 300]
    encode = WordEncoder(PATH)
    for t in texts:
        got = b"".join(encode[w] for w in t.encode().split())
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(
            t, add_special_tokens=False).ids, t


def expected(rows):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(PATH)
    at, out = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_round_trip(spark, docs, rows, tmp_path):
    path = write_token_files(docs, str(tmp_path / "ids"), PATH, 2)
    got = read_token_files(spark, path, with_ids=True).collect()
    unique = [r for r in rows if r[0] != 906]
    assert len(got) == len(rows)
    want = {i: (n, c) for i, _, n, c in expected(unique)}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got if r.doc_id != 906} == want
    ordered = sorted(got, key=lambda r: r.start)
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert ids == sorted(ids)
    at = 0
    for r in ordered:
        assert r.start == at and len(r.ids) == r.n_tokens
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at += r.n_tokens


def test_starts_are_exact(spark, rows, tmp_path):
    unique = [r for r in rows if r[0] not in (906, None)]
    path = write_token_files(frame(spark, unique), str(tmp_path / "ids"), PATH, 2)
    got = sorted(tuple(r) for r in read_token_files(spark, path).collect())
    assert got == sorted(expected(unique))


def test_empty_table(spark, empty, tmp_path):
    path = write_token_files(empty, str(tmp_path / "ids"), PATH, 2)
    assert read_token_files(spark, path).collect() == []


def test_workers_give_memory_back(monkeypatch):
    import pyarrow as pa
    from reviewlens.llm import token_files as TF
    given = []
    monkeypatch.setattr(TF, "release", lambda: given.append(1))
    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, None], pa.int64()), pa.array(["a b", None, "c"])],
                                       ["doc_id", "text"])
    (row,) = TF._segments(path, 2, 16)(iter([batch]))
    part = TF.Segment(row.column(0)[0].as_buffer())
    assert part.n_docs == 3 and part.document(1).tolist() == [2] and given
    given.clear()
    read = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([row.column(0)[0].as_py() + b"\n"])],
                                      ["file", "content"])
    (rows,) = TF._documents(False)(iter([read]))
    assert rows.column("doc_id").to_pylist() == [1, 2, None] and given
    assert TF.CACHE_WORDS <= 50_000


def test_letters_are_encoded_once_a_slice(monkeypatch):
    """Words beyond the memory, and words that differ in case or marks, cost one call of the library."""
    import pyarrow as pa
    from reviewlens.llm import token_files as TF
    from tokenizers import Tokenizer
    monkeypatch.setattr(TF, "CACHE_WORDS", 2)
    plain = Tokenizer.from_file(PATH)
    encode, calls = WordEncoder(PATH), []
    model = encode.model

    class Counted:
        def tokenize(self, core):
            calls.append(core)
            return model.tokenize(core)
    encode.model = Counted()
    monkeypatch.setattr(TF, "_encoder", lambda path: encode)
    texts = ["Qwvbzu qwvbzu, QWVBZU! xéqrt### Xéqrt", "zzkqw xéqrt'' ZZKQW@{~ qwvbzu\"' zzkqw"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    (row,) = TF._segments(PATH, 2, 16)(iter([batch]))
    part = Segment(row.column(0)[0].as_buffer())
    for i, t in enumerate(texts):
        assert part.document(i).tolist() == plain.encode(t, add_special_tokens=False).ids + [2]
    assert len(calls) == 3 and len(encode) == 2


def test_trim_keeps_the_first(monkeypatch):
    from reviewlens.llm import token_files as TF
    monkeypatch.setattr(TF, "CACHE_WORDS", 2)
    monkeypatch.setattr(TF, "CACHE_CORES", 3)
    encode = WordEncoder(PATH)
    for w in b"aq! bq? cq; dq".split():
        assert encode[w]
    encode.trim()
    assert list(encode) == [b"aq!", b"bq?"] and list(encode.cores) == ["aq", "bq", "cq"] and len(encode.marks) <= 3
