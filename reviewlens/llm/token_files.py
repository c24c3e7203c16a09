"""Token ids in fixed-width bit-packed files.

Documents are encoded in ascending ``doc_id`` order and every id is stored in
the fewest bits that hold the vocabulary.  A file is a run of segments, each
followed by one line feed; a segment is, little-endian:

    8 bytes   magic ``FIXBITS1``
    u32 u32   bits per id, ids per block (a multiple of 64)
    u64 x 3   documents, ids, blocks
    i64 x d   doc_id of each document        u8 x d  1 if the id is not null
    u64 x d   ids up to the end of each document, from the segment's start
    u64 x b+1 byte offset of each block in the payload
    payload   blocks: 64 ids fill ``bits`` 64-bit words; the last block is padded

Any id or document is reached by its block offset alone, and whole blocks
unpack with a few numpy shifts.  Files are numbered in id order, so the global
position of a document is the sum of the files before it plus its local start.
Spark's own writer commits the files: a lost executor's task is done again.

Defined results: null or empty text encodes to the end id alone; a null
``doc_id`` sorts first; rows that repeat a ``doc_id`` follow each other, by
text hash; extra columns are ignored; an empty table gives no documents.
"""

from __future__ import annotations

import builtins
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import (binary, release, ship, short_batches, shuffle_width, text_buffer, text_slices,
                     texts, written)

MAGIC, HEAD = b"FIXBITS1", "<8sIIQQQ"
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 19
#: words that a Python worker remembers from one slice of texts to the next; others are encoded once a slice
CACHE_WORDS = 50_000
#: cores of words (letters without closing marks, lower case) and runs of marks it remembers
CACHE_CORES = 100_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Pack ids (padded to a multiple of 64) into ``bits`` bits each."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[:len(ids)] = ids
    out = np.zeros((len(rows), bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(payload, bits: int, n: int) -> np.ndarray:
    """First ``n`` ids of packed bytes."""
    words = np.frombuffer(payload, "<u8")
    words = words[:len(words) // bits * bits].reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = v & mask
    return out.reshape(-1)[:n].astype(np.uint32)


def segment(doc_ids: list, ends: np.ndarray, ids: np.ndarray, bits: int,
            block_ids: int = BLOCK_IDS) -> bytes:
    blocks = -(-len(ids) // block_ids)
    payload = pack(ids, bits)
    offsets = np.minimum(np.arange(blocks + 1, dtype=np.uint64) * np.uint64(block_ids * bits // 8),
                         np.uint64(len(payload)))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    plain = np.array([0 if x is None else x for x in doc_ids], "<i8")
    return b"".join([struct.pack(HEAD, MAGIC, bits, block_ids, len(doc_ids), len(ids), blocks),
                     plain.tobytes(), known.tobytes(), ends.astype("<u8").tobytes(),
                     offsets.astype("<u8").tobytes(), payload])


class Segment:
    """View of one segment in a byte buffer."""

    def __init__(self, buf, at: int = 0):
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids, self.blocks = \
            struct.unpack_from(HEAD, buf, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += struct.calcsize(HEAD)

        def take(kind, n):
            nonlocal at
            part = np.frombuffer(buf, kind, n, at)
            at += part.nbytes
            return part
        self.doc_ids, self.known = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.ends, self.offsets = take("<u8", self.n_docs), take("<u8", self.blocks + 1)
        self.payload = memoryview(buf)[at:at + int(self.offsets[-1])]
        self.next = at + int(self.offsets[-1]) + 1

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first..last-1, from the blocks that hold them and no others."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block_ids, (last - 1) // self.block_ids + 1
        part = self.payload[int(self.offsets[a]):int(self.offsets[b])]
        return unpack(part, self.bits, last - a * self.block_ids)[first - a * self.block_ids:]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def segments(buf):
    at = 0
    while at < len(buf):
        part = Segment(buf, at)
        yield part
        at = part.next


#: letters, then ASCII marks: two pieces for the pre-tokenizer, cut at the border
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)\Z").match


def _byte_letters() -> dict[int, str]:
    """Printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder(dict):
    """Ids of a whitespace-separated word as packed 32-bit bytes, remembered per worker.

    Valid for tokenizers whose pre-tokenizer drops white space and never joins
    across it; words of letters and closing marks skip the normaliser, and
    words that differ in case or marks alone share the ids of their letters.
    Every word is remembered until :meth:`trim`, which a caller owes after a
    bounded run of texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cores: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _core(self, core: str) -> bytes:
        shown = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if m := _PLAIN(text):
            core, marks = m.groups()
            core = core.lower()
            out = self.cores.get(core)
            if out is None:
                out = self.cores[core] = self._core(core)
            if marks:
                end = self.marks.get(marks)
                if end is None:
                    end = self.marks[marks] = self._whole(marks)
                out += end
        else:
            out = self._whole(text)
        self[word] = out
        return out

    def trim(self) -> None:
        """Forget the latest words beyond what is remembered."""
        for held, most in ((self, CACHE_WORDS), (self.cores, CACHE_CORES), (self.marks, CACHE_CORES)):
            for _ in range(len(held) - most):
                held.popitem()


def _encoder(path: str) -> WordEncoder:
    """One encoder (and word memory) per Python worker and tokenizer."""
    kept = builtins.__dict__.setdefault("_word_encoders", {})
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]


def _segments(path: str, end_id: int, bits: int):
    def run(batches):
        words = _encoder(path)
        encode = words.__getitem__
        tail = np.array([end_id], "<u4").tobytes()
        doc_ids, parts, ends, total = [], [], [], 0
        for batch in (part for whole in batches for part in text_slices(whole)):
            data, offs = text_buffer(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offs[:-1], offs[1:]):
                ids = b"".join(map(encode, data[a:b].tobytes().split())) + tail
                doc_ids.append(doc_id)
                parts.append(ids)
                total += len(ids) // 4
                ends.append(total)
                if total >= SEGMENT_IDS:
                    yield _segment_row(doc_ids, parts, ends, bits)
                    doc_ids, parts, ends, total = [], [], [], 0
            words.trim()
        if doc_ids:
            yield _segment_row(doc_ids, parts, ends, bits)
        del doc_ids, parts, ends
        release()
    return run


def _segment_row(doc_ids, parts, ends, bits):
    ids = np.frombuffer(b"".join(parts), "<u4")
    return ship(segment=binary([segment(doc_ids, np.array(ends, np.uint64), ids, bits)]))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> str:
    """Encode ``docs`` in doc_id order into packed files under ``path``.

    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    from tokenizers import Tokenizer
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    bits = max(1, (size - 1).bit_length())
    spark = docs.sparkSession
    rows = (texts(docs).repartitionByRange(shuffle_width(spark), "doc_id")
            .sortWithinPartitions("doc_id", "row_key").select("doc_id", "text")
            .mapInArrow(_segments(tokenizer, end_id, bits), "segment binary")
            .select(F.col("segment").cast("string").alias("value")))   # bytes as they are
    with short_batches(spark):
        rows.write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def _documents(with_ids: bool):
    def run(batches):
        for batch in batches:
            for file, buf in zip(batch.column("file").to_pylist(), batch.column("content")):
                base = 0
                for part in segments(buf.as_buffer()):
                    stops = part.ends.astype(np.int64)
                    starts = np.append(0, stops[:-1])
                    ids = part.ids(0, part.n_ids).astype("<u4")
                    each = [ids[a:b] for a, b in zip(starts, stops)]
                    more = {"ids": pa.array(each, pa.list_(pa.int32()))} if with_ids else {}
                    yield ship(file=pa.array(np.full(part.n_docs, file, np.int64)),
                               doc_id=pa.array(part.doc_ids, mask=part.known == 0),
                               local=starts + base, n_tokens=stops - starts,
                               ids_crc32=pa.array([zlib.crc32(x.tobytes()) for x in each],
                                                  pa.int64()), **more)
                    base += part.n_ids
                    del each, more
            release()
    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of packed files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    files = (spark.read.format("binaryFile").load(path).filter("length > 0")
             .select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"),
                     "content"))
    schema = "file long, doc_id long, local long, n_tokens long, ids_crc32 long"
    found = written(files.mapInArrow(_documents(with_ids),
                                     schema + (", ids array<int>" if with_ids else "")), "tokens")
    # one row a file: its first global position
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = (found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
             .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    out = found.join(bases, "file").select("doc_id", (F.col("base") + F.col("local"))
                                           .alias("start"), "n_tokens", "ids_crc32",
                                           *(["ids"] if with_ids else []))
    return out
