"""Helpers shared by the corpus operators.

Text work inside Arrow batches is vectorised: words are found on the raw
UTF-8 buffer, hashed with numpy, and keys travel between tasks as packed
byte strings (one row per batch and bucket), so a shuffle of 10^9 hashes
costs a few bytes each and no per-row work in the JVM.

Functions that run in Python workers are pickled by value, so executors
need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import contextlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__package__])

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
#: bytes of text hashed at a time; bounds the per-byte temporaries
BLOCK = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix(x):
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def _byte_tables(seed: int, lower: bool):
    t = mix(np.arange(1, 257, dtype=np.uint64) * _MULT[seed])
    if lower:
        t[65:91] = t[97:123]
    t[_SPACE] = 0
    return t


_TABLES = {(s, lo): _byte_tables(s, lo) for s in (0, 1) for lo in (False, True)}


def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)
    offs = offs[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray):
    """Start and end byte of every word, and each text's range in those lists."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data, start, end, lower: bool = False, seed: int = 0,
                marks: bool = True) -> np.ndarray:
    """64-bit hash of every word (A-Z folded to a-z if ``lower``).

    Without ``marks``, ASCII punctuation behind a word does not count.
    """
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    table, mult = _TABLES[seed, lower], _MULT[seed]
    if not marks:
        table = np.where(_MARKS, np.uint64(0), table)
    longest = int((end - start).max())
    power = np.ones(longest, np.uint64)
    np.multiply.accumulate(np.full(longest - 1, mult, np.uint64), out=power[1:])
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + BLOCK)))
        s = start[i:j] - start[i]
        piece = data[start[i]:end[j - 1]]
        place = np.arange(len(piece)) - np.repeat(s, np.diff(np.append(s, len(piece))))
        np.minimum(place, longest - 1, out=place)
        out[i:j] = np.add.reduceat(table[piece] * power[place], s)
        i = j
    return mix(out + (end - start).astype(np.uint64) if marks else out)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries (shorter by k-1 than ``words``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mult = _MULT[seed] | np.uint64(1)
    out = words[:n].copy()
    for t in range(1, k):
        out *= mult
        out += words[t:t + n]
    return mix(out + np.uint64(k))


def window_starts(ptr: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words that start a ``k``-word window inside their own text."""
    counts = np.maximum(np.diff(ptr) - k + 1, 0)
    return ranges(ptr[:-1], counts)


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``first[i] .. first[i]+counts[i]-1``."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    keep = counts > 0
    first, counts = first[keep], counts[keep]
    step = np.ones(total, np.int64)
    step[0] = first[0]
    at = np.cumsum(counts)[:-1]
    step[at] = first[1:] - first[:-1] - counts[:-1] + 1
    return np.cumsum(step)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 22):
    """Cut a batch into runs of rows with about ``most`` bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))
    release()


def release() -> None:
    """Give freed memory back to the system: workers that wait for a task share the executor's."""
    import ctypes
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def by_bucket(bucket: np.ndarray):
    """Stable order by bucket, and (bucket, from, to) of each run in that order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536
                       else bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    edges = [0, *cuts.tolist(), len(b)] if len(b) else [0]
    return order, [(int(b[a]), a, z) for a, z in zip(edges[:-1], edges[1:])]


def runs(ids: np.ndarray):
    """Run-length form of a sequence: (values, counts)."""
    if not len(ids):
        return ids, np.zeros(0, np.uint32)
    cut = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return ids[cut], np.diff(np.append(cut, len(ids))).astype(np.uint32)


def deal(bucket: np.ndarray, counts=None, lists=None, **columns) -> pa.RecordBatch | None:
    """Packed rows, one per bucket, of segments with fixed-width ``columns``.

    ``lists`` holds arrays in which segment ``i`` owns the next ``counts[i]``
    entries; both stay in segment order inside a bucket.
    """
    release()
    order, cuts = by_bucket(bucket)
    if not cuts:
        return None
    out = {n: [] for n in columns}
    for n, v in columns.items():
        v = v[order]
        out[n] = binary([v[a:z].tobytes() for _, a, z in cuts])
    if counts is not None:
        counts = counts.astype(np.int64)
        each = counts[order]
        at = ranges((np.cumsum(counts) - counts)[order], each)
        edge = np.append(0, np.cumsum(each))
        out["counts"] = binary([each[a:z].astype(np.uint32).tobytes() for _, a, z in cuts])
        for n, v in lists.items():
            v = v[at]
            out[n] = binary([v[edge[a]:edge[z]].tobytes() for _, a, z in cuts])
    return ship(bucket=pa.array([b for b, _, _ in cuts], pa.int32()), **out)


def deal_entries(bucket: np.ndarray, row: np.ndarray, lists: dict, **by_row):
    """As ``deal`` for single entries of rows: neighbours of one row form a segment."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536
                       else bucket, kind="stable")
    b, r = bucket[order], row[order]
    if not len(b):
        return None
    cut = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (r[1:] != r[:-1])))
    return deal(b[cut], np.diff(np.append(cut, len(b))), {n: v[order] for n, v in lists.items()},
                **{n: v[r[cut]] for n, v in by_row.items()})


def blob_column(table, name, dtype) -> np.ndarray:
    """All byte strings of a column, joined and read as one array."""
    col = table.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in col if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def ship(**columns) -> pa.RecordBatch:
    """Record batch of plain lists / numpy arrays / Arrow arrays by column name."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def binary(values) -> pa.Array:
    return pa.array(values, pa.binary())


# --- Spark side -------------------------------------------------------------

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: rows that reach a Python worker at a time
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the actions inside the block."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def short_batches(spark: SparkSession):
    """At most 1,000 rows a Python batch: texts are long, and workers share the executor's memory."""
    return setting(spark, BATCH_ROWS, str(min(1000, int(spark.conf.get(BATCH_ROWS)))))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    The written table cuts the lineage: a lost executor re-reads files.  The
    shuffle files behind the write are removed as soon as it has committed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with setting(spark, _CLEAN, "true"), short_batches(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def superseded(df: DataFrame) -> None:
    """Delete the files of a ``written`` table that no later step reads."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: a table of keys is broadcast up to this many rows (counted first), and shuffled beyond
BROADCAST_ROWS = 1 << 19


def small(keys: DataFrame) -> DataFrame:
    """A written table of keys, broadcast if its counted rows are within the bound."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, row_key, text, ...): the columns the operators read, and no others.

    ``row_key`` tells rows apart that repeat a doc_id with another text.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("doc_id", "text").alias("row_key"),
                       F.col("text").cast("string").alias("text"), *also)


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
