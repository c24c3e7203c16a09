"""Mixing sources to target weights by blocks of words.

The words of a source, in (doc_id, text hash) order, form one stream that is
cut into blocks of ``block_words``.  A mix is a list of slots, each of which
holds one block:

* a source's slots are as many as its target needs; the last one is cut so
  that the words taken equal the rounded target;
* every output shard draws how many slots it gives each source from a
  multinomial over what the sources still have to place, so the shards
  together hold exactly those slots;
* slot ``j`` of a source reads block ``perm(j mod n)`` of pass ``j div n``,
  where ``perm`` is a keyed pseudorandom permutation of the source's ``n``
  block numbers (a Feistel network with cycle walking): no shuffle of the
  data decides the order, and slots join blocks by index.

The driver holds one row per source and one number per shard and source.  All
else is joined by (source, block).  The result depends on the data and the
seed alone.

Defined results: null or blank text has size 0, null sources form one source
(last), rows that repeat a doc_id are separate rows, a null ``doc_id`` sorts
first in its source; extra columns are carried through; an empty table gives
an empty mix.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, mix, ship, shuffle_width, text_buffer, word_spans, written

SLOTS = "sid int, shard int, slot long, pass int, block long, words long"


def cycle_weights(sources: list) -> dict:
    """1, 2, 3, 1, 2, 3, ... over the sources in order."""
    return {s: i % 3 + 1 for i, s in enumerate(sources)}


def targets(sizes: dict, weights: dict, repeat_limit: int = 3) -> dict:
    """Words per source: shares by weight, none above ``repeat_limit`` times its size."""
    total, out, free = Fraction(sum(sizes.values())), {}, dict(weights)
    while free:
        whole = sum(Fraction(w) for w in free.values())
        over = [s for s, w in free.items() if total * Fraction(w) > repeat_limit * sizes[s] * whole]
        if not over:
            out.update({s: total * Fraction(w) / whole for s, w in free.items()})
            break
        for s in over:
            out[s] = Fraction(repeat_limit * sizes[s])
            del free[s]
        total -= sum(out[s] for s in over)
    return out


# --- pseudorandom permutation of 0..n-1 --------------------------------------

def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(value, key, r, half):
    salt = mix(np.array([(key + r) % (1 << 64)], np.uint64))
    return mix(value ^ salt) & np.uint64((1 << half) - 1)


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 sends each index (or comes from)."""
    half = _half(n)
    low = np.uint64((1 << half) - 1)
    x = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        a, b = x[todo] >> np.uint64(half), x[todo] & low
        for r in (range(3, -1, -1) if inverse else range(4)):
            a, b = (b ^ _round(a, key, r, half), a) if inverse else (b, a ^ _round(b, key, r, half))
        x[todo] = (a << np.uint64(half)) | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _key(seed: int, sid: int, turn: int) -> int:
    return int(mix(np.array([(seed * 1_000_003 + sid * 1_009 + turn + 1) % (1 << 64)], np.uint64))[0])


def quota(size: int, words: int, block: int, seed: int, sid: int) -> tuple[int, int]:
    """Slots that ``words`` words of a source take, and how many words the last one loses."""
    n = -(-size // block)
    passes, rest = divmod(words, size)
    short = n * block - size
    at = int(permute(np.array([n - 1]), n, _key(seed, sid, passes), True)[0])
    m = -(-rest // block)
    held = m * block - (short if at < m else 0)
    if held < rest:
        m, held = m + 1, held + block - (short if at == m else 0)
    return passes * n + m, held - rest


def shard_counts(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each shard: multinomial draws that use up ``slots``."""
    left, rng, out = slots.astype(np.int64).copy(), np.random.default_rng(seed), []
    for k in range(shards):
        n = int(left.sum()) // (shards - k)
        draw = np.zeros_like(left)
        while (short := n - int(draw.sum())) > 0:
            room = left - draw
            draw = np.minimum(draw + rng.multinomial(short, room / room.sum()), left)
        out.append(draw)
        left = left - draw
    return np.array(out)


def _expand(block, seed):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n, sid = row["blocks"], row["sid"]
                for a in range(0, row["n"], 1 << 18):
                    t = np.arange(a, min(row["n"], a + (1 << 18)))
                    j = row["first"] + t
                    turn, i = j // n, j % n
                    where = np.empty(len(j), np.int64)
                    for p in np.unique(turn):
                        where[turn == p] = permute(i[turn == p], n, _key(seed, sid, int(p)))
                    words = np.minimum(block, row["size"] - where * block)
                    words[j == row["slots"] - 1] -= row["trim"]
                    slot = permute(row["before"] + t, row["shard_slots"],
                                   _key(seed, -1 - row["shard"], 0))
                    yield ship(sid=pa.array(np.full(len(j), sid), pa.int32()),
                               shard=pa.array(np.full(len(j), row["shard"]), pa.int32()),
                               slot=slot, **{"pass": pa.array(turn, pa.int32())},
                               block=where, words=words)
    return run


def _offsets(batches):
    """Running word count inside each (task, source); input is sorted by source."""
    sid, at = None, 0
    for batch in batches:
        sids, sizes = batch.column("sid").to_numpy(), batch.column("size").to_numpy()
        if not len(sids):
            continue
        total = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.append(True, sids[1:] != sids[:-1]))
        base = np.repeat(total[first], np.diff(np.append(first, len(sids))))
        local = total - base
        if sids[0] == sid:
            local[:first[1] if len(first) > 1 else len(local)] += at
        sid, at = sids[-1], local[-1] + sizes[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)],
                                         [*batch.schema.names, "local"])


class Mix:
    """A planned mix: ``spans`` (documents in their source's stream) and ``slots``."""

    def __init__(self, docs: DataFrame, weights=cycle_weights, block_words: int = 1024,
                 shards: int = 256, repeat_limit: int = 3, seed: int = 7):
        self.docs, self.block, self.seed = docs, block_words, seed
        spark = docs.sparkSession
        sized = written(docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias(
                "row_key"), "source", "lang",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
            "mix-sizes")
        sizes = {r["source"]: r["size"] for r in       # one row per source
                 sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        goal = targets(sizes, weights(order), repeat_limit)
        rows = []
        for sid, s in enumerate(order):
            words = round(goal[s])
            slots, trim = quota(sizes[s], words, block_words, seed, sid) if words else (0, 0)
            rows.append((sid, s, sizes[s], float(goal[s]), -(-sizes[s] // block_words), slots, trim))
        self.sources = spark.createDataFrame(
            rows, "sid int, source string, source_size long, target double, blocks long, "
                  "slots long, trim long")
        total = np.array([r[5] for r in rows], np.int64)
        shards = int(max(1, min(shards, total.sum()))) if len(rows) else 0
        plan, done = [], np.zeros(len(rows), np.int64)
        for k, counts in enumerate(shard_counts(total, shards, seed) if shards else []):
            before = np.cumsum(counts) - counts
            plan += [(k, r[0], r[2], r[4], r[5], r[6], int(done[r[0]]), int(counts[r[0]]),
                      int(before[r[0]]), int(counts.sum())) for r in rows if counts[r[0]]]
            done += counts
        self.slots = spark.createDataFrame(
            plan, "shard int, sid int, size long, blocks long, slots long, trim long, "
                  "first long, n long, before long, shard_slots long").repartition(
                      shuffle_width(spark), "shard").mapInArrow(_expand(block_words, seed), SLOTS)
        named = sized.join(F.broadcast(self.sources.select("sid", "source")), sized.source.eqNullSafe(
            self.sources.source)).select("sid", "doc_id", "row_key", sized.source, "lang", "size")
        ranged = named.repartitionByRange(shuffle_width(spark), "sid", "doc_id", "row_key") \
            .sortWithinPartitions("sid", "doc_id", "row_key")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
        local = written(ranged.mapInArrow(_offsets, schema + ", local long").withColumn(
            "part", F.spark_partition_id()), "mix-local")
        before = Window.partitionBy("sid").orderBy("part").rowsBetween(
            Window.unboundedPreceding, -1)                # one row per task and source
        parts = local.groupBy("sid", "part").agg(F.sum("size").alias("n")).select(
            "sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        self.spans = written(local.join(parts, ["sid", "part"]).select(
            "sid", "doc_id", "row_key", "source", "lang", "size",
            (F.col("base") + F.col("local")).alias("begin")), "mix-spans")

    def pieces(self) -> DataFrame:
        """Document parts that slots take: lo..hi are word positions in the document."""
        b = F.lit(self.block)
        cut = self.spans.filter("size > 0").withColumn("block", F.explode(F.sequence(
            F.floor(F.col("begin") / b), F.floor((F.col("begin") + F.col("size") - 1) / b))))
        start = F.col("block") * b
        return cut.join(self.slots, ["sid", "block"]).select(
            "sid", "begin", "doc_id", "row_key", "shard", "slot", "pass", "block",
            (F.greatest("begin", start) - F.col("begin")).alias("lo"),
            (F.least(F.col("begin") + F.col("size"), start + F.col("words"))
             - F.col("begin")).alias("hi")).filter("hi > lo")

    def taken(self) -> DataFrame:
        """One row per document: doc_id, source, size, source_size, target, taken."""
        got = self.pieces().groupBy("sid", "begin").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))
        got = got.select(F.col("sid").alias("s"), F.col("begin").alias("b"), "n")
        held = self.spans.join(got, F.expr("size > 0 and sid = s and begin = b"), "left")
        return held.join(F.broadcast(self.sources.drop("source")), "sid").select(
            "doc_id", "row_key", "source", "size", "source_size", "target",
            F.coalesce("n", F.lit(0)).cast("long").alias("taken"))

    def documents(self) -> DataFrame:
        """The mix as documents: a row per document and pass, with the text that pass takes.

        Columns as in ``documents`` (doc_id, text, lang, source, n_chars); a
        document that is taken whole keeps its text unchanged.
        """
        ranges = self.pieces().groupBy("sid", "begin", "doc_id", "row_key", "pass").agg(
            F.collect_list(F.struct("lo", "hi")).alias("ranges"))
        ranges = ranges.join(self.spans.select("sid", "begin", "size", "lang", "source").filter(
            "size > 0"), ["sid", "begin"])
        text = self.docs.select(F.col("doc_id").cast("long").alias("d"),
                                F.xxhash64("doc_id", "text").alias("k"), "text").dropDuplicates(
                                    ["d", "k"])
        return ranges.join(text, F.col("doc_id").eqNullSafe(F.col("d"))
                           & (F.col("row_key") == F.col("k"))).select(
            "doc_id", "text", "lang", "source", "size", "ranges").mapInArrow(
                _cut_texts, "doc_id long, text string, lang string, source string, n_chars long")

    def blocks(self) -> DataFrame:
        """The mix as training blocks: shard, slot, source, pass, block, text of the words."""
        text = self.docs.select(F.col("doc_id").cast("long").alias("d"),
                                F.xxhash64("doc_id", "text").alias("k"),
                                F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words")
                                ).dropDuplicates(["d", "k"])
        part = self.pieces().join(text, F.col("doc_id").eqNullSafe(F.col("d"))
                                  & (F.col("row_key") == F.col("k")))
        part = part.select("shard", "slot", "sid", "pass", "block", "begin", F.array_join(F.slice(
            "words", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")), " ")
            .alias("part"))
        return part.groupBy("shard", "slot", "sid", "pass", "block").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("begin", "part"))), lambda x: x["part"]), " ")
            .alias("text")).join(F.broadcast(self.sources.select("sid", "source")), "sid").drop("sid")


def _cut_texts(batches):
    for batch in batches:
        out = []
        for i, (size, ranges) in enumerate(zip(batch.column("size").to_pylist(),
                                               batch.column("ranges").to_pylist())):
            one = batch.column("text").slice(i, 1)
            if sum(r["hi"] - r["lo"] for r in ranges) == size:
                out.append(one[0].as_py())
                continue
            data, offs = text_buffer(one)
            start, _, _ = word_spans(data, offs)
            stop = np.append(start[1:], len(data))
            out.append(b"".join(data[start[r["lo"]]:stop[r["hi"] - 1]].tobytes()
                                for r in sorted(ranges, key=lambda r: r["lo"])).decode())
        text = pa.array(out, pa.string())
        yield ship(doc_id=batch.column("doc_id"), text=text, lang=batch.column("lang"),
                   source=batch.column("source"),
                   n_chars=pa.array([len(x) for x in out], pa.int64()))


