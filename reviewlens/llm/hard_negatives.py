"""Hard negatives of embedding anchors from lists shared by anchor clusters (MAXIMUS).

1. Components become integers floor(256 x); a row keeps its vector packed.
2. Anchors are clustered (spherical k-means, centres fitted on at most
   ``SAMPLE`` anchors) and every cluster is dealt into blocks of about ``BLOCK`` anchors.
3. Candidates are dealt into regions of bounded size and anchor blocks into
   slices of ``SLICE`` blocks.  A task takes one region and one slice.  For each
   block it bounds every candidate's inner product by the candidate's norm and
   its angle to the block's centre, less the block's widest angle, sorts the
   region once by that bound, and every anchor of the block walks the list
   until the bound cannot reach what it still needs (certified, with a margin
   for rounding; scores themselves are exact integers).
4. The best of all regions are merged per anchor.  A first pass finds the
   positives; the second one, which knows the scores of the positives, their negatives.

No list, cap or sample drops a candidate: the walk ends only where no later
candidate can enter the result.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part, nor do rows with an integer component beyond 32 bits,
whose products a long cannot hold; vectors of different lengths are padded with
zeros, so an empty vector scores 0 with all; rows that repeat in full count
once; rows that share an id with another vector or label are rows of their own,
ties between them go by label and vector; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import binary, ship, shuffle_width, written

#: anchors from which the centres are fitted, and their number
SAMPLE, CLUSTERS = 4096, 32
#: anchors of a block, blocks of a slice, candidates of a region (about)
BLOCK, SLICE, REGION = 512, 16, 1 << 16
#: candidates that a block looks at between two tests of its bound
STEP = 1024
_NONE = np.iinfo(np.int64).max


# --- vectors --------------------------------------------------------------------

def _pack(batches):
    for batch in batches:
        vecs = batch.column("vec")
        off = np.asarray(vecs.offsets)
        flat = vecs.values.to_numpy(zero_copy_only=False).astype("<i4")
        yield ship(vec_id=batch.column("vec_id"), label=batch.column("label"), vec=binary(
            [flat[a:z].tobytes() for a, z in zip(off[:-1], off[1:])]))


def vectors(embeddings: DataFrame, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, key, label, vec) of the rows that take part, once each, with integer components."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x.cast("double")) < F.lit(float(1 << 23))))
    label = F.col("label").cast("long")
    if relabel_every:
        label = F.when(F.col("vec_id") % relabel_every == 0, (label + 1) % labels).otherwise(label)
    rows = (embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                              & F.coalesce(fits, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
                    whole.alias("vec")))
    return (rows.mapInArrow(_pack, "vec_id long, label long, vec binary").distinct()
            .withColumn("key", F.xxhash64("vec_id", "label", "vec")))


def _matrix(col, dim=None) -> np.ndarray:
    """Vectors as rows of a matrix, padded with zeros."""
    rows = [np.frombuffer(v.as_buffer(), "<i4") for v in col]
    dim = max([dim or 1, *map(len, rows)])
    if all(len(r) == dim for r in rows) and rows:
        return np.stack(rows)
    out = np.zeros((len(rows), dim), np.int32)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _exact(a: np.ndarray, b: np.ndarray):
    """The pair of matrices in a number type that holds every inner product exactly."""
    most = a.shape[1] * (int(np.abs(a.astype(np.int64)).max(initial=0))
                         * int(np.abs(b.astype(np.int64)).max(initial=0)))
    kind = (np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53
            else np.int64 if most < 1 << 63 else object)
    return a.astype(kind), b.astype(kind)


# --- clusters -------------------------------------------------------------------

def _unit(m):
    m = m.astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def centres(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other."""
    x = _unit(sample)
    c = x[:1]
    while len(c) < min(k, len(x)):
        far = (x @ c.T).max(axis=1).argmin()
        c = np.vstack([c, x[far]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def _assign(middle):
    def run(batches):
        for batch in batches:
            m = _matrix(batch.column("vec"), middle.shape[1])
            near = (_unit(m)[:, :middle.shape[1]] @ middle.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "cluster"])
    return run


def anchor_blocks(rows: DataFrame, every: int) -> DataFrame | None:
    """(anchor_id, anchor_key, label, vec, block) of the anchors; None without any."""
    anchors = rows.filter(F.col("vec_id") % every == 0)
    total = anchors.count()
    if not total:
        return None
    held = anchors.orderBy("key").limit(SAMPLE).select("vec").toArrow()
    k = max(1, min(CLUSTERS, total // BLOCK))
    middle = centres(_matrix(held.column("vec").combine_chunks()), k)
    dealt = written(anchors.mapInArrow(_assign(middle), "vec_id long, label long, vec binary, "
                                       "key long, cluster int"), "anchors")
    sizes = {r.cluster: r.n for r in dealt.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    block, first = F.lit(0), 0
    for cluster, n in sorted(sizes.items()):
        some = -(-n // BLOCK)
        block = F.when(F.col("cluster") == cluster, first + F.pmod("key", F.lit(some))).otherwise(block)
        first += some
    return dealt.select(F.col("vec_id").alias("anchor_id"), F.col("key").alias("anchor_key"), "label",
                        "vec", block.cast("int").alias("block"))


# --- the walk -------------------------------------------------------------------

class _Best:
    """The best (score, id, key) entries of numbered slots, kept as flat sorted arrays."""

    def __init__(self, slots, most):
        self.most, self.slots = most, slots
        self.slot = np.zeros(0, np.int64)
        self.score = self.at = self.slot
        self.floor = np.full(slots, -_NONE)    # a full slot's least score

    def add(self, slot, score, at, ids, keys):
        slot, score, at = (np.concatenate(x) for x in (
            (self.slot, slot), (self.score, score), (self.at, at)))
        order = np.lexsort((keys[at], ids[at], -score, slot))
        slot, score, at = slot[order], score[order], at[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.most
        self.slot, self.score, self.at = slot[keep], score[keep], at[keep]
        n = np.bincount(self.slot, minlength=self.slots)
        full = np.flatnonzero(n >= self.most)
        self.floor[full] = self.score[np.cumsum(n)[full] - 1]


def shared_list(block: np.ndarray, items: np.ndarray):
    """Order of the items by their angular bound for the block, and the bound per unit of norm."""
    a, norm = _unit(block), np.linalg.norm(items.astype(np.float64), axis=1)
    middle = _unit(a.sum(axis=0, keepdims=True))[0]
    if not middle.any():
        widest = np.pi
    else:
        widest = np.arccos(np.clip((a @ middle)[np.abs(a).sum(axis=1) > 0], -1, 1)).max(initial=0)
    angle = np.arccos(np.clip(np.divide(items.astype(np.float64) @ middle, norm,
                                        out=np.zeros(len(items)), where=norm > 0), -1, 1))
    # rounding may only raise a bound
    bound = norm * np.cos(np.maximum(0, angle - widest - 1e-6)) * (1 + 1e-9) + 1e-6
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def _walk(block, items, take):
    """Offers ``take`` the exact scores of the block's active anchors with the list, step by step.

    ``take(rows, at, scores)`` returns the score that each of the rows still needs.
    """
    order, bound = shared_list(block, items)
    norm = np.linalg.norm(block.astype(np.float64), axis=1)
    a, b = _exact(block, items[order])
    rows, need = np.arange(len(block)), take(np.arange(len(block)), order[:0], np.zeros((len(block), 0)))
    for s in range(0, len(order), STEP):
        # a bound holds for all that follows: the list descends
        ahead = norm[rows] * bound[s]
        rows = rows[np.where(bound[s] < 0, 0, ahead) + 1e-6 >= need]
        if not len(rows):
            return
        need = take(rows, order[s:s + STEP], (a[rows] @ b[s:s + STEP].T).astype(np.int64))


POSITIVE = "anchor_id long, anchor_key long, vec_id long, key long, score long"


def _positives(most):
    def run(anchors: pa.Table, items: pa.Table) -> pa.Table:
        out = []
        for block, vecs, ids, keys, label, matrix, i_ids, i_keys, i_label in _blocks(anchors, items):
            best = _Best(len(ids), most)

            def take(rows, at, score):
                if len(at):
                    good = ((score >= best.floor[rows][:, None]) & (i_label[at] == label[rows][:, None])
                            & (i_keys[at] != keys[rows][:, None]))
                    r, c = np.nonzero(good)
                    best.add(rows[r], score[r, c], at[c], i_ids, i_keys)
                return best.floor[rows]
            _walk(vecs, matrix, take)
            out.append({"anchor_id": ids[best.slot], "anchor_key": keys[best.slot],
                        "vec_id": i_ids[best.at], "key": i_keys[best.at], "score": best.score})
        return _table(out, POSITIVE)
    return run


NEGATIVE = ("anchor_id long, anchor_key long, positive int, negative_id long, key long, "
            "negative_score long")


def _negatives(most, low):
    def run(anchors: pa.Table, items: pa.Table) -> pa.Table:
        out = []
        for block, vecs, ids, keys, label, matrix, i_ids, i_keys, i_label in _blocks(anchors, items):
            held = [np.array(x, np.int64) for x in block.column("scores").to_pylist()]
            wide = max(map(len, held), default=0)
            score_of = np.full((len(ids), wide), -1)
            for i, h in enumerate(held):
                score_of[i, :len(h)] = h
            # of equal positive scores one is searched; below 0 the range is empty
            searched = score_of >= 0
            least = np.where(searched, -(-score_of * low // 100), _NONE)
            best = _Best(len(ids) * wide, most)

            def take(rows, at, score):
                if len(at):
                    floor = np.maximum(least, best.floor.reshape(least.shape))
                    r, c = np.nonzero((score >= floor[rows].min(axis=1)[:, None])
                                      & (i_label[at] != label[rows][:, None]))
                    s, who = score[r, c], rows[r]
                    for j in range(wide):
                        hit = searched[who, j] & (s <= score_of[who, j]) & (s >= floor[who, j])
                        best.add(who[hit] * wide + j, s[hit], at[c[hit]], i_ids, i_keys)
                return np.maximum(least, best.floor.reshape(least.shape))[rows].min(axis=1)
            if wide:
                _walk(vecs, matrix, take)
            who = best.slot // max(wide, 1)
            out.append({"anchor_id": ids[who], "anchor_key": keys[who],
                        "positive": (best.slot % max(wide, 1)).astype(np.int32),
                        "negative_id": i_ids[best.at], "key": i_keys[best.at],
                        "negative_score": best.score})
        return _table(out, NEGATIVE)
    return run


def _blocks(anchors: pa.Table, items: pa.Table):
    """The anchor blocks of a cell, each with the cell's candidates."""
    if not anchors.num_rows or not items.num_rows:
        return
    anchors, items = anchors.combine_chunks(), items.combine_chunks()
    matrix = _matrix(items.column("vec").combine_chunks())
    i_ids, i_keys, i_label = (items.column(c).to_numpy() for c in ("vec_id", "key", "label"))
    blocks = anchors.column("block").to_numpy()
    for b in np.unique(blocks):
        some = anchors.filter(pa.array(blocks == b)).combine_chunks()
        vecs = _matrix(some.column("vec").combine_chunks(), matrix.shape[1])
        wide = matrix if matrix.shape[1] == vecs.shape[1] else np.pad(
            matrix, ((0, 0), (0, vecs.shape[1] - matrix.shape[1])))
        yield (some, vecs, some.column("anchor_id").to_numpy(), some.column("anchor_key").to_numpy(),
               some.column("label").to_numpy(), wide, i_ids, i_keys, i_label)


def _table(parts, schema):
    names = [c.strip().split(" ") for c in schema.split(", ")]
    kinds = {"long": np.int64, "int": np.int32}
    return pa.table({n: np.concatenate([np.zeros(0, kinds[t]), *(p[n] for p in parts)]).astype(kinds[t])
                     for n, t in names})


class _Grid:
    """Regions of candidates times slices of anchor blocks."""

    def __init__(self, rows: DataFrame, blocks: int):
        width = shuffle_width(rows.sparkSession)
        self.slices = -(-blocks // SLICE)
        self.regions = max(-(-rows.count() // REGION), -(-width // self.slices))
        self.items = rows.withColumn("slice", F.explode(F.sequence(
            F.lit(0), F.lit(self.slices - 1)))).withColumn("cell", F.col("slice") * self.regions
                                                           + F.pmod("key", F.lit(self.regions)))

    def search(self, anchors: DataFrame, fn, schema: str) -> DataFrame:
        """``fn`` of every cell's anchors and candidates."""
        dealt = anchors.withColumn("region", F.explode(F.sequence(
            F.lit(0), F.lit(self.regions - 1)))).withColumn(
                "cell", F.pmod("block", F.lit(self.slices)) * self.regions + F.col("region"))
        return dealt.groupBy(F.col("cell").cast("long")).cogroup(
            self.items.groupBy(F.col("cell").cast("long"))).applyInArrow(fn, schema)


SCHEMA = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
          "negative_score long")


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5,
                   low: int = 80, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """A row per anchor, positive and negative.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``; positives
    the best rows of the same label; negatives the best rows of other labels
    with ``low`` % to 100 % of the positive's score.
    """
    spark = embeddings.sparkSession
    rows = written(vectors(embeddings, relabel_every, labels), "vectors")
    anchors = anchor_blocks(rows, every)
    if anchors is None:
        return spark.createDataFrame([], SCHEMA)
    anchors = written(anchors, "anchor-blocks")
    grid = _Grid(rows, anchors.agg(F.max("block")).first()[0] + 1)
    by_anchor = W.partitionBy("anchor_id", "anchor_key")
    found = grid.search(anchors, _positives(positives), POSITIVE).withColumn("place", F.row_number().over(
        by_anchor.orderBy(F.desc("score"), "vec_id", "key"))).filter(F.col("place") <= positives)
    found = written(found, "positives")
    known = found.groupBy("anchor_id", "anchor_key").agg(F.expr(
        "sort_array(collect_set(score), false)").alias("scores"))
    asked = anchors.join(known, ["anchor_id", "anchor_key"])
    hits = grid.search(asked, _negatives(negatives, low), NEGATIVE)
    hits = written(hits.withColumn("rank", F.row_number().over(
        W.partitionBy("anchor_id", "anchor_key", "positive").orderBy(
            F.desc("negative_score"), "negative_id", "key"))).filter(F.col("rank") <= negatives),
        "negatives")
    scored = found.select(
        "anchor_id", "anchor_key", F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"), (F.dense_rank().over(
            by_anchor.orderBy(F.desc("score"))) - 1).alias("positive"))
    return scored.join(hits, ["anchor_id", "anchor_key", "positive"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
