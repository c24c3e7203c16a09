"""Near-duplicate join on word shingles by several global token orders.

Two documents link when the Jaccard similarity of their shingle sets reaches
``percent`` / 100.  Exact steps, none of which compares all members of a group:

1. Documents with equal sets form one class (their links are implied).
2. Gate: a class can only have a partner if ``percent`` of its shingles occur
   in another class too.  Shingles are dealt by hash (32 bits in a bucket, a
   superset) and the shared ones counted per class.
3. For the classes left, shingles are ordered by document frequency; several
   global orders break ties with different hashes.  Linked classes share a
   token of their prefixes under every order.  The prefix tokens of the first
   order are the keys; keys of more than ``LONG_LIST`` classes are combined
   with the prefix tokens of the next order, as a linked pair shares those too.
4. Keys whose smallest member is the same class form a unit, so the keys of one
   near-copy group meet in one place and a class travels there once, not once a
   key.  A unit is cut into chunks of about ``CHUNK`` classes and
   ``CHUNK_BYTES`` bytes, and every two chunks are one block of work.  A block
   takes a pair only for the smallest key that both classes have, so every pair
   is looked at once, drops pairs whose prefixes miss each other under another
   order, and verifies the rest on the whole sets, by products of incidence
   matrices.
5. A block returns, per class, the number of documents linked there and the
   smallest class connected to it inside the block: no pair leaves a block.
   Links add up per class; components come from smallest-neighbour steps over
   these edges.  ``link_pairs`` returns the pairs themselves, for those who want them.

Defined results: null or blank texts have an empty set and link with nothing;
a row with a null ``doc_id`` links with nothing and has a null component; rows
that repeat a ``doc_id`` are separate rows with that id; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (SHINGLE, binary, blob_column, deal, deal_entries, mix, ranges, release, runs, ship,
                     shuffle_width, small, text_buffer, text_slices, texts, window_hashes, window_starts,
                     word_hashes, word_spans, written)
from .components import components

ORDERS = 3
#: members of a key before the next order's prefix tokens split it
LONG_LIST = 16384
#: classes and bytes of a chunk of a unit (about)
CHUNK, CHUNK_BYTES = 2048, 1 << 24
#: tokens of an incidence matrix at a time
COLUMNS = 4096
#: bytes of shingles dealt to one bucket (about)
BUCKET_BYTES = 1 << 26


def shingle_sets(part, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text (lower-cased A-Z)."""
    data, offs = text_buffer(part.column("text"))
    start, end, ptr = word_spans(data, offs)
    words = word_hashes(data, start, end, lower=True)
    at = window_starts(ptr, k)
    grams = window_hashes(words, k)[at]
    count = np.diff(ptr)
    edge = np.append(0, np.cumsum(np.maximum(count - k + 1, 0)))
    out = []
    for i, n in enumerate(count):
        if n >= k:
            out.append(np.unique(grams[edge[i]:edge[i + 1]]))
        elif n:
            out.append(window_hashes(words[ptr[i]:ptr[i + 1]], int(n)))
        else:
            out.append(grams[:0])
    return out


def _print(tokens: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set."""
    both = np.array([tokens.sum(dtype=np.uint64), mix(tokens).sum(dtype=np.uint64)], np.uint64)
    return tuple(mix(both + np.uint64(len(tokens))).view(np.int64).tolist())


def _classes(k):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(part, k)
                prints = [_print(s) for s in sets]
                yield ship(doc_id=part.column("doc_id"), row_key=part.column("row_key"),
                           n_shingles=pa.array([len(s) for s in sets], pa.int64()),
                           cls=pa.array([p[0] for p in prints], pa.int64()),
                           cls2=pa.array([p[1] for p in prints], pa.int64()))
    return run


def _deal(sets, cls, buckets, dtype):
    """Packed shingles of a slice, one row a bucket: class runs and token prints."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return None
    tokens = np.concatenate(sets)
    out = deal_entries((tokens >> np.uint64(32)) % np.uint64(buckets),
                       np.repeat(np.arange(len(sets)), sizes), {"prints": tokens.astype(dtype)},
                       ids=cls, sizes=sizes.astype(np.uint32))
    return out.select([c.split()[0] for c in DEALT.split(", ")])


DEALT = "bucket int, ids binary, sizes binary, counts binary, prints binary"


def _gate_rows(k, buckets):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                sets = shingle_sets(part, k)
                known = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                sets = [s if ok else s[:0] for s, ok in zip(sets, known)]
                cls = np.array([_print(s)[0] for s in sets], np.int64)
                cls, first = np.unique(cls, return_index=True)       # copies of a slice count once
                if (out := _deal([sets[i] for i in first], cls, buckets, np.uint32)) is not None:
                    yield out
    return run


def _home(cls, homes):
    return mix(cls.view(np.uint64)) % np.uint64(homes)


def _packed(out, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    if out is None:
        return pa.table({c: pa.array([], pa.int32() if c == "bucket" else pa.binary())
                         for c in names})
    return pa.Table.from_batches([out.select(names)])


def _bucket_tokens(table, dtype):
    counts = blob_column(table, "counts", np.uint32).astype(np.int64)
    ids = blob_column(table, "ids", np.int64)
    prints = blob_column(table, "prints", dtype)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return counts, ids, prints, owner


GATED = "bucket int, cls binary, shared binary"


def _gate_counts(homes):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: how many tokens of each class occur in another class too."""
        counts, ids, prints, owner = _bucket_tokens(table, np.uint32)
        order = np.argsort(prints)
        p, c = prints[order], ids[owner[order]]
        cut = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        shared = np.repeat(np.minimum.reduceat(c, cut) != np.maximum.reduceat(c, cut),
                           np.diff(np.append(cut, len(p))))
        found = np.bincount(owner[order[shared]], minlength=len(ids))
        cls, first = np.unique(ids, return_index=True)   # copies have equal counts
        n = found[first]
        cls, n = cls[n > 0], n[n > 0]
        return _packed(deal(_home(cls, homes), cls=cls, shared=n.astype(np.int64)), GATED)
    return run


def _gate_sums(table: pa.Table) -> pa.Table:
    """Of one home: the shared tokens of each class over all buckets."""
    cls, at = np.unique(blob_column(table, "cls", np.int64), return_inverse=True)
    n = np.bincount(at, blob_column(table, "shared", np.int64))
    return pa.table({"cls": cls, "shared": n.astype(np.int64)})


def _partner_rows(k, buckets):
    """As ``_gate_rows`` with whole tokens, of the classes that passed the gate."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                out = _deal(shingle_sets(part, k), part.column("cls").to_numpy(), buckets,
                            np.uint64)
                if out is not None:
                    yield out
    return run


FREQUENT = "bucket int, cls binary, sizes binary, counts binary, tokens binary, freqs binary"


def _frequencies(homes):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: the shared tokens of each class with their class frequency."""
        counts, ids, tokens, owner = _bucket_tokens(table, np.uint64)
        sizes = blob_column(table, "sizes", np.uint32)
        _, first = np.unique(ids, return_index=True)     # a class may stand there twice
        single = np.zeros(len(ids), bool)
        single[first] = True
        keep = single[owner]
        tokens, owner = tokens[keep], owner[keep]
        values, inverse, freq = np.unique(tokens, return_inverse=True, return_counts=True)
        df = freq[inverse]
        tokens, owner, df = tokens[df > 1], owner[df > 1], df[df > 1].astype(np.uint32)
        seg, n = runs(owner)
        return _packed(deal(_home(ids[seg], homes), n, {"tokens": tokens, "freqs": df},
                            cls=ids[seg], sizes=sizes[seg]), FREQUENT)
    return run


def _profiles(percent):
    def run(table: pa.Table) -> pa.Table:
        """Of one home: the shared tokens of each class and its prefix under every order."""
        cls, sizes = blob_column(table, "cls", np.int64), blob_column(table, "sizes", np.uint32)
        counts = blob_column(table, "counts", np.uint32).astype(np.int64)
        tokens = blob_column(table, "tokens", np.uint64)
        freqs = blob_column(table, "freqs", np.uint32)
        order = np.argsort(cls, kind="stable")
        at = ranges((np.cumsum(counts) - counts)[order], counts[order])
        tokens, freqs, first = tokens[at], freqs[at], np.cumsum(counts[order]) - counts[order]
        new = np.flatnonzero(np.append(True, cls[order][1:] != cls[order][:-1]))
        edge = np.append(first[new], len(tokens))
        out = {n: [] for n in ("cls", "size", "shared", "tokens",
                               *(f"head{o}" for o in range(ORDERS)))}
        for i, a, z in zip(order[new], edge[:-1], edge[1:]):
            size, mine, df = int(sizes[i]), tokens[a:z], freqs[a:z]
            need = (percent * size + 99) // 100
            take = size - need + 1 - (size - len(mine))   # unshared tokens come first
            if take <= 0:
                continue
            out["cls"].append(int(cls[i]))
            out["size"].append(size)
            out["shared"].append(len(mine))
            out["tokens"].append(np.sort(mine).tobytes())
            for o in range(ORDERS):
                head = np.lexsort((mix(mine ^ np.uint64(0x9E37 + 0x51ED27 * o)), df))[:take]
                out[f"head{o}"].append(np.sort(mine[head]).tobytes())
        return pa.table({n: pa.array(v, pa.int64()) if n in ("cls", "size", "shared") else binary(v)
                         for n, v in out.items()})
    return run


PROFILE = "cls long, size long, shared long, tokens binary, head0 binary, head1 binary, head2 binary"


def _postings(order):
    """(cls, key) rows of the prefixes; from the second order on, keys combine."""
    def run(batches):
        for batch in batches:
            heads = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(f"head{order}")]
            n = [len(h) for h in heads]
            if not sum(n):
                continue
            key = np.concatenate(heads)
            if order:
                key = mix(np.repeat(batch.column("key").to_numpy().view(np.uint64), n) ^ key)
            yield ship(cls=np.repeat(batch.column("cls").to_numpy(), n), key=key.view(np.int64))
    return run


POST = "cls long, key long"
MEMBER = ("cls long, docs long, size long, tokens binary, marks binary, keys binary, lows binary, "
          "low array<long>")


def _members(batches):
    """Per class: its tokens with a mark per order whose prefix holds them, and its keys with their units."""
    for batch in batches:
        out = {n: [] for n in ("tokens", "marks", "keys", "lows", "low")}
        for i in range(batch.num_rows):
            tokens = np.frombuffer(batch.column("tokens")[i].as_buffer(), np.uint64)
            marks = np.zeros(len(tokens), np.uint8)
            for o in range(1, ORDERS):
                head = np.frombuffer(batch.column(f"head{o}")[i].as_buffer(), np.uint64)
                marks[np.searchsorted(tokens, head)] |= 1 << o
            keyed = batch.column("keyed")[i].values
            keys, lows = (keyed.field(j).to_numpy() for j in (0, 1))
            out["tokens"].append(tokens.tobytes())
            out["marks"].append(marks.tobytes())
            out["keys"].append(keys.tobytes())
            out["lows"].append(lows.tobytes())
            out["low"].append(np.unique(lows))
        yield ship(cls=batch.column("cls"), docs=batch.column("docs"), size=batch.column("size"),
                   low=pa.array(out.pop("low"), pa.list_(pa.int64())),
                   **{n: binary(v) for n, v in out.items()}).select(
                       [c.split()[0] for c in MEMBER.split(", ")])


class _Side:
    """The classes of one chunk: arrays of a block's rows."""

    def __init__(self, rows, unit):
        self.cls, self.docs, self.size = (rows.column(c).to_numpy() for c in ("cls", "docs", "size"))
        self.tokens, self.marks, self.keys, lows = (
            [np.frombuffer(x.as_buffer(), t) for x in rows.column(c)]
            for c, t in (("tokens", np.uint64), ("marks", np.uint8), ("keys", np.int64), ("lows", np.int64)))
        self.own = [low == unit for low in lows]


def _flat(lists):
    """All entries of lists in ascending order, with the number of their list."""
    n = np.array([len(x) for x in lists], np.int64)
    held = np.concatenate(lists) if len(lists) else np.zeros(0, np.uint64)
    order = np.argsort(held, kind="stable")
    return held[order], np.repeat(np.arange(len(lists)), n)[order], order


def _proposed(a: _Side, b: _Side) -> np.ndarray:
    """Pairs whose smallest common key belongs to the block's unit."""
    ka, ra, oa = _flat(a.keys)
    kb, rb, _ = _flat(b.keys)
    own = np.concatenate(a.own)[oa]
    both = np.intersect1d(ka, kb)
    fa, ta = np.searchsorted(ka, both), np.searchsorted(ka, both, "right")
    fb, tb = np.searchsorted(kb, both), np.searchsorted(kb, both, "right")
    seen = np.zeros((len(a.cls), len(b.cls)), bool)
    found = np.zeros_like(seen)
    for i in range(len(both)):
        at = np.ix_(ra[fa[i]:ta[i]], rb[fb[i]:tb[i]])
        if own[fa[i]]:
            found[at] |= ~seen[at]
        seen[at] = True
    return found


def _common(a_lists, b_lists) -> np.ndarray:
    """Number of common entries of every two lists, by products of incidence matrices."""
    ta, ra, _ = _flat(a_lists)
    tb, rb, _ = _flat(b_lists)
    both = np.intersect1d(ta, tb)
    out = np.zeros((len(a_lists), len(b_lists)), np.float32)
    for s in range(0, len(both), COLUMNS):
        some = both[s:s + COLUMNS]
        x, y = (np.zeros((n, len(some)), np.float32) for n in out.shape)
        for m, t, r in ((x, ta, ra), (y, tb, rb)):
            lo, hi = np.searchsorted(t, some[0]), np.searchsorted(t, some[-1], "right")
            at = np.searchsorted(some, t[lo:hi])
            hit = some[at] == t[lo:hi]
            m[r[lo:hi][hit], at[hit]] = 1
        out += x @ y.T
    return out


def _linked(a: _Side, b: _Side, percent: int):
    """(linked, similarity) matrices of a block; a pair of one chunk is looked at once."""
    found = _proposed(a, b)
    if a is b:
        found &= np.triu(np.ones_like(found), 1)
    small, large = np.minimum.outer(a.size, b.size), np.maximum.outer(a.size, b.size)
    found &= 100 * small >= percent * large
    rows, cols = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
    linked, similarity = np.zeros_like(found), np.zeros(found.shape, np.float64)
    if not len(rows):
        return linked, similarity
    i, j = np.nonzero(found)
    if len(i) <= 2 * (len(rows) + len(cols)):
        for x, y in zip(i, j):
            p, q = a.tokens[x], b.tokens[y]
            same, at, bt = np.intersect1d(p, q, True, return_indices=True)
            marks = a.marks[x][at] & b.marks[y][bt]
            union = a.size[x] + b.size[y] - len(same)
            if 100 * len(same) >= percent * union and all((marks & (1 << o)).any() for o in range(1, ORDERS)):
                linked[x, y], similarity[x, y] = True, len(same) / union
        return linked, similarity
    at = np.ix_(rows, cols)
    good = found[at]
    for o in range(1, ORDERS):
        heads = [[s.tokens[r][(s.marks[r] & (1 << o)) > 0] for r in some] for s, some in ((a, rows), (b, cols))]
        good &= _common(*heads) > 0
    same = _common([a.tokens[r] for r in rows], [b.tokens[c] for c in cols]).astype(np.int64)
    union = np.add.outer(a.size[rows], b.size[cols]) - same
    linked[at] = good & (100 * same >= percent * union)
    similarity[at] = same / union
    return linked, similarity


def _least_label(linked, la, lb):
    """Smallest label connected inside the block, for the classes of both sides."""
    most = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(linked, lb[None, :], most).min(axis=1, initial=most))
        nb = np.minimum(lb, np.where(linked, na[:, None], most).min(axis=0, initial=most))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


FOUND = "cls long, root long, links long"
PAIR = "a long, b long, similarity double"


def _block(rows: pa.Table, percent: int, pairs: bool):
    unit, i, j = (rows.column(c)[0].as_py() for c in ("unit", "i", "j"))
    chunk = rows.column("chunk").to_numpy()
    a = _Side(rows.filter(pa.array(chunk == i)), unit)
    b = a if i == j else _Side(rows.filter(pa.array(chunk == j)), unit)
    if not len(a.cls) or not len(b.cls):
        return None
    linked, similarity = _linked(a, b, percent)
    if not linked.any():
        return None
    if pairs:
        x, y = np.nonzero(linked)
        p, q = a.cls[x], b.cls[y]
        return ship(a=np.minimum(p, q), b=np.maximum(p, q), similarity=similarity[x, y])
    if a is b:
        linked = linked | linked.T
        root, _ = _least_label(linked, a.cls, a.cls)
        cls, links = a.cls, linked @ a.docs
    else:
        ra, rb = _least_label(linked, a.cls, b.cls)
        cls, root = np.concatenate([a.cls, b.cls]), np.concatenate([ra, rb])
        links = np.concatenate([linked @ b.docs, a.docs @ linked])
    hit = links > 0
    return ship(cls=cls[hit], root=root[hit], links=links[hit].astype(np.int64))


def _blocks(percent, pairs):
    """Blocks of rows that come sorted by (unit, i, j); a block may span batches."""
    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables(
                    [held, pa.Table.from_batches([batch])])
            if held is None:
                return
            keys = [held.column(c).to_numpy() for c in ("unit", "i", "j")]
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            edges = [0, *cuts.tolist()] + ([held.num_rows] if batch is None else [])
            for a, z in zip(edges[:-1], edges[1:]):
                if (out := _block(held.slice(a, z - a).combine_chunks(), percent, pairs)) is not None:
                    yield out
            held = held.slice(edges[-1]) if batch is not None else None
            release()
    return run


def document_classes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles and the class of equal sets."""
    return texts(docs).mapInArrow(
        _classes(k), "doc_id long, row_key long, n_shingles long, cls long, cls2 long")


def class_profiles(docs: DataFrame, rows: DataFrame, percent: int = 80, k: int = SHINGLE):
    """Tokens and prefixes of the classes that can have a partner, and their number of documents.

    ``rows`` is ``document_classes(docs)``, written.  None if no class can.
    """
    width = shuffle_width(docs.sparkSession)
    linkable = rows.filter("n_shingles > 0 and doc_id is not null")
    # a bucket fits a Python worker several times, whatever the input
    total = linkable.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(2 * width, -(-total * 12 // BUCKET_BYTES))
    counts = (texts(docs).mapInArrow(_gate_rows(k, buckets), DEALT).groupBy("bucket")
              .applyInArrow(_gate_counts(buckets), GATED).groupBy("bucket")
              .applyInArrow(_gate_sums, "cls long, shared long"))
    reps = linkable.groupBy("cls").agg(
        F.min(F.struct("doc_id", "row_key")).alias("rep"), F.max("n_shingles").alias("n"),
        F.count("*").alias("docs"))
    kept = written(reps.join(counts, "cls").filter(f"100 * shared >= {percent} * n")
                   .select("cls", "rep.doc_id", "rep.row_key", "docs"), "jaccard-gate")
    if kept.isEmpty():
        return None
    found = (texts(docs).join(small(kept.drop("docs")), ["doc_id", "row_key"])
             .mapInArrow(_partner_rows(k, buckets), DEALT)
             .groupBy("bucket").applyInArrow(_frequencies(buckets), FREQUENT)
             .groupBy("bucket").applyInArrow(_profiles(percent), PROFILE))
    return written(written(found, "jaccard-found").join(kept.select("cls", "docs"), "cls"),
                   "jaccard-profiles")


def keyed_members(profiles: DataFrame) -> DataFrame:
    """The classes with their keys (``MEMBER``): keys that only one class has are left out."""
    held, posts = None, profiles.select("cls", "head0").mapInArrow(_postings(0), POST)
    for order in range(ORDERS):
        posts = written(posts, "jaccard-keys")
        lists = written(posts.groupBy("key").agg(
            F.count("*").alias("members"), F.min(F.xxhash64("cls")).alias("low"))
            .filter("members > 1"), "jaccard-lists")
        long = F.col("members") > LONG_LIST if order + 1 < ORDERS else F.lit(False)
        these = posts.join(lists.filter(~long), "key").select("cls", "key", "low")
        held = these if held is None else held.union(these)
        again = lists.filter(long)
        if order + 1 == ORDERS or again.isEmpty():
            break
        posts = (posts.join(again, "key", "left_semi").join(profiles.select("cls", f"head{order + 1}"), "cls")
                 .mapInArrow(_postings(order + 1), POST))
    # a class has as many keys as prefix tokens; combined ones multiply the prefixes of its own text
    keyed = held.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("key", "low"))).alias("keyed"))
    return written(profiles.join(keyed, "cls").mapInArrow(_members, MEMBER), "jaccard-members")


def _work(members: DataFrame) -> DataFrame:
    """Members dealt to the blocks (unit, i, j) of their units, sorted by block."""
    units = members.select("*", F.explode("low").alias("unit")).drop("low")
    n = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(
        F.length("tokens") + F.length("keys")) / CHUNK_BYTES)).cast("int")
    cut = written(members.select("tokens", "keys", F.explode("low").alias("unit")).groupBy("unit").agg(
        n.alias("chunks")).filter("chunks > 1"), "jaccard-units")
    dealt = units.join(small(cut), "unit", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))) \
        .withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("chunks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) \
        .select("unit", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                "chunk", "cls", "docs", "size", "tokens", "marks", "keys", "lows")
    return dealt.repartition(shuffle_width(members.sparkSession), "unit", "i", "j") \
        .sortWithinPartitions("unit", "i", "j")


def class_links(members: DataFrame, percent: int = 80) -> DataFrame:
    """(cls, root, links) per block: linked documents of other classes, and the class it is connected to."""
    return _work(members).mapInArrow(_blocks(percent, False), FOUND)


def link_pairs(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """(a, b, similarity): every linked pair of different sets, by their smallest doc_ids."""
    rows = written(document_classes(docs, k), "jaccard-classes")
    profiles = class_profiles(docs, rows, percent, k)
    if profiles is None:
        return docs.sparkSession.createDataFrame([], PAIR)
    found = _work(keyed_members(profiles)).mapInArrow(_blocks(percent, True), PAIR)
    names = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc"))
    for side in ("a", "b"):
        found = found.join(names, F.col(side) == F.col("cls")).drop("cls", side).withColumnRenamed("doc", side)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def similarity_groups(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, class_id, component_id, n_links.

    ``class_id`` is the smallest doc_id with the same set, ``component_id`` the
    smallest one reachable by links, ``n_links`` the number of documents linked
    with it, copies included.
    """
    rows = written(document_classes(docs, k), "jaccard-classes")
    profiles = class_profiles(docs, rows, percent, k)
    linkable = F.expr("n_shingles > 0 and doc_id is not null")
    classes = rows.filter(linkable).groupBy("cls", "cls2").agg(
        F.min("doc_id").alias("class_id"), (F.count("*") - 1).alias("copies"))
    none = F.lit(None).cast("long")
    found = None if profiles is None else written(class_links(keyed_members(profiles), percent), "jaccard-links")
    if found is None or found.isEmpty():
        classes = classes.withColumns({"least": none, "links": none})
    else:
        comp = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")).filter("a != b").distinct())
        links = found.groupBy(F.col("cls").alias("linked")).agg(F.sum("links").alias("links"))
        classes = classes.join(comp, F.col("cls") == F.col("node"), "left").join(
            links, F.col("cls") == F.col("linked"), "left")
        least = written(classes.filter("comp is not null").groupBy("comp")
                        .agg(F.min("class_id").alias("least")), "jaccard-least")
        classes = classes.join(small(least), "comp", "left")
    classes = classes.select(
        F.col("cls").alias("c1"), F.col("cls2").alias("c2"), "class_id",
        F.coalesce("least", "class_id").alias("component_id"),
        (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"))
    return (rows.join(classes, linkable & (F.col("cls") == F.col("c1"))
                      & (F.col("cls2") == F.col("c2")), "left")
            .select("doc_id", "row_key", "n_shingles",
                    F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))
