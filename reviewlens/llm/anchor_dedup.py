"""Substring dedup by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``(window + 1) // 2``
words (the reference blocks).  Any ``window`` consecutive words hold one
whole block, so a repeat of ``window`` words or more always shows as a
rolling block-sized run of one document that equals a reference block of
another.  The work takes three passes:

1. All rolling runs are dealt by hash; runs that equal a reference block and
   occur in two documents or more are hits (32 bits within a bucket: a
   superset, which pass 2 checks).
2. Hits are extended: every ``window``-word run that holds a hit is dealt by
   its 128-bit hash, and the smallest document that starts it is found.
   Neighbouring matched runs overlap, so their union is the maximal exact
   repeat.
3. Words of repeats owned by a smaller document are cut out of the text.

A passage found in very many documents is a run of equal entries in one
bucket, never a set of pairs, so hot passages cost what their words cost.

Defined results: null text counts as empty; texts shorter than the window
stay as they are; rows with a null ``doc_id`` are left whole and are nobody's
reference; rows that repeat a ``doc_id`` never remove each other's words (no
id is smaller); an empty table gives an empty table.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import (binary, blob_column, by_bucket, deal, deal_entries, mix, ranges, runs, ship,
                     shuffle_width, text_buffer, text_slices, texts, window_hashes, window_starts,
                     word_hashes, word_spans, written)

PROBES = "bucket int, ids binary, keys binary, counts binary, prints binary, marks binary"
HITS = "bucket int, blocks binary, ids binary, keys binary, counts binary, hits binary"
WINDOWS = "bucket int, ids binary, keys binary, counts binary, prints binary, places binary"
SPANS = "bucket int, ids binary, keys binary, counts binary, places binary"
OF_DOCUMENT = "doc_id long, row_key long, found binary"


def _block(window: int) -> int:
    return (window + 1) // 2


def _rolling(batch, window, buckets):
    """Rolling block hashes of a slice: (word index, row, bucket, 32-bit print, is a block)."""
    size = _block(window)
    data, offs = text_buffer(batch.column("text"))
    start, end, ptr = word_spans(data, offs)
    known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    usable = known & (np.diff(ptr) >= window)
    at = window_starts(ptr, size)
    row = np.searchsorted(ptr, at, side="right") - 1
    keep = usable[row]
    at, row = at[keep], row[keep]
    h = window_hashes(word_hashes(data, start, end), size)[at]
    place = at - ptr[row]
    return data, start, end, ptr, at, row, (h >> np.uint64(32)) % np.uint64(buckets), \
        h.astype(np.uint32), place % size == 0


def _probes(window, buckets):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                *_, row, bucket, prints, mark = _rolling(part, window, buckets)
                out = deal_entries(bucket, row, {"prints": prints, "marks": mark.astype(np.uint8)},
                                   ids=part.column("doc_id").fill_null(0).to_numpy(),
                                   keys=part.column("row_key").to_numpy())
                if out is not None:
                    yield out.select([c.split()[0] for c in PROBES.split(", ")])
    return run


def _home(ids, keys, homes):
    """Where the findings of a document are gathered."""
    return mix(mix(ids.view(np.uint64)) ^ keys.view(np.uint64)) % np.uint64(homes)


def _answer(schema, owner, hit, values, name, ids, keys, homes, **scalars):
    """Findings (ascending entry numbers ``hit``) as packed rows by the document's home."""
    seg, n = runs(owner[hit])
    out = deal(_home(ids[seg], keys[seg], homes), n, {name: values}, ids=ids[seg], keys=keys[seg],
               **{k: np.full(len(seg), v, np.uint32) for k, v in scalars.items()})
    names = [c.split()[0] for c in schema.split(", ")]
    if out is None:
        return pa.table({c: pa.array([], pa.int32() if c == "bucket" else pa.binary())
                         for c in names})
    return pa.Table.from_batches([out.select(names)])


def _find_hits(homes):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: the rolling runs that equal a block and occur in two documents."""
        counts = blob_column(table, "counts", np.uint32).astype(np.int64)
        ids, keys = blob_column(table, "ids", np.int64), blob_column(table, "keys", np.int64)
        prints, mark = blob_column(table, "prints", np.uint32), blob_column(table, "marks", np.uint8)
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        order = np.argsort(prints)
        cut = _edges(prints[order])
        doc = ids[owner[order]]
        good = (np.maximum.reduceat(mark[order], cut) > 0) \
            & (np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut))
        flag = np.zeros(len(prints), bool)
        flag[order] = np.repeat(good, np.diff(np.append(cut, len(prints))))
        hit = np.flatnonzero(flag)
        ordinal = (hit - (np.cumsum(counts) - counts)[owner[hit]]).astype(np.uint32)
        return _answer(HITS, owner, hit, ordinal, "hits", ids, keys, homes,
                       blocks=table.column("bucket")[0].as_py())
    return run


def _gather(name):
    def run(table: pa.Table) -> pa.Table:
        """Of one home: a row per document with all its findings.

        Segments follow each other as 32-bit numbers; with ``blocks``, each
        starts with its bucket and its length.
        """
        counts = blob_column(table, "counts", np.uint32).astype(np.int64)
        ids, keys = blob_column(table, "ids", np.int64), blob_column(table, "keys", np.int64)
        values = blob_column(table, name, np.uint32)
        order = np.lexsort((keys, ids))
        each, head = counts[order], 0
        if "blocks" in table.schema.names:
            head = 2
        first = np.cumsum(each + head) - each - head
        out = np.empty(int((each + head).sum()), np.uint32)
        out[ranges(first + head, each)] = values[ranges((np.cumsum(counts) - counts)[order], each)]
        if head:
            out[first] = blob_column(table, "blocks", np.uint32)[order]
            out[first + 1] = each
        ids, keys = ids[order], keys[order]
        new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
        edge = np.append(first[new], len(out))
        return pa.table({"doc_id": ids[new], "row_key": keys[new], "found": binary(
            [out[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])])})
    return run


def _edges(values):
    return np.flatnonzero(np.append(True, values[1:] != values[:-1]))


def _windows(window, buckets):
    """Extend: the windows that hold a hit, dealt by their 128-bit hash."""
    size = _block(window)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                data, start, end, ptr, at, row, bucket, _, _ = _rolling(part, window, buckets)
                flag = np.zeros(len(start) + 1, np.int32)
                order, cuts = by_bucket(row * buckets + bucket.astype(np.int64))
                where = {b: x for b, x, _ in cuts}
                for i, found in enumerate(part.column("found")):
                    found = np.frombuffer(found.as_buffer(), np.uint32)
                    k = 0
                    while k < len(found):
                        base, n = where.get(i * buckets + int(found[k])), int(found[k + 1])
                        if base is not None:
                            flag[at[order[base + found[k + 2:k + 2 + n].astype(np.int64)]]] = 1
                        k += n + 2
                seen = np.append(0, np.cumsum(flag))
                p = window_starts(ptr, window)
                p = p[seen[np.minimum(p + size, len(flag))] > seen[p]]
                if not len(p):
                    continue
                who = np.searchsorted(ptr, p, side="right") - 1
                prints = np.empty((len(p), 2), np.uint64)
                for s in (0, 1):
                    words = word_hashes(data, start, end, seed=s)
                    prints[:, s] = window_hashes(words, window, seed=s)[p]
                ids = part.column("doc_id").to_numpy()
                keys = part.column("row_key").to_numpy()
                place = (p - ptr[who]).astype(np.uint32)
                out = deal_entries(mix(prints[:, 0]) % np.uint64(buckets), who,
                                   {"prints": prints, "places": place}, ids=ids, keys=keys)
                yield out.select([c.split()[0] for c in WINDOWS.split(", ")])
    return run


def _owned_elsewhere(homes):
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: places of windows that a smaller document also starts."""
        counts = blob_column(table, "counts", np.uint32).astype(np.int64)
        ids, keys = blob_column(table, "ids", np.int64), blob_column(table, "keys", np.int64)
        prints = blob_column(table, "prints", np.uint64).reshape(-1, 2)
        places = blob_column(table, "places", np.uint32)
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        order = np.lexsort((prints[:, 1], prints[:, 0]))
        p = prints[order]
        cut = np.flatnonzero(np.append(True, (p[1:] != p[:-1]).any(axis=1)))
        doc = ids[owner[order]]
        least = np.repeat(np.minimum.reduceat(doc, cut), np.diff(np.append(cut, len(p))))
        flag = np.zeros(len(places), bool)
        flag[order] = doc > least
        hit = np.flatnonzero(flag)
        return _answer(SPANS, owner, hit, places[hit], "places", ids, keys, homes)
    return run


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, row_key, found): starts of windows that a smaller document also starts.

    ``found`` is a byte string of unsigned 32-bit word positions.
    """
    width = shuffle_width(docs.sparkSession)
    buckets = 2 * width                     # a bucket fits a Python worker several times
    source = texts(docs)
    hits = written(source.mapInArrow(_probes(window, buckets), PROBES).groupBy("bucket")
                   .applyInArrow(_find_hits(width), HITS), "anchor-hits")
    hits = hits.groupBy("bucket").applyInArrow(_gather("hits"), OF_DOCUMENT)
    spans = written(source.join(hits, ["doc_id", "row_key"]).mapInArrow(
        _windows(window, buckets), WINDOWS).groupBy("bucket")
        .applyInArrow(_owned_elsewhere(width), SPANS), "anchor-spans")
    return spans.groupBy("bucket").applyInArrow(_gather("places"), OF_DOCUMENT)


def _cut(window):
    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("n_words", "n_removed", "n_spans", "kept", "sha")}
            for text, found in zip(batch.column("text").to_pylist(),
                                   batch.column("found").to_pylist()):
                words = (text or "").encode().split()
                n_spans, keep = 0, None
                if found:
                    p = np.unique(np.frombuffer(found, np.uint32))
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + window, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    n_spans = int((np.diff(np.append(False, gone).astype(np.int8)) == 1).sum())
                    keep = np.flatnonzero(~gone).tolist()
                kept = b" ".join(words if keep is None else [words[i] for i in keep])
                out["n_words"].append(len(words))
                out["n_removed"].append(0 if keep is None else len(words) - len(keep))
                out["n_spans"].append(n_spans)
                out["kept"].append(kept.decode())
                out["sha"].append(hashlib.sha256(kept).hexdigest())
            yield ship(doc_id=batch.column("doc_id"),
                       n_words=pa.array(out["n_words"], pa.int64()),
                       n_removed=pa.array(out["n_removed"], pa.int64()),
                       n_spans=pa.array(out["n_spans"], pa.int64()),
                       kept_text=pa.array(out["kept"], pa.string()),
                       kept_sha256=pa.array(out["sha"], pa.string()))
    return run


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, n_spans, kept_text, kept_sha256.

    ``kept_text`` holds the words left, joined by one space; ``n_spans`` counts
    the maximal repeated stretches that were cut.
    """
    places = repeated_windows(docs, window)
    return (texts(docs).join(places, ["doc_id", "row_key"], "left")
            .select("doc_id", "text", "found")
            .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, n_spans long, "
                                      "kept_text string, kept_sha256 string"))
