"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text: its distinct words (lower-cased, closing punctuation
ignored), pairs of neighbouring words and pairs with one word between them,
hashed into ``2**BITS`` slots.  Training reads at most ``sample_rows`` labelled
documents (those with the smallest hash of the id), passes over them in hash
order in one task, and keeps one learning rate per coordinate; the L1 term
leaves most weights at exactly zero.  The weights that remain (at most
``2**BITS``) go to every task, and scoring is one pass over the texts without
a shuffle.

Defined results: null or empty text scores the bias alone; without any usable
label every score is 0; labels with a null id or null class are ignored, of
several labels of a document the largest counts; of rows that repeat a labelled
doc_id one is learned from (the smallest text); every input row gets its score;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (binary, crc_mod, mix, ship, short_batches, text_buffer, text_slices, texts,
                     word_hashes, word_spans)

BITS = 20
SAMPLE_ROWS = 12_000
#: bytes of text whose features are made at a time; a feature occurrence takes some 100 bytes on the way
SLICE_BYTES = 1 << 20
#: with L1 = EPOCHS a slot that one document holds never gets a weight
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.0
EPOCHS = 5


def features(part) -> tuple[np.ndarray, np.ndarray]:
    """(slot, row) of every feature occurrence in a slice of texts."""
    data, offs = text_buffer(part.column("text"))
    start, end, ptr = word_spans(data, offs)
    words = word_hashes(data, start, end, lower=True, marks=False)
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    slots, rows = [words], [row]
    for gap in (1, 2):
        a, b = words[:-gap], words[gap:]
        same = row[:-gap] == row[gap:]
        slots.append(mix(a * np.uint64(2 * gap + 1) + mix(b) + np.uint64(gap))[same])
        rows.append(row[gap:][same])
    return ((np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.uint32),
            np.concatenate(rows))


def _feature_rows(batches):
    for batch in batches:
        for part in text_slices(batch, most=SLICE_BYTES):
            slot, row = features(part)
            both = np.unique((row.astype(np.uint64) << np.uint64(32)) | slot)
            cut = np.searchsorted(both, np.arange(part.num_rows + 1, dtype=np.uint64)
                                  << np.uint64(32))
            slot = both.astype(np.uint32)
            yield ship(key=part.column("key"), toxic=part.column("toxic"),
                       slots=binary([slot[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]))


class Ftrl:
    """Weights of a logistic model, updated one document at a time."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at):
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1)
                        / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at, label):
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
        self.n[at] = new


def _train(table: pa.Table) -> pa.Table:
    """Of the whole (bounded) sample: the non-zero weights."""
    order = np.lexsort((table.column("key").to_numpy(), ))
    labels = table.column("toxic").to_numpy()
    col = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("slots")]   # views, no copy
    model, bias = Ftrl(), np.array([1 << BITS], np.int64)
    for _ in range(EPOCHS):
        for i in order:
            model.learn(np.append(col[i].astype(np.int64), bias), labels[i])
    at = np.flatnonzero(np.abs(model.z) > L1)
    w = model.weights(at)
    at, w = at[w != 0], w[w != 0]
    return pa.table({"slots": binary([at.astype(np.uint32).tobytes()]),
                     "weights": binary([w.tobytes()])})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(slots, weights) of the non-zero coordinates, or None without labels.

    ``labels`` holds doc_id and toxic, already restricted to training rows.
    """
    known = (labels.filter("doc_id is not null and toxic is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max("toxic").cast("double").alias("toxic"))
             .withColumn("key", F.xxhash64("doc_id")))
    sample = known.orderBy("key", "doc_id").limit(sample_rows)
    rows = (texts(docs).join(F.broadcast(sample), "doc_id")    # at most sample_rows rows
            .groupBy("doc_id", "key", "toxic").agg(F.min("text").alias("text"))
            .mapInArrow(_feature_rows, "key long, toxic double, slots binary")
            .withColumn("model", F.lit(0)))
    with short_batches(docs.sparkSession):
        model = (rows.groupBy("model").applyInArrow(_train, "slots binary, weights binary")
                 .collect())                                   # at most 2**BITS + 1 weights
    if not model:
        return None
    return np.frombuffer(model[0][0], np.uint32), np.frombuffer(model[0][1], np.float64)


def _score(model):
    def run(batches):
        dense = np.zeros((1 << BITS) + 1)
        if model is not None:
            dense[model[0]] = model[1]
        for batch in batches:
            for part in text_slices(batch, most=SLICE_BYTES):
                slot, row = features(part)
                w = dense[slot]
                some = np.flatnonzero(w)
                both = np.unique((row[some].astype(np.uint64) << np.uint64(32)) | slot[some])
                total = np.bincount((both >> np.uint64(32)).astype(np.int64),
                                    dense[both.astype(np.uint32)], part.num_rows) + dense[-1]
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35))) if model is not None \
                    else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_key"), pa.array(score)],
                    ["doc_id", "row_key", "score"])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out_mod: int = 5,
                    sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, row_key, held_out, score, predicted.

    Documents whose crc32(doc_id) mod ``held_out_mod`` is 0 are never learned from.
    """
    held = F.coalesce(crc_mod(F.col("doc_id").cast("long"), held_out_mod) == 0, F.lit(False))
    model = train(docs, labels.filter(~held), sample_rows)
    return (texts(docs).mapInArrow(_score(model), "doc_id long, row_key long, score double")
            .select("doc_id", "row_key", held.alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))
