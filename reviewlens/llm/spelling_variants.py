"""Spelling variants of the corpus vocabulary by PartEnum signatures.

1. Runs of letters are counted over whole texts, added up per slice of text
   before anything is shuffled.
2. The letters of a word form a multiset, read as a binary vector over
   (letter, occurrence).  One inserted, deleted or replaced letter changes at
   most two of its entries.  The entries are dealt to ``PARTS`` partitions; at
   most two partitions differ, so near words agree on all the others: the
   enumerated signatures are the contents of every choice of ``PARTS - 2``
   partitions.
3. Signatures are equi-joined.  Anagrams share all of them, so a join key is a
   signature with one half of the word: an edit leaves the first or the second
   half of the shorter word as it was, which makes the key exact.
4. Members of a key are verified without comparing all of them: words that
   differ by one replaced letter are equal without it, and a word with an
   inserted letter equals the other one without that letter.  Hits of these
   hashes are confirmed letter by letter.  A word has at most as many near
   words as its alphabet allows, so verified pairs grow with the vocabulary.
   Keys with more than ``HOT_KEY`` words are dealt anew by the same hashes.
5. Near pairs are added up per word; roots follow the forms by pointer jumping.

Defined results: null or blank texts have no words; a null ``doc_id`` counts as
an empty id in the run's checksum; rows that repeat a ``doc_id`` are counted
each; ties go to the smallest word in code-point order; an empty table or one
without frequent words gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ranges, ship, shuffle_width, text_slices, texts, written

#: partitions of the (letter, occurrence) entries; near words differ in at most two
PARTS, DIFFER = 4, 2
#: words of one key that a task verifies together
HOT_KEY = 1 << 16
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_CHOICES = list(itertools.combinations(range(PARTS), PARTS - DIFFER))


# --- counting -------------------------------------------------------------------

def _counts(least: int, one_in: int):
    runs_of = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                ids = part.column("doc_id").to_pylist()
                lower = pc.ascii_lower(pc.fill_null(part.column("text"), ""))
                total: Counter = Counter()
                for doc_id, text in zip(ids, lower):
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(runs_of.findall(text.as_py())).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < least:
                                continue
                        total[word] += n
                if total:
                    yield ship(word=pa.array(total.keys(), pa.string()),
                               n=pa.array(total.values(), pa.int64()))
    return run


def frequent_words(docs: DataFrame, least_chars: int = 6, least_n: int = 5,
                   one_in: int = 199) -> DataFrame:
    """(word, n) of the letter runs, one in ``one_in`` of them with a letter deleted."""
    return (texts(docs).mapInArrow(_counts(least_chars, one_in), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n))


# --- signatures -----------------------------------------------------------------

def _letters(words: list[str]):
    """Code points of all words, and each word's range in them."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ptr = np.append(0, np.cumsum([len(w) for w in words])).astype(np.int64)
    return flat, ptr


def _sums(ptr, terms):
    """Running sums, so that any stretch of a word is a difference."""
    return np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))


def _power(n):
    p = np.full(max(n, 1), _B, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _placed(flat, ptr):
    """Letters hashed with their place in the word."""
    size = np.diff(ptr)
    place = np.arange(len(flat)) - np.repeat(ptr[:-1], size)
    return mix(flat + np.uint64(7)) * _power(int(size.max(initial=1)))[place], place


def signatures(words: list[str]) -> np.ndarray:
    """PartEnum signatures: a row per word, a column per choice of partitions."""
    flat, ptr = _letters(words)
    owner = np.repeat(np.arange(len(words)), np.diff(ptr))
    order = np.lexsort((flat, owner))
    new = np.append(True, (flat[order][1:] != flat[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    first = np.flatnonzero(new)
    occurrence = np.arange(len(flat)) - np.repeat(first, np.diff(np.append(first, len(flat))))
    entry = mix((flat[order] << np.uint64(32)) + occurrence.astype(np.uint64) + np.uint64(1))
    part = ((entry >> np.uint64(40)) % np.uint64(PARTS)).astype(np.int64)
    content = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(content, (owner[order], part), mix(entry ^ _B))
    out = np.empty((len(words), len(_CHOICES)), np.uint64)
    for c, chosen in enumerate(_CHOICES):
        held = np.full(len(words), c + 1, np.uint64)
        for p in chosen:
            held = mix(held * _B + content[:, p])
        out[:, c] = held
    return out


def _halves(flat, ptr):
    """(word index, hash) of the halves that a near word shares: by its own length, and one shorter."""
    placed, _ = _placed(flat, ptr)
    total, size = _sums(ptr, placed), np.diff(ptr)
    # the end of a word, read from its own start so that equal ends have equal hashes
    back = np.empty(len(flat), np.uint64)
    at = np.repeat(ptr[1:], size) - 1 - np.arange(len(flat))
    back[:] = mix(flat + np.uint64(11)) * _power(int(size.max(initial=1)))[at]
    behind = _sums(ptr, back)
    index, out = [], []
    for h, keep in ((size // 2, size > 0), ((size - 1) // 2, (size % 2 == 0) & (size > 0))):
        who = np.flatnonzero(keep)
        h = h[who]
        front = total[ptr[who] + h] - total[ptr[who]]
        rear = behind[ptr[who + 1]] - behind[ptr[who + 1] - h]
        tag = h.astype(np.uint64) * np.uint64(2)
        index += [who, who]
        out += [mix(front ^ mix(tag + np.uint64(1))), mix(rear ^ mix(tag + np.uint64(2)))]
    return np.concatenate(index), np.concatenate(out)


KEYED = "key long, word string, n long"


def _keys(batches):
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for a in range(0, len(words), 4096):
            some = words[a:a + 4096]
            flat, ptr = _letters(some)
            who, half = _halves(flat, ptr)
            key = mix(signatures(some)[who] + half[:, None] * _B)
            at = np.repeat(who, len(_CHOICES))
            yield ship(key=pa.array(key.ravel().view(np.int64)),
                       word=pa.array(some, pa.string()).take(pa.array(at)), n=n[a:a + 4096][at])


# --- verification ---------------------------------------------------------------

def _without(words: list[str], key: np.ndarray):
    """Hash entries of every word: (entry, word index, deleted place or -1).

    A replaced letter leaves equal rests at the same place; a word equals the
    rest of a word that has one letter more.
    """
    flat, ptr = _letters(words)
    size = np.diff(ptr)
    placed, place = _placed(flat, ptr)
    total = _sums(ptr, placed)
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(flat))
    rest = (total[at] - total[ptr[owner]]) + (total[ptr[owner + 1]] - total[at + 1]) * _B_INVERSE
    whole = total[ptr[1:]] - total[ptr[:-1]]
    length = (size[owner] - 1).astype(np.uint64)
    seed = mix(key)
    shorter = mix(mix(rest + seed[owner]) + length * np.uint64(2))
    same = mix(shorter ^ mix(place.astype(np.uint64) + np.uint64(3)))
    as_is = mix(mix(whole + seed) + size.astype(np.uint64) * np.uint64(2))
    return (np.concatenate([same, shorter, as_is]),
            np.concatenate([owner, owner, np.arange(len(words))]),
            np.concatenate([place, place, np.full(len(words), -1)]),
            np.repeat(np.array([0, 1, 2], np.int8), [len(at), len(at), len(words)]))


def _near(a: str, b: str, place: int, kind: int) -> bool:
    if kind == 0:
        return a[:place] == b[:place] and a[place + 1:] == b[place + 1:] and a[place] != b[place]
    return a[:place] + a[place + 1:] == b


def _pairs_of(entry, owner, place, kind, words):
    """Confirmed near pairs (index, index) among entries with equal hashes.

    Kind 0 meets kind 0 (replaced), kind 1 meets kind 2 (inserted).
    """
    order = np.lexsort((kind, entry))
    e, o, p, k = entry[order], owner[order], place[order], kind[order]
    cut = np.flatnonzero(np.append(True, e[1:] != e[:-1])) if len(e) else np.zeros(0, np.int64)
    edge = np.append(cut, len(e))
    found = set()
    for s in np.flatnonzero(np.diff(edge) > 1):
        a, z = edge[s], edge[s + 1]
        if k[a] == 0:
            for i, j in itertools.combinations(range(a, z), 2):
                if o[i] != o[j] and _near(words[o[i]], words[o[j]], p[i], 0):
                    found.add((min(o[i], o[j]), max(o[i], o[j])))
        elif k[z - 1] == 2:
            for j in range(z - 1, a, -1):
                if k[j] != 2:
                    break
                for i in range(a, j):
                    if k[i] == 1 and _near(words[o[i]], words[o[j]], p[i], 1):
                        found.add((min(o[i], o[j]), max(o[i], o[j])))
    return found


PAIRS = "a string, b string, a_n long, b_n long"


def _shipped(found, words, n):
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    a, b = pairs[:, 0], pairs[:, 1]
    held = pa.array(words, pa.string())
    swap = np.array([words[i] > words[j] for i, j in pairs], bool)
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return ship(a=held.take(pa.array(a)), b=held.take(pa.array(b)), a_n=n[a], b_n=n[b])


def _verify(batches):
    """Near pairs of every key; the rows come sorted by key, a key may span batches."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = batch if held is None else pa.Table.from_batches(
                [held, batch]).combine_chunks().to_batches()[0]
            key = held.column("key").to_numpy()
            ready = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if ready < 4096:
                continue
        elif held is None or held.num_rows == 0:
            return
        else:
            ready = held.num_rows
        part, held = held.slice(0, ready), held.slice(ready)
        key = part.column("key").to_numpy()
        lone = np.append(True, key[1:] != key[:-1]) & np.append(key[1:] != key[:-1], True)
        part = part.filter(pa.array(~lone))
        if not part.num_rows:
            continue
        words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
        found = _pairs_of(*_without(words, key[~lone].view(np.uint64)), words)
        if found:
            yield _shipped(found, words, n)


def _hot_entries(batches):
    """Entries of the words of hot keys, to be dealt by entry."""
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        if words:
            entry, owner, place, kind = _without(words, np.zeros(len(words), np.uint64))
            yield ship(key=pa.array(entry.view(np.int64)),
                       word=pa.array(words, pa.string()).take(pa.array(owner)), n=n[owner],
                       place=place.astype(np.int32), kind=kind.astype(np.int32))


def _verify_entries(batches):
    """As ``_verify`` for rows that are dealt and sorted by entry (groups are small: one per rest)."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = batch if held is None else pa.Table.from_batches(
                [held, batch]).combine_chunks().to_batches()[0]
            key = held.column("key").to_numpy()
            ready = int(np.searchsorted(key, key[-1])) if len(key) else 0
        else:
            ready = held.num_rows if held is not None else 0
        if not ready:
            continue
        part, held = held.slice(0, ready), held.slice(ready)
        words = part.column("word").to_pylist()
        found = _pairs_of(part.column("key").to_numpy().view(np.uint64), np.arange(len(words)),
                          part.column("place").to_numpy(), part.column("kind").to_numpy(), words)
        if found:
            yield _shipped(found, words, part.column("n").to_numpy())


def near_pairs(words: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b, a_n, b_n), a < b: every pair of ``words(word, n)`` one edit apart, once."""
    width = shuffle_width(words.sparkSession)
    keyed = written(words.mapInArrow(_keys, KEYED), "variant-keys")
    hot = written(keyed.groupBy("key").count().filter(F.col("count") > hot_key).select("key"),
                  "variant-hot")
    some_hot = not hot.isEmpty()
    rest = keyed.join(hot, "key", "left_anti") if some_hot else keyed
    found = rest.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_verify, PAIRS)
    if some_hot:
        members = keyed.join(hot, "key", "left_semi").select("word", "n").distinct()
        found = found.union(
            members.mapInArrow(_hot_entries, KEYED + ", place int, kind int")
            .repartition(width, "key").sortWithinPartitions("key").mapInArrow(_verify_entries, PAIRS))
    return found.distinct()


# --- forms and roots ------------------------------------------------------------

def spelling_variants(docs: DataFrame, least_chars: int = 6, least_n: int = 5, times: int = 5,
                      one_in: int = 199) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    ``form`` is the most frequent near word if it occurs at least ``times`` as
    often; ``root`` the last word reached over forms.
    """
    words = written(frequent_words(docs, least_chars, least_n, one_in), "variant-words")
    pairs = written(near_pairs(words), "variant-pairs")
    both = pairs.select("a", "b", "b_n").union(pairs.select("b", "a", "a_n"))
    near = both.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), "b")).alias("top"))
    formed = F.expr(f"-top.n >= {times} * n")
    table = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(formed, F.col("top.b")).alias("form"),
        F.when(formed, -F.col("top.n")).alias("form_n")), "variant-forms")
    return table.join(roots(table.filter("form is not null").select("word", "form")), "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of every chain of ``forms(word, form)``; steps double in length."""
    step = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(step.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")), "variant-roots")
        if longer.filter("moved").isEmpty():
            return longer.select("word", "root")
        step = longer.select("word", "root")
