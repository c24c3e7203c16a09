import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from corpora import FOLD, frame
from reviewlens.llm import spelling_variants as sv

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute(rows, least=6, least_n=5, times=5):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= least_n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    close = defaultdict(set)
    for a in count:
        for b in count:
            if a < b and near(a, b):
                close[a].add(b)
                close[b].add(a)
    form = {}
    for w in count:
        top = min(close[w], key=lambda x: (-count[x], x), default=None)
        if top and count[top] >= times * count[w]:
            form[w] = top
    out = set()
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, count[w], len(close[w]), count.get(form.get(w))))
    return out


def vocabulary_rows(seed=5):
    """Words with edits, anagrams, repeated letters, accents, and chains of forms."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abßéÿ×") for _ in range(rng.randint(6, 9))) for _ in range(60)]
    for w in list(words):
        i = rng.randrange(len(w))
        words += [w[:i] + w[i + 1:], w[:i] + "q" + w[i:], w[:i] + "z" + w[i + 1:], w[::-1]]
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaab", "Àaaaaaa", "àaaaaaa"]
    rows = []
    for doc_id in range(40):
        text = " ".join(rng.choice(words) + rng.choice([" ", "-", "1", "\n"])
                        for _ in range(200)) + " aaaaaaa" * 30 + " AAAAAAaa" * 6
        rows.append((doc_id, text, "en", "s", len(text)))
    chain = "uvwxyz " * 6 + "uvwxyzu " * 40 + "uvwxyzuv " * 300        # forms of forms
    return rows + [(50, chain, "en", "s", 1), (None, "aaaaaaa " * 9, "en", None, 1), (7, "repeated " * 8, "en", "s", 2),
                   (7, "repeated " * 8, "en", "s", 2), (90, None, None, None, None), (91, "", "en", "s", 0),
                   (92, "b" * 40000 + " longlong" * 20000, "en", "s", 9)]


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_equals_brute_force(spark):
    rows = vocabulary_rows()
    got = [tuple(r) for r in sv.spelling_variants(frame(spark, rows)).select(*COLUMNS).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_hot_keys_give_the_same_pairs(spark):
    words = sv.frequent_words(frame(spark, vocabulary_rows())).cache()
    cold, hot, all_hot = (sorted(map(tuple, sv.near_pairs(words, k).collect())) for k in (1 << 16, 3, 0))
    assert cold and cold == hot == all_hot


def test_near_words_share_a_signature():
    rng = random.Random(1)
    a = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 12))) for _ in range(300)]
    b = []
    for w in a:
        i = rng.randrange(len(w))
        b.append(rng.choice([w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1:]]))
    assert (sv.signatures(a) == sv.signatures(b)).any(axis=1).all()
    assert len(np.unique(sv.signatures(["listens", "silents"]), axis=0)) == 1     # equal letters


def test_chains_of_forms(spark):
    chain = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(13)], "word string, form string")
    assert {r.root for r in sv.roots(chain).collect()} == {"w13"}


def test_empty(empty):
    assert sv.spelling_variants(empty).collect() == []
