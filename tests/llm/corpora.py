"""Small corpora for the corpus operators: copies, shared passages, and the odd rows."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: extra columns whose names the operators use inside
CLASHING = ("row_key", "bucket", "size", "cls", "score", "kept", "start", "found", "n_words", "key")


def words(text):
    return WORD.findall(text or "")


def corpus(seed=3, n=120):
    """(doc_id, text, lang, source, n_chars) rows with near copies, copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijkléß") for _ in range(rng.randint(2, 7)))
                  for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(55))
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            text = rng.choice(texts)
        elif texts and kind < 0.45:
            parts = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 2)):
                parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
            text = " ".join(parts)
        else:
            text = " ".join(rng.choice(vocabulary).capitalize() if rng.random() < 0.1
                            else rng.choice(vocabulary) for _ in range(rng.randint(1, 160)))
            if rng.random() < 0.3:
                text += "\n" + passage + "\nfooter line of the site"
        texts.append(text)
        rows.append((i, text, rng.choice(["en", "de", None]), f"src{i % 3}" if i % 11 else None,
                     len(text)))
    return rows


ODD = [(900, None, "en", "src0", None), (901, "", None, None, 0), (902, " \n\t ", "en", "src1", 4),
       (903, "one", "en", "src1", 3), (904, "Einé ﬂuß\x0bzwei drei x", "de", "src2", 12),
       (905, "word " * 30000, "en", "src0", 150000), (None, "lost id lost id lost id", "en", "src0", 9),
       (906, "a b c d e f g h i j k l m n", "en", "src0", 27),
       (906, "a b c d e f g h i j k l m n", "en", "src0", 27),
       (906, "n m l k j i h g f e d c b a", "en", "src1", 27)]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        for c in CLASHING:
            df = df.withColumn(c, df.n_chars.cast("string"))
    return df
