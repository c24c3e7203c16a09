import random
from collections import Counter

import pytest
from corpora import frame, words

pytest.importorskip("public_tokenizers")
import corpus_pipeline as CP  # noqa: E402

RNG = random.Random(17)
VOCAB = ["".join(RNG.choice("abcdefghijklm") for _ in range(6)) for _ in range(1500)]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean documents, toxic ones, copies, near copies and leaks, each known by id."""
    sf = tmp_path_factory.mktemp("sf")
    rows, labels, kinds = [], [], {}
    item = prose(40)

    def add(kind, text):
        i = len(rows)
        kinds[i] = kind
        rows.append((i, text, "en", f"s{i % 3}", len(text or "")))
        labels.append((i, 1, int(kind == "toxic")))
    for _ in range(260):
        add("clean", prose(RNG.randint(30, 90)))
    for _ in range(80):
        w = prose(60).split()
        for _ in range(4):
            w.insert(RNG.randrange(len(w)), RNG.choice(["dolt", "fool", "oaf"]))
        add("toxic", " ".join(w))
    for _ in range(10):
        add("copy", rows[RNG.randrange(260)][1])
        w = rows[RNG.randrange(260)][1].split()
        add("near", " ".join(w + ["extra"]))
        add("leak", prose(20) + " " + item + " " + prose(20))
    add("blank", "")
    add("blank", None)
    frame(spark, rows).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        str(sf / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        str(sf / "benchmark.parquet"))
    return str(sf), rows, kinds


def test_stage_names_and_columns(spark, planted):
    assert len(CP.STAGES) == 5 and CP.ORACLE_SQL is None


def test_stages_take_effect(spark, planted):
    sf, rows, kinds = planted
    docs, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in CP.STAGES[:-1]:
        docs = CP.written(stage(spark, docs, sf), "t")
        assert tuple(docs.columns) == CP.COLUMNS
        left[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())

    def of(name, kind):
        return {i for i in left[name] if kinds[i] == kind}
    clean = {i for i, k in kinds.items() if k == "clean"}
    assert len(of("toxicity", "toxic")) <= 2 and of("toxicity", "clean") == clean
    assert not of("ngram_jaccard_join", "copy") and not of("ngram_jaccard_join", "near")
    assert of("ngram_jaccard_join", "clean") == clean and len(of("ngram_jaccard_join", "blank")) == 2
    assert not of("benchmark_decontamination", "leak")
    assert of("benchmark_decontamination", "clean") == clean
    assert max(left["source_mixing"].values()) <= 3
    size = {i: len(words(t)) for i, t, *_ in rows}
    taken = Counter()
    for r in docs.collect():
        taken[r.doc_id] += len(words(r.text))
    assert sum(taken.values()) == pytest.approx(sum(size[i] for i in left["benchmark_decontamination"]),
                                                abs=3)
    assert all(taken[i] <= 3 * size[i] for i in taken)


def test_run_reads_the_files_back(spark, planted):
    sf, *_ = planted
    out = CP.run(spark, sf).collect()
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_empty_documents(spark, planted, empty, tmp_path):
    sf, *_ = planted
    docs = empty
    for _, stage in CP.STAGES:
        docs = CP.written(stage(spark, docs, sf), "t")
        assert docs.count() == 0
