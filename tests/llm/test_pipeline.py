"""The corpus pipeline on a small table with planted cases, stage by stage."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from listwright.llm import minhash, mixing, piece_sampling

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(12)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        body = " ".join(rnd.choice(words) for _ in range(rnd.randrange(30, 90))) + "."
        kind = "junk" if i % 8 == 1 else "toxic" if i % 8 == 3 else "copy" if i % 8 == 5 else "clean"
        if kind == "junk":
            body = " ".join(w.upper() + "!!" for w in body.split())
        if kind == "toxic":
            body += f" You {rnd.choice(['vile', 'rotten'])} thing."
        if kind == "copy":
            body = rows[i - 1][1]
        rows.append((i, body, "en", rnd.choice("abc"), len(body)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    rows.append((1000, None, None, None, None))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        seen.append(Counter(r.doc_id for r in docs.collect()))
    clean = {i for i in range(400) if i % 8 not in (1, 3, 5)}
    assert set(seen[0]) & set(range(400)) == {i for i in range(400) if i % 8 != 1}
    assert set(seen[1]) & set(range(400)) == {i for i in range(400) if i % 8 not in (1, 3)}
    assert set(seen[2]) & set(range(400)) == clean and max(seen[2].values()) == 1
    assert seen[3] and max(seen[3].values()) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    sampler = piece_sampling.Sampler(piece_sampling.Settings())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id for r in last} == set(text)
    assert all(sampler.decode(np.array(r.ids, np.int64)) == text[r.doc_id] for r in last)


def test_distinct_documents(spark, folder):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (0, "A b c d e f", "en", "s", 1), (2, "", "en", "s", 0), (None, "x", None, None, None)]
    got = corpus_pipeline.distinct_documents(spark, spark.createDataFrame(rows, COLUMNS), folder)
    assert sorted((str(r.doc_id) for r in got.collect())) == ["0", "2", "None"]
    twice = spark.createDataFrame(rows[:2], COLUMNS)
    assert corpus_pipeline.distinct_documents(spark, twice, folder).count() == 1


def test_run(spark, folder):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "minhash", "mixing", "pieces"]
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert minhash.Settings().width == 5 and mixing.MOST == 3
