"""Given columns of any name and type come back unchanged; keys may repeat; calibration is isotonic."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listwright.llm import embedding_dedup, mixing, neighbour_graph, quality, toxicity

NAMES = ["size", "copies", "copy", "target", "source_size", "source_key", "_row", "row", "rest", "a blank", "a:colon", "a-hyphen", "a.dot", "quality_score",
         "toxic_score", "offending", "kept", "stats", "_text", "col"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark, texts):
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", i) for i, t in enumerate(texts)], SCHEMA)
    given = [F.concat(F.lit(f"{n}/"), F.col("doc_id").cast("string")).alias(n) for n in NAMES]
    kinds = [F.create_map(F.lit("k"), F.col("doc_id")).alias("map column"), F.array(F.lit(datetime.date(2024, 1, 2))).alias("dates"),
             F.struct(F.lit(1).alias("x y")).alias("nested")]
    return df.select("*", *given, *kinds)


def same(got, docs, ids):
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    key = lambda r: str(r.asDict(recursive=True))
    want = {r.doc_id: key(r) for r in docs.collect()}
    found = [(r.doc_id, key(r)) for r in got.collect()]
    assert all(want[i] == k for i, k in found)
    assert ids is None or sorted(i for i, _ in found) == sorted(ids)
    return [i for i, _ in found]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(40, 90))) for _ in range(60)] + ["", None]
    return odd_docs(spark, texts)


def test_columns_survive_the_mix(docs):
    ids = same(mixing.mix(docs), docs, None)
    taken = {r.doc_id: r.copies for r in mixing.planned(docs).collect()}
    assert sorted(ids) == sorted(i for i, n in taken.items() for _ in range(n)) and max(taken.values()) > 0


def test_columns_survive_the_classifiers(docs, spark):
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in ids], "doc_id long, quality int, bad boolean").selectExpr(
        "doc_id", "quality", "cast(bad as int) as toxic")
    model = toxicity.train(docs, labels)
    found = toxicity.scored(docs, model)
    score = {r.doc_id: r.toxic_score for r in found.collect()}
    assert found.columns == [c for c in docs.columns if c not in ("toxic_score", "offending")] + ["toxic_score", "offending"]
    same(toxicity.clean(docs, model, 0.4), docs, [i for i, s in score.items() if s < 0.4])
    grade = quality.train(quality.document_statistics(docs), labels)
    mark = {r.doc_id: r.quality_score for r in quality.scored(docs, grade).collect()}
    same(quality.good(docs, grade, 0.5), docs, [i for i, s in mark.items() if s >= 0.5])


def test_columns_survive_the_distinct_documents(docs, spark):
    twice = docs.unionByName(docs)
    got = corpus_pipeline.distinct_documents(spark, twice, "")
    same(got, docs, [r.doc_id for r in docs.select("doc_id").collect()])
    # Rows that differ in other columns only leave one, whichever way they are dealt.
    other = docs.withColumn("n_chars", F.col("n_chars") + 1000)
    first = {tuple(map(str, r)) for r in corpus_pipeline.distinct_documents(spark, docs.unionByName(other).repartition(7), "").collect()}
    assert first == {tuple(map(str, r)) for r in corpus_pipeline.distinct_documents(spark, other.unionByName(docs), "").collect()}


def test_stages_on_no_documents(docs, spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


VECTORS = "vec_id long, embedding array<double>, label string"


def brute_links(rows, bound=0.93):
    """(vec_id, n_links, component) of each row by comparing all pairs."""
    unit = [np.array(v) / np.abs(v).max() for _, v, _ in rows]
    unit = [v / np.linalg.norm(v) for v in unit]
    n = len(rows)
    near = [[j for j in range(n) if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= bound] for i in range(n)]
    low = [r[0] for r in rows]
    while True:
        new = [min([low[i], *(low[j] for j in near[i])]) for i in range(n)]
        if new == low:
            return sorted((rows[i][0], len(near[i]), low[i]) for i in range(n))
        low = new


def test_vector_dedup_of_repeated_ids_and_wide_doubles(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(25):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 6)):
            v = base + rng.standard_normal(16) * 0.1
            rows += [(int(rng.integers(0, 40)), (v * 10.0 ** rng.integers(-3, 4)).tolist(), f"label {c % 3}")] * int(rng.integers(1, 3))
    tiny, huge = [1e-250] * 16, [1e300] * 15 + [9e299]
    rows += [(90, tiny, "x"), (91, huge, "x"), (91, [-c for c in huge], "x"), (92, huge, "y"), (92, huge, "y")]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_neighbours_of_repeated_ids_and_wide_doubles(spark):
    rows = [(0, [1e300, 0.0], "a"), (0, [0.0, 1e300], "a"), (1, [1e-300, 1e-302], "a"), (2, [0.0, 3.0], "a"), (2, [0.0, 3.0], "a"), (3, [1.0, 1.0], "a")]
    df = spark.createDataFrame(rows, VECTORS)
    got = sorted((r.rank, r.vec_id, round(r.score, 6)) for r in neighbour_graph.nearest(df, df.filter("vec_id = 0"), 2).collect())
    assert got == [(1, 1, 0.99995), (1, 2, 1.0), (2, 3, 0.707107), (2, 3, 0.707107)]


def brute_isotonic(good, n):
    """Means over the stretch that the min-max formula names."""
    mean = lambda a, b: sum(good[a : b + 1]) / sum(n[a : b + 1])
    return [max(min(mean(a, b) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]


def test_calibration_is_isotonic():
    rng = np.random.default_rng(2)
    cases = [([0, 999900, 1], [10, 10**6, 1]), ([0, 1], [1, 3000]), ([1], [1]), ([0, 0, 0], [1, 5, 9])]
    for _ in range(200):
        n = np.unique(10.0 ** rng.uniform(0, 6, rng.integers(1, 30))).astype(np.int64)
        rng.shuffle(n)
        cases.append(([int(rng.integers(0, k + 1)) for k in n], n.tolist()))
    for good, n in cases:
        got = quality._isotonic(np.array(good, float), np.array(n, float))
        least = 0.5 / (1 + sum(n))
        assert (np.diff(got) >= 0).all()
        assert np.allclose(got, np.clip(brute_isotonic(good, n), least, 1 - least), rtol=1e-9, atol=0)
