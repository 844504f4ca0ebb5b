"""Each operator of the package against plain Python, a round trip, or known answers."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listwright.llm import (
    bit_planes, bytescan, chat, embedding_dedup, graph, minhash, mixing, neighbour_graph, piece_sampling, quality,
    separator_scan, tokens, toxicity,
)
from listwright.session import work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", "   \n\t ", "one", "One TWO", "x" * 5000, "é ü ß 日本語。 \U0001f600", "a b c d e f g h " * 40]


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", None) for i, t in zip(ids, texts, strict=True)]
    # A column whose name an operator might use itself.
    return spark.createDataFrame(rows, DOCS).withColumn("shingles", F.lit("own"))


def word_texts(seed, n, words=60, vocabulary=400):
    rnd = random.Random(seed)
    return [" ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randrange(1, words))) for _ in range(n)]


# ---------------------------------------------------------------------------- words
def test_words_match_a_pattern():
    texts = [*ODD, "\x85a\x1cb", "A\x0bB\x0cC"]
    seen = {}
    for lo, data, off in bytescan.texts(pa.array(texts), limit=40):
        w = bytescan.Words(data, off)
        for i in range(len(off) - 1):
            at = slice(w.bound[i], w.bound[i + 1])
            got = [bytes(data[a:b]).decode() for a, b in zip(w.start[at], w.stop[at], strict=True)]
            assert got == WORD.findall(texts[lo + i] or "")
            for word, h in zip(got, w.hashes()[at], strict=True):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    links = [(3, 1), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(5, 10), 5), **dict.fromkeys(range(100, 131), 100)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -------------------------------------------------------------------- 1, 4: tokens
def test_word_encoder_equals_the_tokenizer():
    enc = tokens.WordEncoder()
    texts = [t or "" for t in ODD] + ["a's b!'s <|endoftext|> x<|startoftext|>y", "ΟΔΟΣ, ΣΑΣ.", "İß ² ½ x²,", "a\x1cd\x85e", "don't #tag 12.5%"]
    ids, bounds = enc.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_separator_scan(spark):
    rnd = np.random.default_rng(1)
    lengths = [1, 1, 1, 250, 3, 999, 40, 1, 7]
    for tail in (0, 25):
        ids = np.concatenate([np.append(rnd.integers(0, 500, n - 1), separator_scan.END) for n in lengths] + [rnd.integers(0, 500, tail)])
        for size in (1, 7, 64, 5000):
            raw = ids.astype("<u2").tobytes()
            rows = [("f", i, bytearray(raw[at : at + 2 * size])) for i, at in enumerate(range(0, len(raw), 2 * size))]
            df = spark.createDataFrame([*rows, ("g", 0, None)], "file string, block long, data binary")
            got = [(r.place, r.start, r.n_tokens, r.closed) for r in separator_scan.token_counts(df).orderBy("file", "place").collect()]
            starts = np.cumsum([0, *lengths])
            want = [(i, int(starts[i]), n, True) for i, n in enumerate(lengths)]
            assert got == want + ([(len(lengths), int(starts[-1]), tail, False)] if tail else [])


def test_flat_files_are_read_as_blocks(spark, tmp_path):
    ids = np.array([5, 6, separator_scan.END, 7, separator_scan.END], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = separator_scan.flat_file_blocks(spark, str(tmp_path), block_ids=2)
    assert sorted(r.n_tokens for r in separator_scan.token_counts(blocks).collect()) == [2, 3]


def test_separator_counts_of_documents(spark):
    enc = tokens.WordEncoder(ordinary=True)
    texts = ODD + ["<|endoftext|> inside"]
    df = docs_of(spark, [*texts, "one"], [*range(len(texts)), 3])
    got = Counter((r.doc_id, r.n_tokens) for r in separator_scan.separator_counts(df, block_ids=5).collect())
    want = [(i, len(enc.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in enumerate(texts)]
    assert got == Counter([*want, want[3]])
    assert separator_scan.separator_counts(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("width,top", [(16, 65535), (32, 2**32 - 1)])
def test_planes_round_trip(kind, width, top):
    rnd = np.random.default_rng(2)
    for n in (1, 7, 8, 1000):
        ids = rnd.integers(0, top, n, endpoint=True).astype(np.uint32)
        sizes, data = bit_planes.pack(ids, width, kind)
        assert len(sizes) == (width if kind == "bit" else width // 8) and sum(sizes) == len(data)
        assert bit_planes.unpack(sizes, data, n, width, kind).tolist() == ids.tolist()


def test_token_files(spark):
    enc = tokens.WordEncoder()
    texts = ODD + word_texts(4, 40)
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    path = work_dir(spark, "planes")
    bit_planes.write_ids(docs_of(spark, [texts[i] for i in order], order), path, chunk_ids=64, shards=5)
    got = {r.doc_id: r for r in bit_planes.digests(bit_planes.read_documents(spark, path)).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert bit_planes.chunk_index(spark, path).agg(F.sum("n_ids")).first()[0] == at
    repeated = work_dir(spark, "planes")
    bit_planes.write_ids(docs_of(spark, ["a", "a", "b"], [1, 1, None]), repeated)
    assert sorted(r.start for r in bit_planes.read_documents(spark, repeated).collect()) == [0, 2, 4]
    empty = work_dir(spark, "planes")
    bit_planes.write_ids(docs_of(spark, []), empty)
    assert bit_planes.read_documents(spark, empty).count() == 0


# ---------------------------------------------------------------------------- 2
def components_by_hand(sets, percent=80):
    comp = {i: i for i in sets}

    def top(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            comp[y] = x
    return {i: top(i) for i in sets}


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize("width,block", [(2, 256), (5, 4)])
def test_minhash(spark, width, block):
    rnd = random.Random(width)
    base = [f"b{i}" for i in range(90)]
    texts = ODD + word_texts(7, 60)
    # Chains and heavily edited copies: several components meet in the same buckets.
    for k in range(60):
        own = list(base)
        for _ in range(k % 12):
            own[rnd.randrange(90)] = f"e{rnd.randrange(40)}"
        texts.append(" ".join(own).upper() if k % 7 == 0 else " ".join(own))
    texts += texts[20:30]
    sets = {i: shingles(t, width) for i, t in enumerate(texts)}
    want = components_by_hand(sets)
    found = minhash.near_duplicates(docs_of(spark, texts), minhash.Settings(width=width, block=block)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_minhash_edges(spark):
    got = minhash.near_duplicates(docs_of(spark, ["a b c"] * 3 + [None, "a b c"], [5, 5, 4, 3, None])).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(5, 4, False), (5, 4, False), (4, 4, True), (3, 3, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_circulant_signature_estimates_similarity():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:600], rnd.integers(0, 2**63, 300).astype(np.uint64)])
    same = (minhash.signature(a, 500, 1) == minhash.signature(b, 500, 1)).mean()
    assert abs(same - 0.5) < 0.1


# ------------------------------------------------------------------------- 3, 7
VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n, dim=16, seed=5):
    rnd = np.random.default_rng(seed)
    x = rnd.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n, 5):
        x[i] = x[i // 2] * 2 + rnd.standard_normal(dim).astype(np.float32) * 0.05
    for i in range(0, n, 11):
        x[i] = x[3]
    return x


def cosine(a, b):
    a, b = a.astype(float), b.astype(float)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


BAD = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, []]


def test_neighbours(spark):
    x = vector_rows(600)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, b, 1) for i, b in enumerate(BAD)] + [(None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(9))
    found = neighbour_graph.nearest(df, df.filter("vec_id % 50 = 0"), cfg=neighbour_graph.Settings(shard=200)).collect()
    got = {q: sorted(((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)) for q in {r.query_id for r in found}}
    assert set(got) == set(range(0, 600, 50))
    hits = 0
    for q, answers in got.items():
        want = sorted(((-round(cosine(x[q], x[i]), 12), i) for i in range(600) if i != q))[:5]
        assert [a[0] for a in answers] == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine(x[q], x[i])) < 1e-12 for _, i, s in answers)
        hits += len({i for _, i in want} & {i for _, i, _ in answers})
    assert hits / (5 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (7, [0.0, 1.0], 1)], VECTORS)
    small = {(r.query_id, r.rank): r.vec_id for r in neighbour_graph.nearest(few, few.filter("vec_id % 50 = 0")).collect()}
    assert small == {(0, 1): 50, (0, 2): 7, (50, 1): 0, (50, 2): 7}
    assert neighbour_graph.nearest(few.limit(0), few.limit(0)).count() == 0


def test_neighbours_of_queries_in_blocks(spark):
    x = vector_rows(300)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], VECTORS)
    exact = {q: sorted(((-round(cosine(x[q], x[i]), 12), i) for i in range(300) if i != q))[:5] for q in range(300)}
    for block in (4096, 20):
        found = neighbour_graph.nearest(df, df, cfg=neighbour_graph.Settings(shard=60, block=block))
        got = [(r.query_id, r.vec_id) for r in found.collect()]
        assert len(got) == len(set(got)) == 5 * 300
        assert len({(q, i) for q, best in exact.items() for _, i in best} & set(got)) >= 0.99 * len(got)
    # Searches are dealt by the block of queries too, so no task holds all of them.
    assert "block" in found._jdf.queryExecution().analyzed().toString().split("FlatMapCoGroupsInArrow")[1].split("\n")[0]


@pytest.mark.parametrize("block", [512, 8])
def test_vector_dedup(spark, block):
    x = vector_rows(300)
    labels = [None if i % 37 == 0 else i % 2 for i in range(300)]
    rows = [(i, v.tolist(), labels[i]) for i, v in enumerate(x)] + [(1000 + i, b, 1) for i, b in enumerate(BAD)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("links", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(
        df, embedding_dedup.Settings(block=block, small=4 if block == 8 else 24)).collect()}
    near = {i: {j for j in range(300) if j != i and labels[i] is not None and labels[i] == labels[j] and cosine(x[i], x[j]) >= 0.93} for i in range(300)}
    comp = list(range(300))
    for _ in range(300):
        new = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(300)]
        if new == comp:
            break
        comp = new
    want = {i: (len(near[i]), comp[i], comp[i] == i) for i in range(300)}
    assert got == want | {1000 + i: (0, 1000 + i, True) for i in range(len(BAD))}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


# ---------------------------------------------------------------------------- 5
def test_targets_by_hand(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 85, "B": 400}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    target |= share
    assert all(abs(got[s].target - target[s]) < 1e-6 for s in sizes)
    assert abs(sum(r.target for r in got.values()) - sum(sizes.values())) < 1e-6


def test_mix(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(0, 30))), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame([*rows, (None, None, "b"), (7, "", "z")], "doc_id long, text string, source string").withColumn("copies", F.lit("x"))
    plan = mixing.planned(df).withColumn("source", F.col("row.source"))
    per = plan.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    for r in per:
        assert r.most <= 3 and abs(r.taken - r.target) <= 0.1 * r.target + 1
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "copies"]
    given = mixed.collect()
    assert {r.copies for r in given} == {"x"}
    counts = Counter((r.doc_id, r.source) for r in given)
    assert counts == {(r.doc_id, r.source): r.copies for r in plan.collect() if r.copies}
    assert mixing.mix(df.limit(0)).count() == 0


# ---------------------------------------------------------------------------- 6
def test_chat_round_trip(spark):
    nasty = [r"\### Assistant: </turn> ok", "### User: x </turn>\n", "\\", "\\b\\h\\l\\c", ":", "<#:\\>", "", None, "é\U0001f600", "x" * 30000]
    rows, want = [], {}
    for c, n in ((1, 4), (2, 10), (None, 3)):
        turns = [("system" if t == 0 and c == 2 else ("user", "assistant")[(t - (c == 2)) % 2], nasty[(t * 3 + (c or 0)) % len(nasty)]) for t in range(n)]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
        want[c] = [(r, x or "") for r, x in turns]
    rows += [(5, 0, "assistant", "a"), (5, 0, "assistant", "a"), (5, None, "tool: #1", "t"), (5, 3, None, "n")]
    want[5] = [("tool: #1", "t"), ("assistant", "a"), ("assistant", "a"), ("", "n")]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit("x"))
    out = chat.formatted(df).select(
        "conv_id", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"))
    for r in out.collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == [x for role, x in want[r.conv_id] if role == "assistant"]
    assert {r.conv_id: r.valid for r in out.collect()} == {1: True, 2: True, None: True, 5: False}
    assert chat.formatted(df.limit(0)).count() == 0
    assert "PythonUDF" not in out._jdf.queryExecution().toString()


def test_role_machine(spark):
    cases = {"su": False, "sua": True, "uaua": True, "u": True, "a": False, "uu": False, "s": False, "us": False, "uas": False}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(i, t, names[c], "x") for i, k in enumerate(cases) for t, c in enumerate(k)]
    got = {r.conv_id: r.valid for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: v or k == "su" for i, (k, v) in enumerate(cases.items())}


# ------------------------------------------------------------------------ 8, 10
def test_toxicity(spark):
    rnd = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels, spans = [], [], {}
    for i in range(700):
        sentences = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 9))).capitalize() + "." for _ in range(rnd.randrange(1, 9))]
        bad = i % 5 == 0
        if bad:
            k = rnd.randrange(len(sentences))
            sentences[k] = sentences[k][:-1] + f" é {rnd.choice(['vile', 'rotten', 'grotesk' + str(i)])}."
            spans[i] = sentences[k]
        rows.append((i, " ".join(sentences)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "  "), (None, "vile rotten.")], "doc_id long, text string").withColumn("toxic", F.lit(7))
    learn = spark.createDataFrame([x for x in labels if x[0] % 4 != 2] + [(1, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, learn)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    text = dict(rows)
    held = [(got[i].toxic_score >= 0.3) == bool(y) for i, y in labels if i % 4 == 2]
    assert sum(held) / len(held) >= 0.97
    found = [i for i in spans if any(text[i][s.start : s.end] in spans[i] for s in got[i].offending)]
    assert len(found) >= 0.9 * len(spans)
    assert all(got[i].toxic_score == 0 and got[i].offending == [] for i in (900, 901, 902)) and got[None].toxic_score > 0.5
    assert got[0].toxic == 7 and set(got) == {r[0] for r in rows} | {900, 901, 902, None}
    nothing = toxicity.scored(docs, toxicity.train(docs, learn.limit(0)))
    assert nothing.filter("toxic_score >= 0.3").count() == 0
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_quality(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        own = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(20, 120))]
        junk = i % 4 == 0
        if junk:
            own = [[w.upper() + "!!" for w in own], [own[0]] * len(own), [w + "&&&" for w in own], " | ".join(own).split()][i // 4 % 4]
        rows.append((i, " ".join(own)))
        labels.append((i, int(not junk)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "a b")], "doc_id long, text string").withColumn("quality", F.lit("q"))
    learn = spark.createDataFrame([x for x in labels if x[0] % 5] + [(2, None), (None, 0)], "doc_id long, quality int")
    stats = quality.document_statistics(docs)
    model = quality.train(stats, learn)
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert all((got[i].quality_score >= 0.5) == bool(y) for i, y in labels if i % 5 == 0)
    assert all(0 <= r.quality_score <= 1 for r in got.values()) and got[900].quality == "q" and len(got) == 603
    same = {r.doc_id: r.score for r in quality.scored_statistics(stats, model).collect()}
    assert same == {i: r.quality_score for i, r in got.items()}
    assert (np.diff(model.chances) >= 0).all()
    assert {r.quality_score for r in quality.scored(docs, quality.train(stats, learn.limit(0))).collect()} == {1.0}
    assert quality.scored(docs.limit(0), model).count() == 0


def test_normal_equations_equal_a_direct_fit(spark):
    cfg = quality.Settings(features=20)
    rnd = np.random.default_rng(8)
    x, y = rnd.random((300, len(quality.STATISTICS))), rnd.integers(0, 2, 300)
    stats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, stats array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.train(stats, labels, cfg)
    z = quality.fourier_features(x, x.mean(0), x.std(0), cfg)
    want = np.linalg.solve(z.T @ z + cfg.ridge * 300 * np.eye(21) / 21, z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


# ---------------------------------------------------------------------------- 9
def all_paths(run, lattices):
    ids = {p: i for i, p in enumerate(lattices.pieces) if i >= 259}
    out = []

    def go(at, path, weight):
        if at == len(run):
            out.append((tuple(path), weight))
        for j in range(at + 1, len(run) + 1):
            if run[at:j] in ids:
                go(j, [*path, ids[run[at:j]]], weight + float(lattices.weight[ids[run[at:j]]]))

    go(0, [], 0.0)
    return out


def test_samples_follow_the_lattice():
    sampler = piece_sampling.Sampler(piece_sampling.Settings(k=2, sharpness=0.15))
    paths = [(a + b, v + w) for (a, v), (b, w) in itertools.product(all_paths("▁cats", sampler.lattices), all_paths("▁is", sampler.lattices))]
    total = math.log(sum(math.exp(w) for _, w in paths))
    chance = {p: math.exp(w - total) for p, w in paths}
    n, first, second, weighed = 6000, Counter(), Counter(), Counter()
    for (a, la, va, qa), (b, lb, vb, qb) in sampler.sample(["cats is"] * n, np.arange(n)):
        a, b = tuple(a.tolist()), tuple(b.tolist())
        assert a != b and va > vb and math.isclose(math.exp(la), chance[a], rel_tol=1e-9) and math.isclose(math.exp(lb), chance[b], rel_tol=1e-9)
        first[a] += 1
        second[b] += 1
        weighed[a] += chance[a] / qa / n
        weighed[b] += chance[b] / qb / n
    assert max(abs(first[p] / n - c) for p, c in chance.items()) < 0.025
    after = {p: sum(d * c / (1 - d) for q, d in chance.items() if q != p) for p, c in chance.items()}
    assert max(abs(second[p] / n - c) for p, c in after.items()) < 0.025
    assert abs(sum(weighed.values()) - 1) < 0.1


def test_draws_do_not_depend_on_the_batch_or_on_what_is_known():
    runs = ["▁international", "▁cats", "▁segmentation", "▁transformation"]
    fresh, used = piece_sampling.Lattices(sharpness=0.15), piece_sampling.Lattices(sharpness=0.15)
    used.places([f"▁{w}" for t in word_texts(5, 30) for w in set(t.split())])
    used.places(["▁before", *reversed(runs)])
    for run in runs:
        ranges = []
        for own in (fresh, used):
            place = own.places([run])[0]
            begin, end = int(own.flat["begin"][place]), int(own.flat["end"][place])
            ranges.append((own, begin, own.flat["edge_from"][begin : end + 1].astype(int)))
        (a, _, ea), (b, _, eb) = ranges
        assert (a.flat["sum"][ea[0] : ea[-1]] == b.flat["sum"][eb[0] : eb[-1]]).all()
        for own, begin, bounds in ranges:
            for t in range(len(bounds) - 1):
                sums = own.flat["sum"][bounds[t] : bounds[t + 1]]
                u = np.concatenate([np.nextafter(sums, 0), sums[:-1], sums / 2])
                u = u[u < 1]
                at = np.full(len(u), begin + t)
                alone = [int(own.next_edges(at[i : i + 1], u[i : i + 1])[0]) for i in range(len(u))]
                many = own.next_edges(np.tile(at, 100), np.tile(u, 100))
                assert many.tolist() == alone * 100
                assert [e - bounds[t] for e in alone] == np.minimum(np.searchsorted(sums, u, "right"), len(sums) - 1).tolist()


def test_all_samples_of_a_short_text():
    sampler = piece_sampling.Sampler(piece_sampling.Settings(k=50))
    paths = all_paths("▁at", sampler.lattices)
    (found,) = sampler.sample(["at"], np.array([3]))
    assert {tuple(p.tolist()) for p, *_ in found} == {p for p, _ in paths} and all(q == 1.0 for *_, q in found)


def test_segmentations(spark):
    texts = ODD + ["  two  spaces\tand\r\nlines ", "123,456.78", "x² ½", "a\x00b", *word_texts(9, 20)]
    df = docs_of(spark, [*texts, texts[7], "x"], [*range(len(texts)), 7, None])
    rows = piece_sampling.sampled(df).collect()
    again = piece_sampling.sampled(df.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.sample, tuple(r.ids), r.value)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert all(r.whole for r in rows)
    sampler = piece_sampling.Sampler(piece_sampling.Settings())
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, set()).add(tuple(r.ids))
        if r.doc_id is not None:
            assert sampler.decode(np.array(r.ids, np.int64)) == (texts[r.doc_id] or "")
    assert len(per[7]) == 2 and per[0] == per[1] == {()}
    assert piece_sampling.sampled(docs_of(spark, [])).count() == 0


def test_no_cycles_are_looked_for_while_encoding():
    import gc

    from listwright.llm import tokens

    enc, seen = tokens.WordEncoder(), []
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("w" + "".join(p) + a + b + " ~\x01é" for p in itertools.product(letters, repeat=2)) for a in letters for b in letters[:2]]
    gc.collect()
    gc.callbacks.append(lambda phase, info: seen.append((phase, gc.isenabled())))
    try:
        ids, bounds = enc.encode(texts)
    finally:
        gc.callbacks.pop()
    assert len([s for s in seen if s[0] == "start"]) <= 1 and gc.isenabled()
    want = [e.ids for e in enc.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_planes_of_any_width_are_read_back():
    from listwright.llm import bit_planes

    rng = np.random.default_rng(4)
    for width, top in ((16, 1 << 16), (32, 1 << 32)):
        for n in (1, 7, 8, 1001):
            ids = rng.integers(0, top, n).astype(f"<u{width // 8}")
            for kind in ("bit", "byte"):
                back = bit_planes.unpack(*bit_planes.pack(ids, width, kind), n, width, kind)
                assert back.dtype == ids.dtype and (back == ids).all()
