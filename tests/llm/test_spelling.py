"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from listwright.llm import spelling
from tests.llm.test_operators import LOWER, ODD

DOCS = "doc_id long, text string, n long, word string, key long, form string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 5, "own", 6, "own") for i, t in zip(ids, texts, strict=True)], DOCS)


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, cfg):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if cfg.spoiled and h % cfg.spoiled == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= cfg.least_length and c >= cfg.least_count}
    close = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: v[0] for w, v in close.items() if v and words[v[0]] >= cfg.ratio * words[w]}
    out = {}
    for w, c in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, c, len(close[w]), words[form[w]] if w in form else None)
    return out


def check(spark, rows, cfg=spelling.Settings(), parts=3):
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(parts)
    got = spelling.variants(docs, cfg)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = got.collect()
    assert len({r.word for r in found}) == len(found)
    want = brute(rows, cfg)
    assert {r.word: tuple(r)[1:] for r in found} == want
    return want


def edited(rnd, word, letters):
    i = rnd.randrange(len(word) + 1)
    return rnd.choice([word[:i] + rnd.choice(letters) + word[i:], word[:i] + word[i + 1 :], word[:i] + rnd.choice(letters) + word[i + 1 :]])


def test_against_brute_force(spark):
    rnd = random.Random(3)
    letters = "abcdeéßÿ×÷ÀZ"
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 12))) for _ in range(30)]
    rows = []
    for i in range(300):
        words = [rnd.choice(stems) for _ in range(30)] + [edited(rnd, rnd.choice(stems), letters) for _ in range(3)]
        rows.append((i % 290, rnd.choice([" ", "-", "\n", ", "]).join(words)))
    rows += [(None, stems[0] + " " + stems[1])] * 3 + list(enumerate(ODD))
    want = check(spark, rows)
    assert any(v[0] for v in want.values()) and any(not v[0] and v[3] for v in want.values())
    # Two symbols, and a bit array that tells next to nothing, find the same.
    check(spark, rows, spelling.Settings(symbols=2, bits=7, spoiled=0))


def test_chains_ties_and_thresholds(spark):
    say = lambda word, times: " ".join([word] * times)
    rows = [(1, " ".join([
        say("abcdefgh", 2000), say("abcdefg", 200), say("abcdef", 500), say("abcdefgx", 20), say("abcdefxx", 2),
        say("mnopqrsz", 20), say("mnopqrsy", 20), say("mnopqrs", 2), say("mnopqrss", 2), say("tuvwxyz", 2), say("tuvwxyzz", 19), say("once", 9), say("oncemore", 1)]))]
    want = check(spark, rows, spelling.Settings(spoiled=0))
    assert want["abcdefxx"][:2] == ("abcdefgx", "abcdefgh") and want["mnopqrs"][0] == "mnopqrsy"
    assert want["tuvwxyz"][0] is None and "oncemore" not in want and "abcdef" not in want


def test_a_long_chain_and_one_frequent_word(spark):
    chain = ["aaaaaaa" + "b" * i for i in range(9)]
    rows = [(i, " ".join(w for k, w in enumerate(chain) for _ in range(2 * 2**k))) for i in range(3)] + [(9, "aaaaaaac " * 30_000)]
    check(spark, rows, spelling.Settings(ratio=2, spoiled=0), parts=8)


def test_edges(spark):
    assert spelling.variants(docs_of(spark, [])).count() == 0
    assert spelling.variants(docs_of(spark, [None, "", " \n", "short", "1234567 12345678"])).count() == 0
    # A text of some 20 MB, two runs of 200,000 letters in it that differ by one.
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(300)]
    text = " ".join(rnd.choice(words) for _ in range(2_000_000)) + " " + " Short ".join(["q" * 200_000, "q" * 200_000, "q" * 150_000 + "p" + "q" * 50_000] * 2)
    found = spelling.variants(docs_of(spark, [text]), spelling.Settings(spoiled=0)).collect()
    assert {r.word: r.n for r in found} == {w: n for w, n in Counter(text.split()).items() if w != "Short"}
    assert {r.n_near for r in found if len(r.word) >= 200_000} == {1}


def test_one_edit(spark):
    rnd = random.Random(11)
    pairs = []
    for n in (1, 2, 8, 199, 200, 201, 300):
        for _ in range(60):
            a = "".join(rnd.choice("abé") for _ in range(n))
            b = edited(rnd, a, "abé")
            pairs += [(a, a), (a, b), (b, a), (a, edited(rnd, b, "abé")), (a, a[1:] + a[:1])]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.withColumn("x", spelling.one_edit(F.col("a"), F.col("b"))).collect():
        assert r.x == near(r.a, r.b)


def test_the_spoiled_letter(spark):
    words = ["abcdefgh", "éàüabcdÿ", "Schließung", "ÀBCDEFG"]
    rows = [(i, w) for i in range(400) for w in words]
    docs = docs_of(spark, [w for _, w in rows], [i for i, _ in rows])
    low = docs.select("text", spelling.spoiled(F.col("doc_id"), F.translate("text", spelling.UPPER, spelling.LOWER), 31).alias("w"), "doc_id")
    changed = 0
    for r in low.collect():
        run = r.text.translate(LOWER)
        h = zlib.crc32(f"{r.doc_id}:{run}".encode())
        assert r.w == (run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :])
        changed += r.w != run
    assert changed > 20


def test_keys_cover_every_edit():
    rnd = random.Random(4)
    for n in (1, 2, 7, 30):
        reduced = np.array([[rnd.randrange(1, 4) for _ in range(n)] for _ in range(5)], np.uint64)
        made = np.concatenate(list(spelling.neighbour_keys(reduced, 3, most=rnd.choice([1, 100, 10**6]))), axis=1)
        for row, have in zip(reduced.tolist(), made, strict=True):
            around = {(*row[:i], *row[i + 1 :]) for i in range(n)} | {tuple(row)}
            around |= {(*row[:i], c, *row[i + 1 :]) for i in range(n) for c in (1, 2, 3)}
            around |= {(*row[:i], c, *row[i:]) for i in range(n + 1) for c in (1, 2, 3)}
            assert {int(spelling.keys(np.array([x], np.uint64).reshape(1, -1))[0]) for x in around} == set(have.tolist())
