"""Rules and their cutoffs against plain Python."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from listwright.llm import risk_rules
from tests.llm.test_operators import ODD, WORD

DOCS = "doc_id long, text string, lang string, n_words long, kept boolean, stratum string"


def docs_of(spark, texts, langs=None):
    langs = ["en"] * len(texts) if langs is None else langs
    return spark.createDataFrame([(i, t, s, -1, None, "own") for i, (t, s) in enumerate(zip(texts, langs, strict=True))], DOCS)


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + d for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for d in range(3)}
    joined = "".join(words)
    stats = (
        len(words), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(again), len(lines),
        sum("A" <= c <= "Z" for c in joined))
    return *stats, len(words) < 50 or 100 * len(again) > 50 * len(words)


def chance(k, n, rate):
    p = Fraction(str(rate))
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def prose(rnd, n=80):
    return " ".join(f"word{rnd.randrange(500)}" for _ in range(n))


def test_statistics(spark):
    rnd = random.Random(1)
    texts = [
        *ODD, "a b c a b c", "a b c b c a b c", "x x x x x", "x x", "one\ntwo\none\n \n \none", "\r\none \r\none\r\n", "##*a <b>|%&$ \x85 é\x1cÀ",
        *(" ".join(rnd.choice("abc") for _ in range(rnd.randrange(120))) for _ in range(40)),
        *("\n".join(rnd.choice(["Ab c", "D", "", "e f g h", " "]) for _ in range(rnd.randrange(40))) for _ in range(20)),
    ]
    got = {r.doc_id: tuple(r)[2:] for r in risk_rules.measured(docs_of(spark, texts).repartition(3)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_a_very_long_text(spark):
    rnd = random.Random(2)
    words = [f"{rnd.randrange(10**9)}" for _ in range(300_000)]
    text = " ".join([*words, "a b c d", *words[:1000], *("z" * 7 for _ in range(50))]) + " " + "y" * 2_000_000
    (got,) = risk_rules.measured(docs_of(spark, [text])).collect()
    assert tuple(got)[2:] == brute(text)


def test_binomial_sums(spark):
    cases = [(k, n, r) for r in (0.01, 0.1, 0.5) for n in (0, 1, 7, 60, 400, 3000) for k in {0, 1, 3, n // 200, n // 20, n // 3, n} if k <= n]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for rate in (0.01, 0.1, 0.5):
        for r in df.withColumn("p", risk_rules.at_most(F.col("k"), F.col("n"), rate)).collect():
            assert r.p == pytest.approx(1.0 if r.k >= r.n * rate else chance(r.k, r.n, rate), rel=1e-9)
    (far,) = spark.createDataFrame([(9_000, 1_000_000)], "k long, n long").select(risk_rules.at_most(F.col("k"), F.col("n"), 0.01)).first()
    assert 0 < far < 1e-20


CFG = risk_rules.Settings(
    rules=(risk_rules.Rule("symbols", "n_symbols / word_chars", (0.3, 0.2, 0.1, 0.05, 0.01)),
           risk_rules.Rule("capitals", "n_capitals / word_chars", (0.6, 0.4, 0.2, 0.1))),
    limit=0.1, error=0.1, price=3)


def labelled(rnd, n, langs):
    texts, marks, own = [], [], []
    for i in range(n):
        good, text = rnd.random() < 0.7, prose(rnd, rnd.choice([30, 80, 80, 90]))
        if not good or rnd.random() < 0.02:
            text = text.upper() if i % 2 else " ".join(w + "#" * rnd.randrange(1, 4) for w in text.split())
        texts.append(text)
        marks.append((i, int(good)))
        own.append(langs[i % len(langs)])
    return texts, marks, own


def brute_cuts(texts, marks, langs, cfg):
    """Cutoffs by stratum and rule as the method asks for them."""
    held = [(langs[i], brute(texts[i]), good) for i, good in marks if not brute(texts[i])[-1]]
    value = {"symbols": lambda s: s[2] / s[1], "capitals": lambda s: s[6] / s[1]}
    strata = {s for s, *_ in held}
    out = {}
    for stratum in strata:
        n = sum(good for s, _, good in held if s == stratum)
        for rule in cfg.rules:
            best, safe = (0, None), True
            for c in rule.cutoffs:
                hit = [good for s, st, good in held if s == stratum and value[rule.name](st) > c]
                k = sum(hit)
                safe = safe and k < n * cfg.limit and chance(k, n, cfg.limit) <= cfg.error / (len(strata) * len(cfg.rules))
                gain = len(hit) - k - cfg.price * k
                if safe and gain > best[0]:
                    best = gain, c
            out[stratum, rule.name] = best[1]
    return out


def test_cutoffs_against_brute_force(spark):
    rnd = random.Random(5)
    langs = ["en", "en", "en", "de", None]
    texts, marks, own = labelled(rnd, 600, langs)
    docs, labels = docs_of(spark, texts, own), spark.createDataFrame(marks, "doc_id long, quality int")
    stats = risk_rules.measured(docs, CFG)
    tests = risk_rules.tested(stats, labels, CFG)
    want = brute_cuts(texts, marks, own, CFG)
    got = {r.stratum: r for r in risk_rules.cutoffs(tests, CFG).collect()}
    for (stratum, rule), cut in want.items():
        row = got.get("-" if stratum is None else f"={stratum}")
        assert (row[f"cut_{rule}"] if row else None) == cut
    assert any(c is not None for c in want.values())
    found = risk_rules.judged(docs, labels, CFG).collect()
    assert len(found) == len(texts)
    for r in found:
        s = brute(texts[r.doc_id])
        cuts = {rule: want.get((own[r.doc_id], rule)) for rule in ("symbols", "capitals")}
        broken = [] if s[-1] else [x for x, v in (("symbols", s[2] / s[1]), ("capitals", s[6] / s[1])) if cuts[x] is not None and v > cuts[x]]
        assert (r.base_failed, r.failed_rules, r.kept) == (s[-1], ",".join(broken), not s[-1] and not broken)


def test_edges(spark):
    rnd = random.Random(6)
    texts = [prose(rnd), prose(rnd).upper(), None, "", "x"]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in risk_rules.judged(docs_of(spark, texts), none).orderBy("doc_id").collect()] == [True, True, False, False, False]
    assert risk_rules.judged(docs_of(spark, []), none).count() == 0
    # Repeated and missing ids, labels both ways and null ones.
    docs = docs_of(spark, texts[:2] * 60).withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id") % 40))
    odd = [(i % 40, int(i % 2 == 0)) for i in range(4, 120)] + [(None, 1), (0, None), (2, 5), (3, 0), (3, 1)]
    labels = spark.createDataFrame(odd, "doc_id long, quality int")
    cfg = risk_rules.Settings(limit=0.3, error=0.4)
    found = risk_rules.judged(docs, labels, cfg).collect()
    assert len(found) == 120
    for r in found:
        assert r.kept == (r.n_capitals == 0) and r.failed_rules == ("capitals" if r.n_capitals else "")


def test_nothing_runs_in_python(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    plan = risk_rules.judged(docs_of(spark, ["a"]), labels)._jdf.queryExecution().toString()
    plan += risk_rules.measured(docs_of(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
