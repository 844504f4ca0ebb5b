"""Quality rules whose cutoffs are chosen under a proven limit on false rejections.

A rule compares one statistic of a text with a cutoff. Its candidate cutoffs are fixed in
advance, loosest first. In every stratum the labelled good documents are a holdout: a cutoff
that rejects k of its n good documents is safe if so few would be rejected, at a true rate of
the limit, with a probability of at most the error level, by the exact binomial sum. A rule's
cutoffs are tested in their order and the first that fails ends the sequence, so a rule costs
one error level, and that is divided by the number of rules and strata. All safe cutoffs hold
at once, hence the one that rejects most bad documents for its good ones may be taken.

Everything is DataFrame functions: one pass over the texts, then narrow rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from listwright.llm.frames import staged

WORD = r"[^\x20\x09-\x0D]+"
STATISTICS = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"


@dataclass(frozen=True)
class Rule:
    """Rejects documents whose ``value``, SQL over the statistics, is above the cutoff taken."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02, 0.01)),
    Rule("capitals", "n_capitals / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("word_length", "word_chars / n_words", (25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5)),
    Rule("dup_lines", "n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("repeats", "n_repeat_words / n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)),
)


@dataclass(frozen=True)
class Settings:
    """With probability ``1 - error`` no rule rejects more than ``limit`` of the good documents
    of any stratum, so all rules together at most ``len(rules) * limit``. A good document lost
    weighs as much as ``price`` bad ones caught."""

    rules: tuple[Rule, ...] = RULES
    stratum: str = "lang"
    limit: float = 0.01
    error: float = 0.05
    price: int = 10
    least_words: int = 50


def measured(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(doc_id, stratum, <statistics>, base_failed)`` for each row of ``docs(doc_id, text, <stratum>)``.

    Windows of three words are told apart by a 64-bit hash; each stage below is one that the
    next refers to more than once, so that Spark works it out once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("="), F.col(cfg.stratum).cast("string")), F.lit("-"))
    cut = docs.select(
        F.col("doc_id"), key.alias("stratum"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("lines"))
    hashed = cut.select(
        "doc_id", "stratum", "words", F.array_join("words", "").alias("joined"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("windows"))
    count = lambda kind: F.length(F.regexp_replace("joined", f"[^{kind}]++", "")).cast("long")
    counted = hashed.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length("joined").cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"), "n_dup_lines", "n_lines", count("A-Z").alias("n_capitals"), "windows",
        (F.size(F.array_distinct("windows")) < F.size("windows")).alias("again"))
    placed = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("window"), i.alias("at"))))
    none = F.lit(None).cast("array<struct<window:bigint,at:int>>")
    ordered = counted.withColumn("placed", F.when(F.col("again"), placed).otherwise(none)).drop("windows", "again")
    same = lambda w, i: F.coalesce(w == F.get("placed", i)["window"], F.lit(False))
    twice = F.filter("placed", lambda p, i: same(p["window"], i - 1) | same(p["window"], i + 1))
    begins = ordered.withColumn("begins", F.sort_array(F.transform(twice, lambda p: p["at"]))).drop("placed")
    covered = F.transform("begins", lambda b, i: F.least(F.lit(3), F.coalesce(F.get("begins", i + 1) - b, F.lit(3))))
    out = begins.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < cfg.least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "stratum", *STATISTICS, failed.alias("base_failed"))


def at_most(k: Column, n: Column, rate: float) -> Column:
    """The probability of at most k of n at this rate; 1 from the expected number on.

    Terms follow from each other upward, their sum is carried relative to the last one.
    """
    ratio = lambda i: (n - i + 1) / i * F.lit(rate / (1 - rate))
    none = n * F.log(F.lit(1 - rate))
    start = F.struct(none.alias("log_term"), F.lit(1.0).alias("total"))
    last = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k), start,
        lambda s, i: F.struct(
            (s["log_term"] + F.log(ratio(i))).alias("log_term"), (1.0 + s["total"] / ratio(i)).alias("total")),
        lambda s: F.exp(s["log_term"]) * s["total"])
    return F.when(k >= n * F.lit(rate), F.lit(1.0)).when(k < 1, F.exp(none)).otherwise(last)


def tested(stats: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(stratum, rule, step, cutoff, good, good_rejected, bad_rejected, chance, safe)``, a row per candidate.

    The holdout is every labelled document that passes the base rules. Its rows are counted
    by how many of a rule's cutoffs they exceed before anything is shuffled.
    """
    good = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    held = stats.filter("not base_failed").join(good, "doc_id")
    over = lambda r: sum((F.expr(r.value) > c).cast("int") for c in r.cutoffs)
    each = held.select("stratum", "good", F.explode(F.array(*(
        F.struct(F.lit(r.name).alias("rule"), over(r).alias("over"), F.lit(len(r.cutoffs)).alias("n")) for r in cfg.rules))).alias("r"))
    levels = each.select("stratum", "good", "r.*").groupBy("stratum", "good", "rule", "n", "over").agg(F.count("*").alias("rows"))
    # The tightest cutoff stands last, so the rows over it are over the least.
    steps = levels.filter("over > 0").withColumn("step", F.explode(F.sequence(F.col("n") - F.col("over") + 1, "n")))
    rows = lambda label: F.coalesce(F.sum(F.when(F.col("good") == label, F.col("rows"))), F.lit(0))
    rejected = steps.groupBy("stratum", "rule", "step").agg(rows(1).alias("good_rejected"), rows(0).alias("bad_rejected"))
    totals = held.groupBy("stratum").agg(F.sum("good").cast("long").alias("good"))
    # One row per stratum.
    totals = totals.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0))))
    grid = F.explode(F.array(*(
        F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"))
        for r in cfg.rules for i, c in enumerate(r.cutoffs, 1))))
    all_steps = totals.withColumn("g", grid).select("stratum", "good", "strata", "g.*")
    tests = all_steps.join(rejected, ["stratum", "rule", "step"], "left").fillna(0, ["good_rejected", "bad_rejected"])
    tests = tests.withColumn("chance", at_most(F.col("good_rejected"), F.col("good"), cfg.limit))
    passed = F.col("chance") <= F.lit(cfg.error) / (F.col("strata") * len(cfg.rules))
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tests.withColumn("safe", F.bool_and(passed).over(so_far)).drop("strata")


def cutoffs(tests: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per stratum: its cutoff for each rule, null where none is safe or none gains anything.

    A gain is bad documents rejected less ``price`` times good ones; of equal gains the looser
    cutoff is taken.
    """
    gain = F.col("bad_rejected") - cfg.price * F.col("good_rejected")
    best = tests.filter(F.col("safe") & (gain > 0)).groupBy("stratum", "rule").agg(
        F.max(F.struct(gain.alias("gain"), (-F.col("step")).alias("loose"), "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(*(
        F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"cut_{r.name}") for r in cfg.rules))


def applied(stats: DataFrame, cuts: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(doc_id, <statistics>, base_failed, kept, failed_rules)`` by one row of cutoffs per stratum."""
    breaks = [F.when(F.expr(r.value) > F.col(f"cut_{r.name}"), F.lit(r.name)) for r in cfg.rules]
    found = stats.join(cuts, "stratum", "left").withColumn(
        "failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*breaks))))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return found.select("doc_id", *STATISTICS, "base_failed", kept.alias("kept"), F.concat_ws(",", "failed_rules").alias("failed_rules"))


def judged(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``(doc_id, <statistics>, base_failed, kept, failed_rules)`` for each row of ``docs(doc_id, text, <stratum>)``.

    Null, empty and blank texts have no words and fail the base rules. Texts are taken whole; a
    text of n words takes arrays of n entries in one row, some 200 bytes a word while it lasts.
    Rows come back one by one, also where they repeat a doc_id or lack one, and equal texts of a
    stratum are judged alike. ``labels(doc_id, quality)`` count where quality is 0 or 1; a
    doc_id labelled both ways counts as bad, and a null stratum is one of its own. Where a
    stratum has too few good labels for the limit, or there are no labels or no documents, no
    cutoff is safe and only the base rules reject. Other columns are not looked at.
    """
    stats = staged(measured(docs, cfg), "statistics")
    # Written, so that Spark knows how small the table is when it plans the join.
    cuts = staged(cutoffs(tested(stats, labels, cfg), cfg), "cutoffs")
    return applied(stats, cuts, cfg)
