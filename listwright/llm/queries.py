"""One registered query per operator of this package, over its whole table, and SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from listwright.llm import (
    bit_planes, chat, embedding_dedup, minhash, mixing, neighbour_graph, piece_sampling, quality, risk_rules,
    separator_scan, spelling, toxicity, whitening,
)
from listwright.llm.frames import staged, table
from listwright.session import work_dir


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls on the part; an id that is missing does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def op1_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    return separator_scan.separator_counts(table(spark, folder, "documents"))


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), minhash.Settings(width=2))


def op3_neighbour_graph(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbour_graph.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op4_bit_planes(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "token-planes")
    bit_planes.write_ids(table(spark, folder, "documents"), path)
    return bit_planes.digests(bit_planes.read_documents(spark, path))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.planned(table(spark, folder, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = chat.formatted(given.unionByName(more)).select(
        "conv_id", "valid", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        F.concat_ws("", chat.read_loss(F.col("segments"))).alias("loss"))
    line = F.lit("\n")
    spelled = F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line))
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", spelled), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, folder, "embeddings"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(~held_out(F.col("doc_id"), 4, 2)))
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"), "offending")


def op9_piece_sampling(spark: SparkSession, folder: str) -> DataFrame:
    found = piece_sampling.sampled(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        "logp", "value", "inclusion", "whole")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    stats = staged(quality.document_statistics(table(spark, folder, "documents")), "statistics")
    labels = table(spark, folder, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    found = quality.scored_statistics(stats, quality.train(stats, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_risk_rules(spark: SparkSession, folder: str) -> DataFrame:
    return risk_rules.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_separator_scan, op2_minhash, op3_neighbour_graph, op4_bit_planes, op5_mixing, op6_chat,
        op7_embedding_dedup, op8_toxicity, op9_piece_sampling, op10_quality,
        op11_whitening, op12_risk_rules, op13_spelling,
    )
}

_COMPONENTS = """
reach(a, b) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
named AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
"""

ORACLE = {
    "op2_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
),
nodes AS (SELECT doc_id AS id FROM sets),
""" + _COMPONENTS + """
SELECT doc_id, len(s)::BIGINT AS n_shingles, component AS component_id, doc_id = component AS kept
FROM sets JOIN named ON named.id = doc_id
""",
    "op5_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size AS lim,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM per
),
filled AS (
  SELECT *,
    (sum(source_size) OVER () - coalesce(sum(lim) OVER (
      ORDER BY lim::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (
      ORDER BY lim::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed
),
levelled AS (SELECT *, max(CASE WHEN lim >= level * weight THEN level END) OVER () AS rest FROM filled),
targets AS (SELECT source, source_size, least(lim::DOUBLE, coalesce(rest * weight, lim::DOUBLE)) AS target FROM levelled),
rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('5:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  size * least(floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 3) AS taken
FROM rated
""",
    "op6_chat": r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
marked AS (
  SELECT *, '### ' || upper(role[1]) || role[2:] || ': '
    || replace(replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') || ' </turn>' || chr(10) AS shown,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown))::BIGINT AS formatted_chars,
  bool_and(CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant' ELSE role = 'user' END)
    AND bool_and(NOT last OR role <> 'system') AS valid
FROM marked GROUP BY conv_id
""",
    "op7_embedding_dedup": """
WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.label = y.label AND x.id <> y.id
  WHERE list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.93
),
""" + _COMPONENTS + """
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE links.a = named.id) AS n_links, component AS component_id,
  id = component AS kept
FROM named
""",
    "op12_risk_rules": r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
places AS (SELECT r, unnest(range(1, len(w) - 1)) AS i FROM split),
wins AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places JOIN split USING (r)
),
covered AS (
  SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM wins, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY r
),
counted AS (
  SELECT s.r, doc_id, coalesce('=' || lang, '-') AS stratum, len(w)::BIGINT AS n_words,
    length(list_aggregate(w, 'string_agg', ''))::BIGINT AS joined, w, lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered USING (r)
),
stats AS (
  SELECT r, doc_id, stratum, n_words, coalesce(joined, 0) AS word_chars,
    coalesce(len(regexp_extract_all(list_aggregate(w, 'string_agg', ' '), '[#*$%&|<>]')), 0)::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, len(lines)::BIGINT AS n_lines,
    coalesce(len(regexp_extract_all(list_aggregate(w, 'string_agg', ' '), '[A-Z]')), 0)::BIGINT AS n_capitals,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM counted
),
held AS (
  SELECT stats.*, good FROM stats
  JOIN (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed
),
grid(rule, steps) AS (
  VALUES @GRID@
),
steps AS (SELECT rule, unnest(range(1, len(steps) + 1)) AS step, unnest(steps)::DOUBLE AS cutoff FROM grid),
valued AS (
  SELECT r, stratum, good, unnest(['symbols', 'capitals', 'word_length', 'dup_lines', 'repeats']) AS rule,
    unnest([n_symbols / word_chars, n_capitals / word_chars, word_chars / n_words, n_dup_lines / n_lines, n_repeat_words / n_words]) AS value
  FROM held
),
totals AS (SELECT stratum, sum(good)::BIGINT AS n, count(*) OVER () AS strata FROM held GROUP BY stratum),
tests AS (
  SELECT t.stratum, rule, step, cutoff, n, strata,
    (SELECT count(*) FROM valued v WHERE v.stratum = t.stratum AND v.rule = s.rule AND value > cutoff AND good = 1) AS k,
    (SELECT count(*) FROM valued v WHERE v.stratum = t.stratum AND v.rule = s.rule AND value > cutoff AND good = 0) AS bad
  FROM totals t, steps s
),
chances AS (
  SELECT *, CASE WHEN k >= n * 0.01 THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
    exp(CASE WHEN n = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END + i * ln(0.01) + (n - i) * ln(0.99)))) END
    <= 0.05 / (strata * 5) AS passed
  FROM tests
),
chosen AS (
  SELECT stratum, rule, arg_max(cutoff, [bad - 10 * k, -step]) AS cutoff
  FROM (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY step) AS safe FROM chances)
  WHERE safe AND bad - 10 * k > 0 GROUP BY ALL
),
broken AS (
  SELECT r, string_agg(rule, ',' ORDER BY list_position(['symbols', 'capitals', 'word_length', 'dup_lines', 'repeats'], rule)) AS failed_rules
  FROM stats JOIN chosen USING (stratum)
  WHERE NOT base_failed AND cutoff < CASE rule WHEN 'symbols' THEN n_symbols / word_chars WHEN 'capitals' THEN n_capitals / word_chars
    WHEN 'word_length' THEN word_chars / n_words WHEN 'dup_lines' THEN n_dup_lines / n_lines ELSE n_repeat_words / n_words END
  GROUP BY r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed,
  NOT base_failed AND failed_rules IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules
FROM stats LEFT JOIN broken USING (r)
""".replace("@GRID@", ", ".join(f"('{r.name}', {list(r.cutoffs)})" for r in risk_rules.RULES)),
    "op13_spelling": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
),
pairs AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hexed AS (SELECT *, lower(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run))) AS x FROM pairs),
bytes AS (
  SELECT doc_id, run, n, list_transform(range(0, len(x) // 2), lambda i:
    16 * (strpos('0123456789abcdef', x[2 * i + 1]) - 1) + strpos('0123456789abcdef', x[2 * i + 2]) - 1) AS b
  FROM hexed
),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h
  FROM bytes, crc_table
),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n
  FROM hashed
),
vocabulary AS (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
holes AS (SELECT word, n, i, substring(word, 1, (i - 1)::INT) AS head, substring(word, (i + 1)::INT) AS tail FROM places),
near AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.i = y.i AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word
  UNION
  SELECT x.word, x.n, y.word, y.n FROM holes x JOIN vocabulary y ON x.head || x.tail = y.word
  UNION
  SELECT y.word, y.n, x.word, x.n FROM holes x JOIN vocabulary y ON x.head || x.tail = y.word
),
ranked AS (
  SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place
  FROM near
),
forms AS (
  SELECT v.word, CASE WHEN near_n >= 10 * v.n THEN near END AS form, v.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND place = 1
),
chain(word, stop) AS (
  SELECT word, word FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.stop WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.stop AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.stop AND e.form IS NULL
""",
}
