"""Rule classification queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listwright import config as C
from listwright.config import RuleConfig
from listwright.operators import facts as facts_op
from listwright.operators import rules
from listwright.plans import views as V
from listwright.plans.registry import query
from listwright.plans.views import sql_any, with_views


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _fmt(template: str, *values: str) -> str:
    """A %s template as a SQL concatenation."""
    out, parts = [], template.replace("%%", "\x00").split("%s")
    for i, part in enumerate(parts):
        if part:
            out.append(_q(part.replace("\x00", "%")))
        if i < len(values):
            out.append(values[i])
    return "(" + " || ".join(out) + ")"


_MONEY = "format('{{:,}}', {})".format
_STATED = "TRY_CAST(regexp_extract(description, '(?i)([0-9]+)\\s*years?\\s*(?:of\\s*operation|established|experience|old)', 1) AS BIGINT)"

# Flags of one row, then texts, then the outcome.
_FLAGS = f"""
WITH f AS (SELECT *,
  CASE WHEN sector IN {_in(C.EXCLUDED_SECTORS)} THEN 'excluded' WHEN sector IN {_in(C.TIER_1)} THEN 'tier_1'
    WHEN sector IN {_in(C.TIER_2)} THEN 'tier_2' WHEN sector IN {_in(C.WATCHLIST)} THEN 'watchlist' END AS tier,
  {sql_any('description', C.CAPITAL_WORDS)} AND NOT (claimed_recurring OR {sql_any('description', C.SERVICE_TAIL_WORDS)}) AS capital
  FROM v_rules),
x AS (SELECT *, CASE
  WHEN contains(lower(coalesce(title, '')), 'franchise') THEN {_q(C.R_FRANCHISE_TITLE)}
  WHEN tier = 'excluded' THEN {_fmt(C.R_SECTOR, 'sector')}
  WHEN {sql_any('description', C.DECLINE_WORDS)} THEN {_q(C.R_DECLINE)}
  WHEN {sql_any('description', C.FRANCHISE_WORDS)} THEN {_q(C.R_FRANCHISE_TEXT)}
  WHEN {sql_any('description', C.CONCENTRATION_WORDS)} THEN {_q(C.R_CONCENTRATION)}
  WHEN revenue < {C.REVENUE_FLOOR} THEN {_fmt(C.R_FLOOR, _MONEY('revenue'))}
  WHEN capital THEN {_q(C.R_CAPITAL)}
  WHEN {sql_any('description', C.OVERSEAS_WORDS)} THEN {_q(C.R_OVERSEAS)} END AS exclusion_reason,
  list_filter([CASE WHEN claimed_recurring THEN {_q(C.S_RECURRING)} END,
    CASE WHEN {sql_any('description', C.LICENCE_WORDS)} THEN {_q(C.S_LICENSED)} END,
    CASE WHEN coalesce(customer_type = 'B2B', false) OR {sql_any('description', C.B2B_WORDS)} THEN {_q(C.S_B2B)} END,
    CASE WHEN years_established >= {C.MIN_TENURE_YEARS} THEN {_fmt(C.S_TENURE, 'years_established')}
      WHEN {sql_any('description', C.TENURE_TRIGGERS)} AND {_STATED} >= {C.MIN_TENURE_YEARS} THEN {_fmt(C.S_TENURE_TEXT, _STATED)} END,
    CASE WHEN {sql_any('reason_for_sale', C.TRANSITION_WORDS)} THEN {_q(C.S_TRANSITION)} END], lambda s: s IS NOT NULL) AS signals,
  list_filter([CASE sector {' '.join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in C.WATCHLIST.items())} END,
    CASE WHEN revenue IS NULL THEN {_q(C.M_REVENUE)} WHEN revenue < {C.REVENUE_MIN} THEN {_fmt(C.M_REVENUE_LOW, _MONEY('revenue'))}
      WHEN revenue > {C.REVENUE_MAX} THEN {_fmt(C.M_REVENUE_HIGH, _MONEY('revenue'))} END,
    CASE WHEN ebitda IS NULL THEN {_q(C.M_EBITDA)} END,
    CASE WHEN NOT claimed_recurring THEN {_q(C.M_RECURRING)} END,
    CASE WHEN location_state IS NULL THEN {_q(C.M_LOCATION)} END], lambda s: s IS NOT NULL) AS lacks
  FROM f),
o AS (SELECT *, len(signals) AS n, coalesce(sector, 'Unknown') AS sec,
  exclusion_reason IS NULL AND coalesce(revenue BETWEEN {C.REVENUE_MIN} AND {C.REVENUE_MAX}, false)
    AND ((coalesce(tier, '') = 'tier_1' AND len(signals) >= 1) OR (coalesce(tier, '') = 'tier_2' AND len(signals) >= 2)) AS good
  FROM x),
r AS (SELECT *, CASE WHEN exclusion_reason IS NOT NULL THEN 'excluded' WHEN good THEN 'promising' ELSE 'needs_information' END AS outcome,
  CASE WHEN exclusion_reason IS NOT NULL THEN [exclusion_reason]
    WHEN good THEN list_concat([CASE WHEN tier = 'tier_1' THEN {_fmt(C.T_TIER_1, 'sec')} ELSE {_fmt(C.T_TIER_2, 'sec')} END], signals)
    WHEN tier = 'tier_1' THEN [{_fmt(C.T_TIER_1, 'sec')}, CASE WHEN n >= 1 THEN {_fmt(C.T_TIER_1_RANGE, 'sec')} ELSE {_fmt(C.T_TIER_1_NONE, 'sec')} END]
    WHEN tier = 'tier_2' THEN [{_fmt(C.T_TIER_2, 'sec')}] WHEN tier = 'watchlist' THEN [{_fmt(C.T_WATCH, 'sec')}]
    ELSE [{_fmt(C.T_UNKNOWN, 'sec')}] END AS matched,
  CASE WHEN exclusion_reason IS NOT NULL THEN [] WHEN good OR tier = 'watchlist' THEN lacks
    WHEN tier = 'tier_1' THEN list_concat(lacks, list_transform(signals, lambda s: {_fmt(C.M_UNCONFIRMED, 's')}))
    WHEN tier = 'tier_2' THEN list_concat(lacks, [{_fmt(C.M_TIER_2, 'sec', 'CAST(n AS VARCHAR)')}])
    ELSE list_concat(lacks, [{_q(C.M_SECTOR)}]) END AS missing,
  CASE WHEN exclusion_reason IS NULL THEN nullif(sector, 'Unknown') END AS sector_code
  FROM o)
"""


def _ruled(spark, folder, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    return V.rule_rows(spark, folder).transform(rules.apply_rules(cfg, explain=True))


@query("rules_exclusion_reason", with_views(_FLAGS + """
SELECT coalesce(exclusion_reason, 'none') AS reason, count(*) AS n_listings FROM r GROUP BY 1""", "v_rules"))
def rules_exclusion_reason(spark, folder):
    rows = _ruled(spark, folder)
    return rows.groupBy(F.coalesce("exclusion_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n_listings"))


@query("rules_outcome", with_views(_FLAGS + """
SELECT id, outcome, array_to_string(matched, ' | ') AS matched_rules, sector_code, '0.2' AS criteria_version FROM r""", "v_rules"))
def rules_outcome(spark, folder):
    return _ruled(spark, folder).select(
        "id", "outcome", F.array_join("matched_rules", " | ").alias("matched_rules"), "sector_code", "criteria_version"
    )


@query("rules_signals", with_views(_FLAGS + """
SELECT id, n AS n_signals, array_to_string(signals, ' | ') AS signals FROM r""", "v_rules"))
def rules_signals(spark, folder):
    return _ruled(spark, folder).select(
        "id", F.size("signals").cast("bigint").alias("n_signals"), F.array_join("signals", " | ").alias("signals")
    )


@query("rules_missing_facts", with_views(_FLAGS + """
SELECT id, array_to_string(missing, ' | ') AS missing_facts FROM r""", "v_rules"))
def rules_missing_facts(spark, folder):
    return _ruled(spark, folder).select("id", F.array_join("missing_facts", " | ").alias("missing_facts"))


@query("rules_outcome_counts", with_views(_FLAGS + """
SELECT outcome, coalesce(tier, 'other') AS tier, count(*) AS n_listings, CAST(sum(n) AS BIGINT) AS n_signals FROM r GROUP BY 1, 2""", "v_rules"))
def rules_outcome_counts(spark, folder):
    tier = F.coalesce(rules.sector_tier(F.col("sector")), F.lit("other"))
    return _ruled(spark, folder).groupBy("outcome", tier.alias("tier")).agg(
        F.count("*").alias("n_listings"), F.sum(F.size("signals")).alias("n_signals")
    )


@query("wide_exclusions", with_views(f"""
SELECT id, coalesce(sector IN {_in(C.EXCLUDED_SECTORS_WIDE)}, false) AND NOT contains(lower(coalesce(title, '')), 'franchise') AS sector_excluded
FROM v_rules""", "v_rules"))
def wide_exclusions(spark, folder):
    ruled = _ruled(spark, folder, RuleConfig(wide_exclusions=True))
    hit = F.coalesce(F.startswith("exclusion_reason", F.lit("Hard exclusion: sector (")), F.lit(False))
    return ruled.select("id", hit.alias("sector_excluded"))


@query("size_flags", with_views(f"""
SELECT id, array_to_string(list_filter([
  CASE WHEN asking_price > {C.PRICE_FLAG} THEN {_fmt(C.M_PRICE_HIGH, _MONEY('asking_price'))} END,
  CASE WHEN share > {C.CONCENTRATION_FLAG_PCT} THEN {_fmt(C.M_CONCENTRATION, 'share')} END,
  CASE WHEN ebitda < 0 THEN {_fmt(C.M_EBITDA_NEGATIVE, _MONEY('ebitda'))} END], lambda s: s IS NOT NULL), ' | ') AS flags
FROM (SELECT *, TRY_CAST(regexp_extract(description, '(?i)(?:^|[^0-9.,])([0-9]+)(?:\\.[0-9]+)?\\s*% of (?:revenue|sales|turnover)', 1) AS INTEGER) AS share FROM v_rules)""", "v_rules"))
def size_flags(spark, folder):
    flags = F.array_compact(F.array(*rules.size_flags()))
    return V.rule_rows(spark, folder).select("id", F.array_join(flags, " | ").alias("flags"))


@query("keyword_whole_words", with_views(f"""
SELECT id, coalesce(regexp_matches(lower(description), '(?:^|\\W)(?:{'|'.join(w.lower() for w in C.LICENCE_WORDS)})(?:\\W|$)'), false) AS licensed,
  {sql_any('description', C.LICENCE_WORDS)} AS licensed_substring FROM v_rules""", "v_rules"))
def keyword_whole_words(spark, folder):
    from listwright.functions import text as X

    return V.rule_rows(spark, folder).withColumn("low", F.lower("description")).select(
        "id", X.holds_word("low", C.LICENCE_WORDS).alias("licensed"),
        X.holds_any("low", C.LICENCE_WORDS).alias("licensed_substring"),
    )


@query("rules_from_store", with_views("""
SELECT v.id, f.revenue, f.sector, v.title FROM v_listings v LEFT JOIN v_facts f USING (k)""", "v_listings", "v_facts"))
def rules_from_store(spark, folder):
    """Rule inputs assembled from stored rows and facts."""
    stored = V.listings(spark, folder).select("k", "id", "title", "location_state", "asking_price")
    known = (
        V.facts(spark, folder)
        .join(stored.select("k", "id"), "k")
        .withColumns({"sector_classification": F.col("sector"), "description_summary": F.lit("x")})
    )
    return rules.rules_input(stored, known).select("id", "revenue", "sector", "title")


# ------------------------------------------------------------------ responses and facts
_ISLAND = "CASE WHEN json_valid(nullif(regexp_extract(response, '(?s)(\\{.*\\})', 1), '')) THEN regexp_extract(response, '(?s)(\\{.*\\})', 1) END"


def _jint(field: str, kind: str = "BIGINT") -> str:
    return f"TRY_CAST(nullif(regexp_extract(json_extract_string(j, '$.{field}'), '^\\s*([+-]?[0-9]+)', 1), '') AS {kind})"


def _jstr(field: str) -> str:
    return f"nullif(nullif(trim(json_extract_string(j, '$.{field}')), ''), 'null')"


_OWN = "CASE WHEN asking_price > 0 AND {e} > 0 THEN floor(CAST(asking_price AS DOUBLE) / {e} * 10 + CAST(0.5 AS DOUBLE)) / 10 END".format(e=_jint("ebitda"))
_SUPPLIED = "TRY_CAST(nullif(regexp_extract(json_extract_string(j, '$.asking_multiple'), '^\\s*([+-]?[0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE)"


@query("response_parse", with_views(f"""
SELECT n, {_jint('revenue')} AS revenue, {_jstr('revenue_raw')} AS revenue_raw, {_jint('ebitda')} AS ebitda, {_jint('lease_years', 'INTEGER')} AS lease_years,
  {_jstr('reason_for_sale')} AS reason_for_sale,
  CASE WHEN {_jstr('customer_type')} IN ('B2B','B2C','mixed') THEN {_jstr('customer_type')} END AS customer_type,
  coalesce(json_type(j, '$.claimed_recurring') = 'BOOLEAN' AND json_extract_string(j, '$.claimed_recurring') = 'true', false) AS claimed_recurring,
  CASE WHEN j IS NULL THEN {_q(C.SUMMARY_FAILED)} ELSE {_q(C.SUMMARY_MISSING)} END AS description_summary,
  coalesce({_jstr('sector_classification')}, 'Unknown') AS sector_classification, j IS NULL AS parse_failed
FROM (SELECT *, {_ISLAND} AS j FROM v_responses)""", "v_responses"))
def response_parse(spark, folder):
    return facts_op.parse_responses(V.responses(spark, folder)).select(
        "n", *(F.col(f"facts.{c}").alias(c) for c in (
            "revenue", "revenue_raw", "ebitda", "lease_years", "reason_for_sale", "customer_type",
            "claimed_recurring", "description_summary", "sector_classification")), "parse_failed",
    )


@query("advertised_multiple", with_views(f"""
SELECT n, CASE WHEN abs(supplied - own) / own < {C.MULTIPLE_TOLERANCE} THEN supplied ELSE own END AS asking_multiple
FROM (SELECT n, {_SUPPLIED} AS supplied, nullif({_OWN}, 0) AS own0, {_OWN} AS own FROM (SELECT *, {_ISLAND} AS j FROM v_responses))""", "v_responses"))
def advertised_multiple(spark, folder):
    return facts_op.parse_responses(V.responses(spark, folder)).select("n", "facts.asking_multiple")


@query("parse_failures", with_views(f"""
SELECT j IS NULL AS parse_failed, count(*) AS n_rows FROM (SELECT *, {_ISLAND} AS j FROM v_responses) GROUP BY 1""", "v_responses"))
def parse_failures(spark, folder):
    return facts_op.parse_responses(V.responses(spark, folder)).groupBy("parse_failed").agg(F.count("*").alias("n_rows"))


@query("coerce_fields", """
SELECT event_id AS n, TRY_CAST(nullif(regexp_extract(v, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS as_int,
  TRY_CAST(nullif(regexp_extract(v, '^\\s*([+-]?[0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE) AS as_float,
  nullif(nullif(trim(v), ''), 'null') AS as_text
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || value || ' pa' WHEN 1 THEN '-' || value WHEN 2 THEN 'x' || value
  WHEN 3 THEN ' null ' WHEN 4 THEN '  ' ELSE CAST(event_id AS VARCHAR) END AS v FROM events)""")
def coerce_fields(spark, folder):
    from listwright.functions import text as X

    n = F.col("event_id")
    number = F.col("value").cast("string")
    v = (
        F.when(n % 6 == 0, F.concat(F.lit(" "), number, F.lit(" pa"))).when(n % 6 == 1, F.concat(F.lit("-"), number))
        .when(n % 6 == 2, F.concat(F.lit("x"), number)).when(n % 6 == 3, F.lit(" null ")).when(n % 6 == 4, F.lit("  "))
        .otherwise(n.cast("string"))
    )
    rows = V.table(spark, folder, "events").select(n.alias("n"), v.alias("v"))
    t = F.col("v")
    return rows.select("n", X.leading_int(t).alias("as_int"), X.leading_float(t).alias("as_float"), facts_op.as_string(t).alias("as_text"))


def _am(label: str) -> str:
    pat = rf"(?i)\b((?:{label})(?: of| is|:)? *(-?)\$ ?([0-9][0-9,]*(?:\.[0-9]+)?) ?(million|m|k)?\b)"
    g = lambda i: f"regexp_extract(text, '{pat}', {i})"
    return (
        f"CAST(floor(TRY_CAST(nullif(replace({g(3)}, ',', ''), '') AS DECIMAL(18,4)) * CASE lower({g(4)}) WHEN 'm' THEN 1000000 WHEN 'million' THEN 1000000 WHEN 'k' THEN 1000 ELSE 1 END"
        f" * CASE WHEN {g(2)} = '-' THEN -1 ELSE 1 END) AS BIGINT)"
    )


def _raw(label: str) -> str:
    return f"nullif(regexp_extract(text, '(?i)\\b((?:{label})(?: of| is|:)? *(-?)\\$ ?([0-9][0-9,]*(?:\\.[0-9]+)?) ?(million|m|k)?\\b)', 1), '')"


_SECTOR = "CASE " + " ".join(f"WHEN {sql_any('text', words)} THEN {_q(code)}" for code, words in C.SECTOR_WORDS) + " ELSE 'Unknown' END"
_B2B, _B2C = sql_any("text", C.B2B_WORDS), sql_any("text", facts_op.CONSUMER)


@query("facts_rules", with_views(f"""
SELECT id, {_am(facts_op.REVENUE)} AS revenue, {_raw(facts_op.REVENUE)} AS revenue_raw, {_am(facts_op.EBITDA)} AS ebitda, {_raw(facts_op.EBITDA)} AS ebitda_raw,
  {_raw(facts_op.PROFIT)} AS profit_unspecified_raw,
  CASE WHEN asking_price > 0 AND {_am(facts_op.EBITDA)} > 0 THEN floor(CAST(asking_price AS DOUBLE) / {_am(facts_op.EBITDA)} * 10 + CAST(0.5 AS DOUBLE)) / 10 END AS asking_multiple,
  TRY_CAST(replace(nullif(regexp_extract(text, '(?i)(?:^|[^0-9.,])([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)[ -]years? lease', 1), ''), ',', '') AS INTEGER) AS lease_years,
  TRY_CAST(replace(nullif(regexp_extract(text, '(?i)(?:^|[^0-9.,])([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+) (?:full[- ]time |part[- ]time )?(?:staff|employees)', 1), ''), ',', '') AS INTEGER) AS staff_count,
  nullif(trim(regexp_extract(text, '(?i)reason for (?:sale|selling)[: ]+([^.\\n]+)', 1)), '') AS reason_for_sale,
  CASE WHEN {_B2B} AND {_B2C} THEN 'mixed' WHEN {_B2B} THEN 'B2B' WHEN {_B2C} THEN 'B2C' END AS customer_type,
  regexp_matches(text, '(?i)\\b(?:contracts?|service agreements?|retainers?|subscriptions?|recurring revenue)\\b') AS claimed_recurring,
  {_SECTOR} AS sector_classification
FROM v_ads""", "v_ads"))
def facts_rules(spark, folder):
    return facts_op.text_facts(V.ad_texts(spark, folder)).select(
        "id", *(F.col(f"facts.{c}").alias(c) for c in (
            "revenue", "revenue_raw", "ebitda", "ebitda_raw", "profit_unspecified_raw", "asking_multiple", "lease_years",
            "staff_count", "reason_for_sale", "customer_type", "claimed_recurring", "sector_classification")),
    )


@query("prompt_render", with_views("""
SELECT id, 'Read the business-for-sale advertisement and answer with one JSON object.' || chr(10) || 'Title: ' || source || chr(10) || 'Price: '
  || coalesce('AUD $' || format('{:,}', asking_price), 'not stated') || chr(10)
  || 'Fields: revenue, revenue_raw, ebitda, ebitda_raw, profit_unspecified_raw, asking_multiple, lease_years, staff_count, reason_for_sale, years_established, customer_type, claimed_recurring, description_summary, sector_classification, advertised_status'
  || chr(10) || 'Use null for anything the text does not state.' || chr(10) || 'Text:' || chr(10) || text AS prompt
FROM v_ads""", "v_ads"))
def prompt_render(spark, folder):
    prompt = facts_op.render_prompt(F.col("source"), F.col("asking_price"), F.col("text"))
    return V.ad_texts(spark, folder).select("id", prompt.alias("prompt"))


def _echo(prompts):
    """A stand-in extractor for checks: answers with the stated turnover."""
    stated = prompts.str.extract(r"turnover of \$([\d,]+)", expand=False).str.replace(",", "")
    return '{"revenue": ' + stated + ', "claimed_recurring": false}'


@query("facts_map_in_pandas", with_views("""
SELECT id, CAST(replace(regexp_extract(text, 'turnover of \\$([0-9,]+)', 1), ',', '') AS BIGINT) AS revenue, false AS parse_failed FROM v_ads""", "v_ads"))
def facts_map_in_pandas(spark, folder):
    ads = V.ad_texts(spark, folder).select(
        "id", "asking_price", facts_op.render_prompt(F.col("source"), F.col("asking_price"), F.col("text")).alias("prompt")
    )
    parsed = facts_op.parse_responses(facts_op.extract_with(ads, _echo))
    return parsed.select("id", "facts.revenue", "parse_failed")


@query("version_stamps", with_views("""
SELECT id, '1.0.0' AS extraction_version, '0.2' AS criteria_version, false AS evidenced_recurring FROM v_ads""", "v_ads"))
def version_stamps(spark, folder):
    return facts_op.stamp(V.ad_texts(spark, folder)).select("id", "extraction_version", "criteria_version", "evidenced_recurring")
