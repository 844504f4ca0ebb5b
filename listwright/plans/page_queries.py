"""Page, text and discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright import config as C
from listwright.functions import text as X
from listwright.operators import detail, discovery
from listwright.plans import views as V
from listwright.plans.registry import query
from listwright.plans.views import sql_pick, with_views

# White space the way the SQL side's regex engine spells it.
WS = (
    r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}]"
)
_NAMED = "replace(replace(replace(replace({}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')".format
_BLOCKS = f"regexp_replace(regexp_replace(html, '{X.STYLE_BLOCK}', ' ', 'g'), '{X.SCRIPT_BLOCK}', ' ', 'g')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return _trim(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


STRIP = _squeeze(_NAMED(f"regexp_replace({_BLOCKS}, '<[^>]+>', ' ', 'g')"))
_FLAT = _NAMED(f"regexp_replace(regexp_replace({_BLOCKS}, '{X.LINE_TAG}', chr(10), 'g'), '<[^>]+>', ' ', 'g')")
_SPACED = f"regexp_replace({_FLAT}, '[\\t\\f\\r \\x{{00A0}}]+', ' ', 'g')"
LINES = _trim(f"regexp_replace({_SPACED}, ' ?\\n[ \\n]*', chr(10), 'g')")
_H1 = "regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1)"


def _first(pattern: str, group: int = 1, text: str = "t") -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def _money(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(regexp_replace({x}, '[,$\\s]', '', 'g'), '^([+-]?[0-9]+)', 1), '') AS BIGINT)"


@query("page_strip_tags", f"SELECT page_id, {STRIP} AS text FROM pages")
def page_strip_tags(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("page_text_lines", f"SELECT page_id, {LINES} AS text FROM pages")
def page_text_lines(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", X.text_lines(F.col("html")).alias("text"))


@query("page_h1", f"SELECT page_id, trim(regexp_replace(nullif({_H1}, ''), '(?i)&[a-z]+;', ' ', 'g')) AS title FROM pages")
def page_h1(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", X.h1_plain(F.col("html")).alias("title"))


_QUOT = f"replace({_NAMED('x')}, '&quot;', '\"')"


@query("page_entities", f"""
SELECT page_id, replace(replace(replace({_QUOT}, '&#39;', ''''), '&#8211;', chr(8211)), '&#' || (page_id % 26 + 97) || ';', chr(CAST(page_id % 26 + 97 AS INTEGER))) AS title
FROM (SELECT page_id, {_H1} || ' &quot;it&#39;s&quot; &#8211; &#' || (page_id % 26 + 97) || '; &nbsp;&lt;' AS x FROM pages)""")
def page_entities(spark, folder):
    """Headings with more references of each kind added."""
    code = (F.col("page_id") % 26 + 97).cast("string")
    raw = F.concat(X.found(F.col("html"), X.H1), F.lit(" &quot;it&#39;s&quot; &#8211; &#"), code, F.lit("; &nbsp;&lt;"))
    return V.table(spark, folder, "pages").select("page_id", X.decode_entities(raw).alias("title"))


@query("page_hash", "SELECT page_id, sha256(html) AS content_hash FROM pages")
def page_hash(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", X.content_hash(F.col("html")).alias("content_hash"))


_HOST = "regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1)"


@query("page_host", f"""
SELECT page_id, {_HOST} AS host, {_HOST} LIKE '%.com' OR {_HOST} LIKE '%.com.au' AS is_market,
  CASE WHEN contains(url, 'bsale.com.au') THEN 'bsale' ELSE 'business2sell' END AS feed FROM pages""")
def page_host(spark, folder):
    url = F.col("url")
    return V.table(spark, folder, "pages").select(
        "page_id", X.url_host(url).alias("host"), X.is_market_url(url).alias("is_market"), X.feed_of_url(url).alias("feed")
    )


@query("page_href_explode", """
SELECT page_id, unnest(generate_series(0, len(h) - 1)) AS pos, 'https://bsale.com.au' || unnest(h) AS url
FROM (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS h FROM pages) WHERE len(h) > 0""")
def page_href_explode(spark, folder):
    links = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    rows = V.table(spark, folder, "pages").select("page_id", F.posexplode(links).alias("pos", "path"))
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), X.absolute_url(C.ITEM_BASE, F.col("path")).alias("url"))


@query("card_explode", with_views("""
SELECT page_id, CAST(i - 1 AS BIGINT) AS pos, CAST(number AS VARCHAR) AS source_listing_id, 'https://www.business2sell.com.au' || path AS canonical_url,
  coalesce(label, 'shop ' || (page_id % 7)) AS title, price AS asking_price FROM v_cards WHERE path IS NOT NULL""", "v_cards"))
def card_explode(spark, folder):
    return discovery.cards(V.card_pages(spark, folder)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "source_listing_id", "canonical_url", "title", "asking_price"
    )


_SLUG = "regexp_replace(split_part(url, '/listing/', 2), '/$', '')"
_STATE_CASE = "CASE " + " ".join(f"WHEN contains(slug, '-{s.lower()}-') THEN '{s}'" for s in C.SLUG_STATES) + " ELSE upper(state) END"


@query("jsonld_explode", with_views(f"""
SELECT page_id, pos, source_listing_id, url AS canonical_url, {_STATE_CASE} AS location_state
FROM (SELECT *, {_SLUG} AS slug, regexp_extract(regexp_replace(url, '/$', ''), '-([0-9]+)$', 1) AS source_listing_id FROM v_items)
WHERE contains(url, 'bsale.com.au/listing/') AND source_listing_id <> ''""", "v_items"))
def jsonld_explode(spark, folder):
    return discovery.item_lists(V.ld_pages(spark, folder)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "source_listing_id", "canonical_url", "location_state"
    )


@query("jsonld_titles", with_views("""
SELECT page_id, pos, upper(left(x, 1)) || substr(x, 2) || '''S Shop' || CASE (page_id + pos) % 4 WHEN 0 THEN ' Vic' WHEN 1 THEN ' Nsw' WHEN 2 THEN '' ELSE ' Nt' END AS title
FROM v_items WHERE pos % 5 < 3""", "v_items"))
def jsonld_titles(spark, folder):
    return discovery.item_lists(V.ld_pages(spark, folder)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "title")


_PART_SLUG = f"replace(p_name, ' ', '-') || '-' || lower({sql_pick((*C.SLUG_STATES, 'x'), 'p_partkey')}) || '-' || p_partkey"


def _slugs(spark, folder):
    k = F.col("p_partkey")
    state = F.lower(V.pick((*C.SLUG_STATES, "x"), k))
    return V.table(spark, folder, "part").select(
        "p_partkey", F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), state, k.cast("string")).alias("slug")
    )


@query("slug_id", f"""
SELECT p_partkey, regexp_extract({_PART_SLUG}, '-([0-9]+)$', 1) AS number, regexp_extract({_PART_SLUG} || '.php', '-([0-9]+)(?:\\.php)?$', 1) AS php_number FROM part""")
def slug_id(spark, folder):
    slug = F.col("slug")
    url = F.concat(F.lit("https://bsale.com.au/listing/"), slug)
    return _slugs(spark, folder).select(
        "p_partkey", X.url_number(F.concat(url, F.lit("/"))).alias("number"),
        X.url_number(F.concat(url, F.lit(".php")), php=True).alias("php_number"),
    )


@query("slug_title", f"""
SELECT p_partkey, array_to_string(list_transform(string_split(regexp_replace({_PART_SLUG}, '-[0-9]+$', ''), '-'), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title,
  replace(regexp_replace({_PART_SLUG}, '-[0-9]+$', ''), '-', ' ') AS card_title FROM part""")
def slug_title(spark, folder):
    number = F.col("p_partkey").cast("string")
    path = F.concat(F.lit(C.CARD_DETAIL_PATH), F.col("slug"), F.lit(".php"))
    return _slugs(spark, folder).select(
        "p_partkey", X.slug_title(F.col("slug"), number).alias("title"), X.slug_words(path).alias("card_title")
    )


@query("slug_state", f"""
SELECT p_partkey, {_STATE_CASE} AS location_state FROM (SELECT p_partkey, {_PART_SLUG} AS slug, 'vic' AS state FROM part)""")
def slug_state(spark, folder):
    return _slugs(spark, folder).select("p_partkey", X.slug_state(F.col("slug"), F.lit("vic")).alias("location_state"))


_STATE_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in C.STATE_CODES.items()) + "}"


def _state_code(x: str) -> str:
    return f"coalesce({_STATE_MAP}[lower({x})], upper({x}))"


_PLACE_A = "(?:Location|State)[: \\n]+([A-Za-z ]+), *([A-Za-z ]+) *\\d*"
_LINES_CTE = f"SELECT page_id, id, html, {LINES} AS t FROM v_details"


@query("detail_fields", with_views(f"""
SELECT id, trim(regexp_replace(nullif({_H1}, ''), '(?i)&[a-z]+;', ' ', 'g')) AS title, {_state_code(f"trim({_first(_PLACE_A, 2)})")} AS location_state,
  trim({_first(_PLACE_A, 1)}) AS location_suburb, trim({_first('Business Category\\s+([^\\n]+)')}) AS sector_raw,
  trim({_first('(?:Broker|Agent|Listed by)(?: *:[ \\n]*| +)([A-Za-z ]+?) *(?:\\n|Email|Phone|Mobile|<|$)')}) AS broker_name,
  {_money(_first('Asking Price:\\s*\\$?([0-9,]+)'))} AS asking_price, trim({_first('Sales revenue\\s*:\\s*([^\\n]+)')}) AS revenue_raw,
  trim({_first('Net profit\\s*:\\s*([^\\n]+)')}) AS profit_raw
FROM ({_LINES_CTE})""", "v_details"))
def detail_fields(spark, folder):
    return detail.card_details(V.detail_pages(spark, folder)).select(
        "id", "title", "location_state", "location_suburb", "sector_raw", "broker_name", "asking_price", "revenue_raw", "profit_raw"
    )


_PLACE_B = f"([A-Za-z ]+), *({'|'.join(C.STATE_NAMES)}) *[0-9]{{4}}"
_BROKER_B = f"trim({_first('(?:(?:Business Broker|Broker)(?: *:[ \\n]*| +)|Private Seller *:[ \\n]*)([A-Za-z ]+?) *(?:\\n|Phone|Email|Mobile|$)')})"


@query("detail_fields_items", with_views(f"""
SELECT id, replace({_NAMED(_H1)}, '&#233;', 'é') AS title, {_state_code(_first(_PLACE_B, 2))} AS location_state, trim({_first(_PLACE_B, 1)}) AS location_suburb,
  trim({_first('Business Category\\s+([^\\n]+)')}) AS sector_raw,
  CASE WHEN {_BROKER_B} IS NOT NULL AND NOT contains({_BROKER_B}, 'Broker') THEN {_BROKER_B} WHEN contains(t, 'Private Seller') THEN 'Private Seller' END AS broker_name,
  {_money(_first('\\$([0-9,]+)(?:\\s|$|\\+)'))} AS asking_price, nullif(trim({_first('Turnover:\\s*([^\\n]+)')}), 'Not disclosed') AS revenue_raw,
  nullif(trim({_first('Net Profit:\\s*([^\\n]+)')}), 'Not disclosed') AS profit_raw, lower({_first('(?im)^ *(sold|under contract|off market) *$')}) AS advertised_status
FROM ({_LINES_CTE})""", "v_details"))
def detail_fields_items(spark, folder):
    return detail.item_details(V.detail_pages(spark, folder)).select("id", *detail.FIELDS)


@query("detail_overlay", with_views(f"""
SELECT l.id, coalesce(d.title, l.title) AS title, coalesce(d.location_state, l.location_state) AS location_state, coalesce(d.asking_price, l.asking_price) AS asking_price
FROM v_listings l LEFT JOIN (SELECT page_id, trim(regexp_replace(nullif({_H1}, ''), '(?i)&[a-z]+;', ' ', 'g')) AS title,
    CASE WHEN page_id % 2 = 0 THEN {_state_code(f"trim({_first(_PLACE_A, 2)})")} END AS location_state,
    {_money(_first('Asking Price:\\s*\\$?([0-9,]+)'))} AS asking_price FROM ({_LINES_CTE})) d ON d.page_id = l.k""", "v_listings", "v_details"))
def detail_overlay(spark, folder):
    found = detail.card_details(V.detail_pages(spark, folder))
    stored = V.listings(spark, folder)
    keyed = found.drop("id").join(stored.select(F.col("k").alias("page_id"), "id"), "page_id")
    keyed = keyed.withColumn("location_state", F.when(F.col("page_id") % 2 == 0, F.col("location_state")))
    return detail.overlay(stored, keyed).select("id", "title", "location_state", "asking_price")


@query("money_parse", f"""
SELECT p_partkey, {_money('v')} AS amount FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '$' || format('{{:,}}', p_partkey * 1000) WHEN 1 THEN ' $ ' || p_partkey || ' ONO'
  WHEN 2 THEN 'POA' WHEN 3 THEN p_partkey || '.75' ELSE '-' || p_partkey END AS v FROM part)""")
def money_parse(spark, folder):
    k = F.col("p_partkey")
    v = (
        F.when(k % 5 == 0, F.concat(F.lit("$"), F.format_number(k * 1000, 0))).when(k % 5 == 1, F.concat(F.lit(" $ "), k.cast("string"), F.lit(" ONO")))
        .when(k % 5 == 2, F.lit("POA")).when(k % 5 == 3, F.concat(k.cast("string"), F.lit(".75"))).otherwise(F.concat(F.lit("-"), k.cast("string")))
    )
    return V.table(spark, folder, "part").select("p_partkey", X.parse_money(v).alias("amount"))


_RAW_STATES = (*C.STATE_CODES, "Victoria", "NSW", "Auckland", "north island")


@query("state_normalise", f"""
SELECT p_partkey, {_state_code('s')} AS code FROM (SELECT p_partkey, {sql_pick(_RAW_STATES, 'p_partkey')} AS s FROM part)""")
def state_normalise(spark, folder):
    return V.table(spark, folder, "part").select("p_partkey", X.normalise_state(V.pick(_RAW_STATES, F.col("p_partkey"))).alias("code"))


# ------------------------------------------------------------------------- discovery
@query("dedup_first", with_views("""
SELECT source, source_listing_id, page_no, pos, asking_price FROM (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id ORDER BY page_no, pos) AS r FROM v_stubs) WHERE r = 1""", "v_stubs"))
def dedup_first(spark, folder):
    return discovery.first_seen_rows(V.feed_stubs(spark, folder), "page_no", "pos")


_CUTS = """SELECT p.source, min(p.page_no) FILTER (WHERE NOT p.ok OR n IS NULL) AS cut FROM v_fpages p
  LEFT JOIN (SELECT source, page_no, count(*) AS n FROM (SELECT source, source_listing_id, min(page_no) AS page_no FROM v_stubs GROUP BY 1, 2) GROUP BY 1, 2) f USING (source, page_no) GROUP BY 1"""


@query("pagination_cutoff", with_views(f"""
SELECT s.source, source_listing_id, page_no, pos FROM (SELECT *, row_number() OVER (PARTITION BY source, source_listing_id ORDER BY page_no, pos) AS r FROM v_stubs) s
JOIN ({_CUTS}) c ON c.source = s.source WHERE r = 1 AND (cut IS NULL OR page_no < cut)""", "v_stubs", "v_fpages"))
def pagination_cutoff(spark, folder):
    found = discovery.discovered(V.feed_stubs(spark, folder), V.feed_pages(spark, folder))
    return found.select("source", "source_listing_id", "page_no", "pos")


@query("pagination_cuts", with_views(_CUTS, "v_stubs", "v_fpages"))
def pagination_cuts(spark, folder):
    return discovery.pagination_cut(V.feed_stubs(spark, folder), V.feed_pages(spark, folder))


def _by_state(df):
    """Feeds of the events as the states of one feed."""
    names = ("view", "click", "error", "purchase", "signup")
    state = F.coalesce(*(F.when(F.col("source") == n, F.lit(s)) for n, s in zip(names, C.FEED_STATES)))
    return df.withColumn("state", state).withColumn("source", F.lit(C.ITEM_FEED))


def _states_sql() -> str:
    """Each state's rows without ids that earlier states kept, cut off, one group per state."""
    names = ("view", "click", "error", "purchase", "signup")
    groups, kept = [], []
    for i, (source, state) in enumerate(zip(names, C.FEED_STATES)):
        seen = " UNION ALL ".join(f"SELECT source_listing_id FROM k{j}" for j in range(i)) or "SELECT NULL WHERE false"
        groups.append(f"""r{i} AS (SELECT *, row_number() OVER (PARTITION BY source_listing_id ORDER BY page_no, pos) AS r FROM v_stubs
  WHERE source = '{source}' AND source_listing_id NOT IN ({seen})),
c{i} AS (SELECT min(p.page_no) FILTER (WHERE NOT p.ok OR n IS NULL) AS cut FROM v_fpages p
  LEFT JOIN (SELECT page_no, count(*) AS n FROM r{i} WHERE r = 1 GROUP BY 1) f USING (page_no) WHERE p.source = '{source}'),
k{i} AS (SELECT '{state}' AS state, source_listing_id, page_no, pos FROM r{i}, c{i} WHERE r = 1 AND (cut IS NULL OR page_no < cut))""")
        kept.append(f"SELECT * FROM k{i}")
    return "WITH " + ",\n".join(groups) + "\n" + " UNION ALL ".join(kept)


@query("pagination_states", with_views(_states_sql(), "v_stubs", "v_fpages"))
def pagination_states(spark, folder):
    stubs, pages = _by_state(V.feed_stubs(spark, folder)), _by_state(V.feed_pages(spark, folder))
    found = discovery.discovered_by_state(stubs, pages, C.FEED_STATES[:5])
    return found.select("state", "source_listing_id", "page_no", "pos")


_COVER = f"""SELECT source, NOT any_failed AND NOT coalesce(hit, false) AS coverage_complete, pages_ok > 0 AS success,
  CASE WHEN any_failed OR coalesce(hit, false) THEN CAST(coalesce(first_failed, coalesce(last_page, 0) + 1) AS VARCHAR) END AS next_checkpoint
  FROM (SELECT p.source, max(page_no) FILTER (WHERE ok AND (cut IS NULL OR page_no < cut)) AS last_page, count(*) FILTER (WHERE ok) AS pages_ok,
    count(*) FILTER (WHERE NOT ok AND http_status <> 404) > 0 AS any_failed, min(page_no) FILTER (WHERE NOT ok AND http_status <> 404) AS first_failed, max(CASE WHEN ok AND (cut IS NULL OR page_no < cut) THEN page_no >= limit_page END) AS hit
    FROM v_fpages p JOIN ({_CUTS}) c ON c.source = p.source WHERE cut IS NULL OR page_no <= cut GROUP BY 1)"""


def _cover(spark, folder):
    pages = V.feed_pages(spark, folder)
    cuts = discovery.pagination_cut(V.feed_stubs(spark, folder), pages)
    return discovery.coverage(pages, cuts, missing_page_ends=True)


@query("coverage_checkpoint", with_views(_COVER, "v_stubs", "v_fpages"))
def coverage_checkpoint(spark, folder):
    return _cover(spark, folder)


@query("frontier", with_views(f"""
WITH c AS (SELECT f.*, coalesce(CAST(v.next_checkpoint AS BIGINT), 1) AS start_page FROM v_feeds f LEFT JOIN ({_COVER}) v ON v.source = f.name)
SELECT source, page_no, CASE WHEN page_no = 1 THEN search_url ELSE search_url || '?page=' || page_no END AS url FROM (
  SELECT name AS source, search_url, CAST(unnest(generate_series(start_page, start_page + max_pages - 1)) AS INTEGER) AS page_no FROM c
  UNION ALL SELECT name, search_url, 1 FROM c WHERE start_page > 1)""", "v_feeds", "v_stubs", "v_fpages"))
def frontier(spark, folder):
    points = _cover(spark, folder).select(F.col("source").alias("name"), F.col("next_checkpoint").alias("checkpoint"))
    feeds = V.feed_config(spark, folder).withColumn("states", F.array().cast("array<string>"))
    return discovery.frontier(feeds.join(points, "name", "left")).select("source", "page_no", "url")


@query("feed_union", with_views("""
SELECT 'business2sell' AS source, CAST(number AS VARCHAR) AS source_listing_id, 'https://www.business2sell.com.au' || path AS canonical_url FROM v_cards WHERE path IS NOT NULL
UNION ALL SELECT 'bsale', regexp_extract(regexp_replace(url, '/$', ''), '-([0-9]+)$', 1), url FROM v_items
WHERE contains(url, 'bsale.com.au/listing/') AND regexp_matches(regexp_replace(url, '/$', ''), '-[0-9]+$')""", "v_cards", "v_items"))
def feed_union(spark, folder):
    from listwright.sources.adapters import union_feeds

    landed = _landed(spark, folder)
    return union_feeds(landed).select("source", "source_listing_id", "canonical_url")


def _landed(spark, folder, pages=None):
    """Card and item-list pages as one table of landed search pages."""
    common = [F.lit(200).alias("http_status"), (F.col("page_id") + 1).cast("int").alias("page_no"),
              F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"), "html"]
    cards = V.card_pages(spark, folder, pages).select(F.lit(C.CARD_FEED).alias("source"), F.lit(None).cast("string").alias("state"), *common)
    items = V.ld_pages(spark, folder, pages).select(F.lit(C.ITEM_FEED).alias("source"), "state", *common)
    return cards.unionByName(items)
