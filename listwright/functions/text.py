"""Text, markup, number and label expressions. All of them stay native columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from listwright import config as C

# Unicode white space. The rare members sit behind one range test, so that the usual
# character is told apart by two comparisons instead of a dozen.
_RARE = (
    r"[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}]]"
)
WS = rf"[\t-\r \xA0{_RARE}]"
WS_NOT_BLANK = rf"[\t-\r\xA0{_RARE}]"
STYLE_BLOCK = r"(?is)<style[^>]*>.*?</style>"
SCRIPT_BLOCK = r"(?is)<script[^>]*>.*?</script>"
ANY_TAG = r"<[^>]+>"
LINE_TAG = (
    r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|h[1-6]|section|article|header|footer"
    r"|nav|main|aside)(?:[ /][^>]*)?>"
)
NAMED = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
H1 = r"(?i)<h1[^>]*>([^<]+)</h1>"


def found(value: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, or null when there is none."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def swap(value: Column, pairs) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def trim_ws(value: Column) -> Column:
    return F.regexp_replace(value, f"^{WS}+|{WS}+$", "")


def squeeze(value: Column) -> Column:
    """Runs of white space to one blank; single blanks, the usual case, are no match."""
    return F.trim(F.regexp_replace(value, f"{WS_NOT_BLANK}{WS}*|  +", " "))


MENU_BLOCK = r"(?is)<nav(?:\s[^>]*)?>.*?</nav\s*>"
MENU_LINE = r"(?im)^ *franchises? (?:for sale|opportunities) *(?:\n|\z)"


def _without_blocks(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, STYLE_BLOCK, " "), SCRIPT_BLOCK, " ")


def strip_tags(html: Column) -> Column:
    """Markup to one line of text."""
    return squeeze(swap(F.regexp_replace(_without_blocks(html), ANY_TAG, " "), NAMED))


def text_lines(html: Column) -> Column:
    """Markup to text that keeps one line per block element, for label: value captures."""
    blocks = F.regexp_replace(_without_blocks(html), LINE_TAG, "\n")
    flat = swap(F.regexp_replace(blocks, ANY_TAG, " "), NAMED)
    flat = F.regexp_replace(flat, r"[\t\f\r\xA0][\t\f\r \xA0]*|  +", " ")
    return F.btrim(F.regexp_replace(flat, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def ad_lines(html: Column) -> Column:
    """The lines of a page without its navigation, which says nothing about the business."""
    lines = text_lines(F.regexp_replace(html, MENU_BLOCK, "\n"))
    return F.btrim(F.regexp_replace(lines, MENU_LINE, ""), F.lit(" \n"))


def _utf16_char(code: Column) -> Column:
    """The character of a decimal code unit, as text."""
    wrapped = F.pmod(code.try_cast("decimal(38,0)"), F.lit(65536)).cast("bigint")
    return F.decode(F.unhex(F.lpad(F.hex(wrapped), 4, "0")), "UTF-16BE")


def decode_entities(value: Column) -> Column:
    """Named entities plus decimal references, each distinct reference replaced once."""
    named = swap(value, (*NAMED, ("&quot;", '"')))
    codes = F.array_distinct(F.regexp_extract_all(named, F.lit(r"&#(\d+);"), F.lit(1)))
    return F.aggregate(
        codes,
        named,
        lambda text, code: F.coalesce(
            F.replace(text, F.concat(F.lit("&#"), code, F.lit(";")), _utf16_char(code)), text),
    )


def h1_plain(html: Column) -> Column:
    """H1 title with named entities blanked."""
    return F.trim(F.regexp_replace(found(html, H1), "(?i)&[a-z]+;", " "))


def h1_decoded(html: Column) -> Column:
    return trim_ws(decode_entities(found(html, H1)))


def leading_int(value: Column, kind: str = "bigint") -> Column:
    """The integer a string starts with; anything after it is ignored."""
    return F.nullif(F.regexp_extract(value, f"^{WS}*([+-]?\\d+)", 1), F.lit("")).try_cast(kind)


def leading_float(value: Column) -> Column:
    number = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.nullif(F.regexp_extract(value, f"^{WS}*{number}", 1), F.lit("")).try_cast("double")


def parse_money(value: Column) -> Column:
    """Whole dollars out of text such as "$1,250,000"."""
    return leading_int(F.regexp_replace(value, r"[,$\s]", ""))


def normalise_state(value: Column) -> Column:
    return F.coalesce(F.try_element_at(constant_map(C.STATE_CODES), F.lower(value)), F.upper(value))


def content_hash(html: Column) -> Column:
    """Change-detection hash over the whole page."""
    return F.sha2(html, 256)


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_market_url(url: Column) -> Column:
    host = url_host(url)
    return F.coalesce(
        reduce(lambda a, b: a | b, (host.endswith(s) for s in C.MARKET_SUFFIXES)), F.lit(False)
    )


def feed_of_url(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("bsale.com.au")), C.ITEM_FEED).otherwise(C.CARD_FEED)


def absolute_url(base: str, path: Column) -> Column:
    return F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(base), path))


def url_number(url: Column, php: bool = False) -> Column:
    """Trailing "-<digits>" of a URL: a closing slash is ignored, or a ".php" ending allowed."""
    if php:
        return found(F.element_at(F.split(url, "/"), -1), r"-(\d+)(?:\.php)?$")
    return found(F.regexp_replace(url, "/$", ""), r"-(\d+)$")


def slug_words(path: Column) -> Column:
    """Words of a card detail path: its prefix and numeric ending removed."""
    bare = F.regexp_replace(F.replace(path, F.lit(C.CARD_DETAIL_PATH), F.lit("")), r"-\d+\.php$", "")
    return F.replace(bare, F.lit("-"), F.lit(" "))


def slug_title(slug: Column, number: Column) -> Column:
    """Title case of an item slug without its numeric ending.

    The first letter of every run of word characters is raised and the rest left alone,
    so letters after an apostrophe are raised too.
    """
    ending = F.concat(F.lit("-"), number)
    bare = F.when(
        F.endswith(slug, ending), F.left(slug, F.length(slug) - F.length(ending))
    ).otherwise(slug)
    words = F.replace(bare, F.lit("-"), F.lit(" "))
    runs = F.regexp_extract_all(words, F.lit(r"(\w+|\W+)"), F.lit(1))
    raised = F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2))))
    return trim_ws(F.array_join(raised, ""))


def slug_state(slug: Column, page_state: Column) -> Column:
    """State code named in a slug, in fixed precedence, else the state of the page."""
    named = F.coalesce(
        *(F.when(F.contains(slug, F.lit(f"-{s.lower()}-")), s) for s in C.SLUG_STATES)
    )
    return F.coalesce(named, F.upper(page_state))


def one_of(values) -> Column:
    """A constant array of texts; folded when the plan is optimized."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def constant_map(pairs: dict[str, str]) -> Column:
    text = "\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\x1e"), F.lit("\x1f"))


def holds_any(column: str, words) -> Column:
    """Does a named, already lower-cased column hold any of the words? Null holds none."""
    quoted = (w.lower().replace("\\", "\\\\").replace("'", "\\'") for w in words)
    tests = " OR ".join(f"contains({column}, '{w}')" for w in quoted)
    return F.expr(f"coalesce({tests}, false)")


def holds_word(column: str, words) -> Column:
    """The same for whole words only."""
    body = "|".join(re.escape(w.lower()) for w in words)
    return F.coalesce(F.col(column).rlike(rf"(?:^|\W)(?:{body})(?:\W|$)"), F.lit(False))


def has_any(value: Column, words) -> Column:
    """Does the text hold any of the words, ignoring case? Null or empty text holds none."""
    low = F.lower(value)
    hit = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w.lower())) for w in words))
    return F.coalesce(hit, F.lit(False))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def short_money(amount: Column) -> Column:
    """1.2m / 450k form; zero and null have none."""
    exact = amount.cast("decimal(20,0)")
    millions = F.round(exact / F.lit(1_000_000).cast("decimal(8,0)"), 1).cast("decimal(20,1)")
    kilos = F.round(exact / F.lit(1_000).cast("decimal(8,0)"), 0).cast("decimal(20,0)")
    text = F.when(amount >= 1_000_000, F.concat(millions.cast("string"), F.lit("m"))).otherwise(
        F.concat(kilos.cast("string"), F.lit("k"))
    )
    return F.when(F.coalesce(amount, F.lit(0)) != 0, text)


def location_label(suburb: Column, state: Column, unknown: str) -> Column:
    parts = F.concat_ws(", ", F.nullif(suburb, F.lit("")), F.nullif(state, F.lit("")))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit(unknown))


def plain_number(value: Column) -> Column:
    """A one-decimal number as people write it: 3.5 stays, 4.0 becomes 4."""
    return F.regexp_replace(value.cast("decimal(20,4)").cast("string"), r"\.?0+$", "")


def outcome_label(outcome: Column) -> Column:
    """First underscore to a space, upper case."""
    return F.upper(F.regexp_replace(F.coalesce(outcome, F.lit("unclassified")), "^([^_]*)_", "$1 "))


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_time(ts: Column, zone: str = C.LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def local_date(ts: Column, zone: str = C.LOCAL_ZONE) -> Column:
    return F.date_format(local_time(ts, zone), "yyyy-MM-dd")


def minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n)


def only(values: Column, others: Column) -> Column:
    """Array difference that keeps order and repeats."""
    return F.filter(values, lambda x: ~F.array_contains(others, x))


def split_reasons(reasons: Column) -> tuple[Column, Column]:
    """A mixed reason list, as (positive reasons, missing facts)."""

    def is_missing(x):
        tests = [x.startswith(p) for p in C.MISSING_PREFIXES]
        tests += [F.contains(x, F.lit(p)) for p in C.MISSING_PHRASES]
        return reduce(lambda a, b: a | b, tests)

    missing = F.filter(reasons, is_missing)
    return only(reasons, missing), missing


def encode_list(values: Column) -> Column:
    return F.to_json(values)


def decode_list(text: Column) -> Column:
    """JSON array text to strings; null or broken text gives an empty list."""
    valid = F.try_parse_json(text).isNotNull()
    parsed = F.when(valid, F.from_json(text, "array<string>"))
    return F.coalesce(parsed, F.array().cast("array<string>"))
