"""Search pages to listing stubs: explode, identify, de-duplicate, cut off, cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listwright import config as C
from listwright.functions import text as X
from listwright.session import written

MARK = 'data-listing-id="'


def cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per card of a page.

    A card starts at the tag holding its numeric id and ends where the next one starts. Its
    link is the one that ends in the card's own number, in the card or in the tag directly in
    front of it, else anywhere on the page, else the first one inside the card that does not
    carry another card's number. A neighbour's link is never borrowed, and cards without a
    detail link of their own are dropped. Where the link stands before its card, label and
    price are not read beyond the next card's link.
    """
    page = F.col(html)
    href = r'href="(' + C.CARD_DETAIL_PATH + r'[^"]+)"'
    starts = r'(?=<[^<>]*data-listing-id="\d+")'
    split = F.split(page, starts)
    # A page opening with a card gives no leading piece; an empty one keeps places even.
    opens = F.substring_index(page, ">", 1).rlike(r'^<[^<>]*data-listing-id="\d+"')
    pieces = F.when(opens, F.concat(F.array(F.lit("")), split)).otherwise(split)

    def numbered(links: Column, number: Column) -> Column:
        return F.get(F.filter(links, lambda h: F.endswith(h, F.concat(F.lit("-"), number, F.lit(".php")))), F.lit(0))

    def own_number(link: Column) -> Column:
        return F.regexp_extract(link, r"-(\d+)\.php$", 1)

    def card(piece: Column, i: Column) -> Column:
        behind = F.coalesce(F.get("_pieces", i - 1), F.lit(""))
        # The tag directly in front of the card may be its link.
        front = F.rtrim(behind)
        tag = F.concat(F.lit("<"), F.substring_index(front, "<", -1))
        lead = F.when(F.endswith(tag, F.lit(">")), tag).otherwise(F.lit(""))
        number = F.regexp_extract(piece, MARK + r"(\d+)", 1)
        inner = F.regexp_extract_all(piece, F.lit(href), F.lit(1))
        others = F.filter(inner, lambda h: (own_number(h) != number) & F.array_contains("_ids", own_number(h)))
        return F.struct(
            (i - 1).alias("pos"),
            number.alias("source_listing_id"),
            piece.alias("own"),
            lead.alias("lead"),
            behind.alias("behind"),
            numbered("_links", number).alias("far"),
            F.get(F.filter("_tags", lambda t: F.contains(t, F.concat(F.lit("-"), number, F.lit('.php"')))), F.lit(0)).alias("far_tag"),
            inner.alias("inner"),
            others.alias("others"),
        )

    # Pieces are a column of their own, and each is read with its neighbours only. What
    # is looked up in the whole page are its detail links and ids.
    cut = pages.withColumns({
        "_pieces": pieces,
        "_links": F.array_distinct(F.regexp_extract_all(page, F.lit(href), F.lit(1))),
        "_tags": F.filter(F.regexp_extract_all(page, F.lit("(<a [^<>]*>)"), F.lit(1)), lambda t: F.contains(t, F.lit('href="' + C.CARD_DETAIL_PATH))),
        "_ids": F.array_distinct(F.regexp_extract_all(page, F.lit(MARK + r'(\d+)"'), F.lit(1))),
    })
    per_card = F.filter(F.transform("_pieces", card), lambda c: c["pos"] >= 0)
    rows = cut.withColumn("_card", F.explode(per_card)).drop("_pieces", "_links", "_tags", "_ids", html)
    label = 'aria-label="([^"]+)"'
    own, lead, behind, far, number = (F.col(f"_card.{c}") for c in ("own", "lead", "behind", "far", "source_listing_id"))
    inner, others = F.col("_card.inner"), F.col("_card.others")
    near = F.concat(F.regexp_extract_all(lead, F.lit(href), F.lit(1)), inner)
    path = F.coalesce(numbered(near, number), far, F.get(F.array_except(inner, others), F.lit(0)))
    link = F.concat(F.lit('href="'), F.col("path"), F.lit('"'))
    # A label in the link's own tag counts even when the tag stands before the card.
    tags = F.regexp_extract_all(F.concat(lead, own), F.lit("(<a [^<>]*>)"), F.lit(1))
    link_tag = F.coalesce(F.get(F.filter(tags, lambda t: F.contains(t, link)), F.lit(0)), F.col("_card.far_tag"))
    # A card whose link stands before it ends at the next card's link.
    upto = F.call_function("substring_index", own, F.concat(F.lit('href="'), F.get(others, F.lit(0)), F.lit('"')), F.lit(1))
    upto = F.left(upto, F.length(upto) - F.length(F.substring_index(upto, "<", -1)))
    outside = ~F.contains(own, link)
    part = F.when(outside & (F.size(others) > 0), upto).otherwise(own)
    between = F.when(outside & F.contains(behind, link), F.call_function("substring_index", behind, link, F.lit(-1)))
    price = r"Asking Price[^$]*\$([\d,]+)"
    return (
        rows.withColumn("path", path)
        .filter(F.col("path").isNotNull())
        .withColumn("source_listing_id", number)
        .withColumn("pos", F.col("_card.pos"))
        .withColumn("_part", part)
        .withColumn("_between", between)
        .withColumn("title", F.coalesce(X.found(link_tag, label), X.found(F.col("_part"), label), X.found(F.col("_between"), label)))
        .withColumn("title", F.coalesce(X.squeeze(F.col("title")), X.slug_words(F.col("path"))))
        .withColumn("asking_price", X.parse_money(F.coalesce(X.found(F.col("_part"), price), X.found(F.col("_between"), price))))
        .withColumn("canonical_url", X.absolute_url(C.CARD_BASE, F.col("path")))
        .drop("_card", "path", "_part", "_between")
    )


def item_lists(pages: DataFrame, html: str = "html", state: str = "state") -> DataFrame:
    """One row per listing URL of the page's ItemList blocks, in page order."""
    script = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
    blocks = F.regexp_extract_all(F.col(html), F.lit(script), F.lit(1))
    parsed = F.filter(
        F.transform(blocks, lambda b: F.from_json(b, "`@type` string, itemListElement array<struct<url:string>>")),
        lambda b: b["@type"] == "ItemList",
    )
    items = F.flatten(F.transform(parsed, lambda b: F.coalesce(
        b["itemListElement"], F.array().cast("array<struct<url:string>>"))))
    url = F.col("_item.url")
    return (
        pages.select("*", F.posexplode(items).alias("pos", "_item"))
        .drop(html)
        .withColumn("source_listing_id", X.url_number(url))
        .filter(F.contains(url, F.lit(C.ITEM_DETAIL)) & F.col("source_listing_id").isNotNull())
        .withColumn("slug", F.regexp_replace(F.get(F.split(url, "/listing/"), F.lit(1)), "/$", ""))
        .withColumn("canonical_url", X.absolute_url(C.ITEM_BASE, url))
        .withColumn("title", X.slug_title(F.col("slug"), F.col("source_listing_id")))
        .withColumn("location_state", X.slug_state(F.col("slug"), F.col(state)))
        .withColumn("asking_price", F.lit(None).cast("bigint"))
        .drop("_item", "slug")
    )


def listing_id(source: str = "source", number: str = "source_listing_id") -> Column:
    return F.concat_ws(":", F.col(source), F.col(number))


def first_seen_rows(stubs: DataFrame, *order: str, key=("source", "source_listing_id")) -> DataFrame:
    """First occurrence of every key in page order.

    An aggregate instead of a ranking window: copies are dropped before the shuffle, so an
    id holding a large share of the rows does not gather in one task.
    """
    rest = [c for c in stubs.columns if c not in key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return stubs.groupBy(*key).agg(first).select(*key, "_first.*").select(*stubs.columns)


def pagination_cut(stubs: DataFrame, pages: DataFrame) -> DataFrame:
    """Per feed, the first page that ends its pagination: failed, empty, or nothing new on it.

    ``pages(source, page_no, ok)`` lists the fetched pages. One pass is exact for a linear
    feed: what lies past the cut can only come later, so it never hides an id before it.
    """
    firsts = stubs.groupBy("source", "source_listing_id").agg(F.min("page_no").alias("page_no"))
    fresh = firsts.groupBy("source", "page_no").agg(F.count("*").alias("n_new"))
    return (
        pages.join(fresh, ["source", "page_no"], "left")
        .withColumn("ends", ~F.col("ok") | F.col("n_new").isNull())
        .groupBy("source")
        .agg(F.min(F.when(F.col("ends"), F.col("page_no"))).alias("cut"))
    )


def discovered(stubs: DataFrame, pages: DataFrame) -> DataFrame:
    """The stubs a page-by-page crawl would have kept: first occurrences before the cut."""
    first = first_seen_rows(stubs, "page_no", "pos")
    kept = first.join(pagination_cut(stubs, pages), "source", "left")
    return kept.filter(F.col("cut").isNull() | (F.col("page_no") < F.col("cut"))).drop("cut")


def discovered_by_state(stubs: DataFrame, pages: DataFrame, states=C.FEED_STATES) -> DataFrame:
    """The same for a feed paged state after state, whose seen ids span all states.

    A row past one state's cut must not hide its id in a later state. An id is one row with the
    first page it stands on in each of its few states; given the cuts, it is new on those pages
    that no page kept in an earlier state hides. Cuts follow from counts of new ids per page, and
    are right for one more state with every round, so rounds end when no cut moves. To the
    driver comes one number per feed and state.
    """
    order = F.array(*map(F.lit, states))
    place = F.array_position(order, F.col("state")).cast("int")
    firsts = written(first_seen_rows(stubs.filter(F.col("state").isin(*states)), "page_no", "pos", key=("source", "source_listing_id", "state")), "stubs-by-state")
    stop = F.struct(place.alias("place"), F.col("page_no").cast("int").alias("page"))
    ids = written(firsts.groupBy("source", "source_listing_id").agg(F.array_sort(F.collect_list(stop)).alias("stops")), "ids-by-state")
    asked = written(pages.filter(F.col("state").isin(*states)).groupBy(
        "source", place.alias("place"), F.col("page_no").cast("int").alias("page")).agg(F.min("ok").alias("ok")), "pages-by-state")

    def kept(stop, cuts: str):
        cut = F.get(cuts, stop["place"] - 1)
        return cut.isNull() | (stop["page"] < cut)

    def with_cuts(rows: DataFrame) -> DataFrame:
        table = [(source, [cuts.get((source, i + 1)) for i in range(len(states))]) for source in {s for s, _ in cuts}]
        known = rows.sparkSession.createDataFrame(table, "source string, cuts array<int>")
        return rows.join(known, "source", "left")

    cuts: dict[tuple[str, int], int] = {}
    for _ in states:
        shown = with_cuts(ids)
        # The first page kept hides the id in every later state.
        hidden = F.array_position(F.transform("stops", lambda s: kept(s, "cuts")), True).cast("int")
        until = F.when(hidden > 0, hidden).otherwise(F.size("stops"))
        new = shown.select("source", F.explode(F.slice("stops", F.lit(1), until)).alias("s")).groupBy(
            "source", F.col("s.place").alias("place"), F.col("s.page").alias("page")).agg(F.count("*").alias("n_new"))
        ends = asked.join(new, ["source", "place", "page"], "left").filter(~F.col("ok") | F.col("n_new").isNull())
        found = {(r.source, r.place): r.cut for r in ends.groupBy("source", "place").agg(F.min("page").alias("cut")).collect()}
        if found == cuts:
            break
        cuts = found
    owner = F.get(F.filter("stops", lambda s: kept(s, "cuts")), F.lit(0))
    own = with_cuts(ids).select("source", "source_listing_id", owner.alias("own")).filter(F.col("own").isNotNull())
    own = own.select("source", "source_listing_id", F.get(order, F.col("own.place") - 1).alias("state"))
    return firsts.join(own, ["source", "source_listing_id", "state"], "left_semi").select(*stubs.columns)


def coverage(
    pages: DataFrame, cuts: DataFrame, start: int = 1, missing_page_ends: bool = False
) -> DataFrame:
    """Per feed: was everything listed seen, did any page arrive, and where to go on.

    ``pages(source, page_no, http_status, limit_page)``; a page past the cut was never
    asked for. With ``missing_page_ends`` a 404 is the regular end of a listing, else it
    makes coverage partial. The next checkpoint is the first page not fetched.
    """
    asked = pages.join(cuts, "source", "left").filter(
        F.col("cut").isNull() | (F.col("page_no") <= F.col("cut"))
    )
    ok = F.col("http_status") == 200
    failed = ~ok & (F.col("http_status") != 404) if missing_page_ends else ~ok
    walked = ok & (F.col("cut").isNull() | (F.col("page_no") < F.col("cut")))
    out = asked.groupBy("source").agg(
        F.coalesce(F.max(F.when(walked, F.col("page_no"))), F.lit(start - 1)).alias("last_page"),
        F.count_if(ok).alias("pages_ok"),
        (F.count_if(failed) > 0).alias("any_failed"),
        F.min(F.when(failed, F.col("page_no"))).alias("first_failed"),
        F.max(F.when(walked, F.col("page_no") >= F.col("limit_page"))).alias("hit_limit"),
    )
    complete = ~(F.col("any_failed") | F.coalesce(F.col("hit_limit"), F.lit(False)))
    return out.select(
        "source",
        complete.alias("coverage_complete"),
        (F.col("pages_ok") > 0).alias("success"),
        F.when(~complete, F.coalesce("first_failed", F.col("last_page") + 1)).cast("string").alias("next_checkpoint"),
    )


def frontier(feeds: DataFrame) -> DataFrame:
    """Pages to ask for next, from ``(name, search_url, states, max_pages, checkpoint)``.

    A feed without states is resumed at its page checkpoint, page one always included so
    that newly listed items are met again. A feed with states resumes at "index:page".
    """
    parts = F.split(F.coalesce("checkpoint", F.lit("")), ":")
    by_state = F.size("states") > 0
    at_state = F.when(by_state, F.coalesce(X.leading_int(F.get(parts, F.lit(0))), F.lit(0))).otherwise(0)
    at_page = F.coalesce(X.leading_int(F.when(by_state, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))), F.lit(1))
    listed = F.when(by_state, F.col("states")).otherwise(F.array(F.lit(None).cast("string")))
    rows = feeds.withColumn("_at_state", at_state).withColumn("_at_page", at_page).select(
        "*", F.posexplode(listed).alias("state_no", "state")
    ).filter(F.col("state_no") >= F.col("_at_state"))
    first = F.when(F.col("state_no") == F.col("_at_state"), F.col("_at_page")).otherwise(F.lit(1))
    last = F.when(by_state, F.col("max_pages")).otherwise(F.col("_at_page") + F.col("max_pages") - 1)
    numbers = F.when(first <= last, F.sequence(first, last.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    numbers = F.when(~by_state & (first > 1), F.concat(F.array(F.lit(1).cast("bigint")), numbers)).otherwise(numbers)
    page = F.col("page_no")
    url = F.when(
        by_state,
        F.when(page == 1, F.concat_ws("/", "search_url", "state")).otherwise(
            F.concat(F.concat_ws("/", "search_url", "state"), F.lit("/page-"), page.cast("string"))
        ),
    ).otherwise(
        F.when(page == 1, F.col("search_url")).otherwise(F.concat("search_url", F.lit("?page="), page.cast("string")))
    )
    return rows.withColumn("page_no", F.explode(numbers)).select(
        F.col("name").alias("source"), "state", F.col("page_no").cast("int").alias("page_no"), url.alias("url")
    )


def run_counts(stubs: DataFrame, known: DataFrame) -> DataFrame:
    """Per feed: rows kept this run and how many of them were not stored before."""
    stored = known.select("id", F.lit(True).alias("_known"))
    return (
        stubs.withColumn("id", listing_id())
        .join(stored, "id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("checked"), F.count_if(F.col("_known").isNull()).alias("new_listings"))
    )
