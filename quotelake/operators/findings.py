"""What pages and stores hold: press items dated by their block, names of deposits, publication pages proved by their content, applications matched with their signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import arrays, dates, html, rules, text
from quotelake.functions import vocabulary as V
from quotelake.operators.campaigns import date_in_url


def _folded(words: Column) -> Column:
    return text.fold(text.collapse(words))


def link_blocks(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page, page_url, url, title, start, block): each link of each page with the text of its nearest block.

    The nearest block is the innermost article or list item around the link, else the element right around it. Links meet the blocks of their own page by containment of ranges
    within the page's row, so nothing is shuffled and each page is parsed once. Null pages hold no link.
    """
    ranges = html.page_ranges.asNondeterministic()  # or the filter that goes before an explode would parse again
    parsed = pages.select(page, F.col(url).alias("page_url"), ranges(F.col(body), F.col(url)).alias("r"))

    def with_block(link: Column) -> Column:
        around = F.filter("r.blocks", lambda k: (k["start"] <= link["start"]) & (k["end"] >= link["end"]))
        nearest = F.array_max(F.transform(around, lambda k: F.struct(k["item"].alias("item"), k["start"].alias("start"), (-k["end"]).alias("back"))))
        words = arrays.let(nearest, lambda k: F.substring(F.col("r.text"), k["start"] + 1, F.least(-k["back"] - k["start"], F.lit(2000))))
        return F.struct(link["url"].alias("url"), link["text"].alias("title"), link["start"].alias("start"), words.alias("block"))

    return parsed.select(page, "page_url", F.explode(F.transform("r.links", with_block)).alias("l")).select(page, "page_url", "l.*")


def press_in_blocks(pages: DataFrame, as_of: Column, prefix: str | None = None, page: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page, page_url, url, title, published, published_from) of press lists: the longest text of each address is its title (of equals the first), its date the first in the link's
    block (``lista``), else the one in the address (``url``). With a ``prefix`` of paths shorter titles count too; without, list pages and documents don't."""
    rows = link_blocks(pages, page, url, body).withColumn("url", text.canonical_url(F.col("url")))
    path = text.url_path(F.regexp_replace("url", "[?#].*$", ""))
    long = F.length("title") >= (8 if prefix else 15)
    fits = path.startswith(prefix) if prefix else ~F.col("url").rlike(r"[?&]page=|/page/\d|\.(pdf|docx?|xlsx?)([?#]|$)") & (F.regexp_replace(path, "/+$", "") != "")
    own = text.url_host(F.col("url")) == text.url_host(F.col("page_url"))
    rows = rows.where(long & fits & own & (F.col("url") != text.canonical_url(F.col("page_url"))))
    best = rows.groupBy(page, "page_url", "url").agg(F.max_by(F.struct("title", "block"), F.struct(F.length("title"), -F.col("start"))).alias("b"))

    def dated(words: Column) -> Column:
        return arrays.let(dates.first_date(words, F.year(as_of) + dates.YEARS_AHEAD), lambda d: F.when(d["precision"] == "day", d["date"]))

    days = F.struct(arrays.let(F.left(_folded(F.coalesce("b.block", F.lit(""))), F.lit(400)), dated).alias("listed"), date_in_url(F.col("url")).alias("own"))
    origin = lambda d: F.when(d["listed"].isNotNull(), "lista").when(d["own"].isNotNull(), "url")
    found = arrays.let(days, lambda d: F.struct(F.coalesce(d["listed"], d["own"]).alias("published"), origin(d).alias("published_from")))
    return best.select(page, "page_url", "url", F.left("b.title", F.lit(300)).alias("title"), found.alias("f")).select(page, "page_url", "url", "title", "f.published", "f.published_from")


def deposit_names(pages: DataFrame, page: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(page, name): the deposits and savings accounts that a page names: in headings, in short links, and by the patterns of names in its text.

    Bare words and what is no name (questions, menu phrases, long sentences) go; of names that are one without case and marks the longest stays, of equals the first in code
    point order. Pages of more banks, or a bank's pages to some depth, are grouped by ``page``.
    """
    parsed = pages.select(page, html.page_ranges(F.col(body), F.col(url)).alias("r"))
    about = lambda w: _folded(w).rlike(V.DEPOSIT_WORDS)
    headings = F.filter("r.headings", lambda h: F.length(h).between(4, 79) & about(h))
    links = F.filter(F.transform("r.links", lambda x: x["text"]), lambda t: F.length(t).between(4, 59) & about(t))
    named = F.flatten(F.array(*(F.regexp_extract_all(text.collapse(F.col("r.text")), F.lit(p), F.lit(0)) for p in V.DEPOSIT_NAMES)))
    rows = parsed.select(page, F.explode(F.concat(headings, links, named)).alias("name")).withColumn("name", F.trim("name"))
    key = _folded(F.col("name"))
    noise = F.col("name").contains("?") | (F.size(F.split("name", r"\s+")) > V.DEPOSIT_NAME_WORDS) | key.rlike(V.NO_DEPOSIT_NAME) | key.isin(*V.BARE_DEPOSITS)
    return rows.where(~noise & (F.col("name") != "")).groupBy(page, key.alias("key")).agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("name")).select(page, "name")


def publication_pages(links: DataFrame, hosts: DataFrame, pages: DataFrame) -> DataFrame:
    """(owner, url, points, verdict) of pages that may publish an owner's price lists, in two stages.

    Candidates are links (page_url, url, text) to the host of the owner (hosts: owner, host) whose text (2 points) or path (1 point) speaks of prices; documents don't count, and of
    one address the best link does. Each is then proved by its own content: pages (url, text) meet by canonical address, and the page must speak of prices itself: ``confirmat``,
    ``nu_mentioneaza``, or ``necitita`` for a page that isn't there.
    """
    bare = lambda c: text.canonical_url(F.regexp_replace(c, "[?#].*$", ""))
    host = lambda c: F.regexp_replace(text.url_host(c), r"^www\.", "")
    own = links.select(bare(F.col("url")).alias("url"), host(F.col("url")).alias("host"), F.left(_folded(F.coalesce("text", F.lit(""))), F.lit(90)).alias("words")).where(~F.lower("url").endswith(".pdf"))
    own = own.join(hosts.select("owner", host(F.concat(F.lit("https://"), F.regexp_replace("host", "^https?://", ""))).alias("host")), "host")
    path = text.fold(text.decoded(text.url_path(F.col("url"))))
    scored = own.withColumn("points", F.when(F.col("words").rlike(V.PRICE_SIGNS), 2).otherwise(0) + F.when(path.rlike(V.PRICE_SIGNS), 1).otherwise(0)).where("points > 0")
    candidates = scored.groupBy("owner", "url").agg(F.max("points").alias("points"))
    proof = pages.select(bare(F.col("url")).alias("url"), _folded(F.left(F.coalesce("text", F.lit("")), F.lit(20_000))).rlike(V.PRICE_PROOF).alias("ok"))
    seen = proof.groupBy("url").agg(F.bool_or("ok").alias("ok"))
    return candidates.join(seen, "url", "left").select("owner", "url", "points", F.when(F.col("ok"), "confirmat").when(F.col("ok").isNotNull(), "nu_mentioneaza").otherwise("necitita").alias("verdict"))


def best_publication_page(verdicts: DataFrame) -> DataFrame:
    """(owner, url): each owner's confirmed page with the most points, of equals the first address."""
    return verdicts.where("verdict = 'confirmat'").groupBy("owner").agg(F.min_by("url", F.struct(-F.col("points"), F.col("url"))).alias("url"))


def name_signs(slug: Column, name: Column, domains: Column) -> Column:
    """Words that must show at an application of a bank: its slug, its domains' first parts, its name's own words; of four letters at least."""
    roots = F.transform(F.coalesce(domains, F.array().cast("array<string>")), lambda d: F.split(F.regexp_replace(text.url_host(d), r"^www\.", ""), r"\.")[0])
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-zăâîșț]{4,})"), F.lit(1)), lambda w: ~w.isin(*V.COMMON_NAMES))
    every = F.concat(F.array(F.replace(slug, F.lit("-"), F.lit(""))), roots, words)
    return F.array_sort(F.array_distinct(F.filter(every, lambda w: F.length(w) >= 4)))


def matched_application(results: DataFrame, banks: DataFrame) -> DataFrame:
    """(slug, app_id, sign, sign_in, market_in, sure): each bank's application among its store search results, with the signs that prove it.

    results: slug (the bank that was searched for, the block in which candidates meet), rank, app_id, seller, bundle, title, genres, languages. A candidate needs one of the bank's
    signs in seller, bundle or title, and a category of finance or business. It is sure if seller, bundle or title name the country, or the application speaks its language; the
    first sure one by rank wins, else the first unsure one, left for a person to confirm. Banks without any are missing.
    """
    signs = banks.select("slug", name_signs(F.col("slug"), F.col("name"), F.col("domains")).alias("signs"))
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("seller", "bundle", "title")}
    rows = results.join(signs, "slug")
    found = F.get(F.filter("signs", lambda s: F.contains(low["seller"], s) | F.contains(low["bundle"], s) | F.contains(low["title"], s)), F.lit(0))
    rows = rows.withColumn("sign", found).where(F.col("sign").isNotNull() & F.arrays_overlap(F.coalesce("genres", F.array().cast("array<int>")), F.array(*map(F.lit, V.APP_GENRES))))
    where = rules.first_true([(c, F.contains(low[c], F.col("sign"))) for c in ("seller", "bundle", "title")])
    market = rules.first_true([(c, F.coalesce(F.col(c), F.lit("")).rlike(V.HOME_MARKET)) for c in ("bundle", "title", "seller")] + [("languages", F.exists(F.coalesce("languages", F.array().cast("array<string>")), lambda x: F.upper(x) == V.HOME_LANGUAGE))])
    rows = rows.withColumns({"sign_in": where, "market_in": market, "sure": market.isNotNull()})
    best = F.min_by(F.struct("app_id", "sign", "sign_in", "market_in", "sure"), F.struct((~F.col("sure")).alias("late"), "rank", "app_id"))
    return rows.groupBy("slug").agg(best.alias("b")).select("slug", "b.*")
