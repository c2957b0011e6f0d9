"""Raw records to canonical observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.functions import concepts as C
from quotelake.functions import numbers, rules, text
from quotelake.functions import vocabulary as V

_PERCENT = ("comision_procent", "rata", "nominala", "dae", "marja_ircc", "marja_euribor", "marja_robor", "marja_fixa", "ircc_valoare", "euribor_valoare", "robor_valoare", "cashback", "rate_fara_dobanda")


def channel(words: Column) -> Column:
    return rules.first_match(words, V.insensitive(V.CHANNELS))


def concept(name: Column, path: Column, context: Column, table: list[tuple[str, str]], least_words: int = 3) -> Column:
    """The concept of a service by an ordered table of (label, pattern): by its name; a name of fewer than ``least_words`` words is a fragment and also asks the
    levels of its section path, the nearest first, each together with the name, and last the context."""
    own = rules.first_match(name, table)
    levels = F.reverse(F.split(F.coalesce(path, F.lit("")), " > "))
    by_level = F.get(F.filter(F.transform(levels, lambda x: rules.first_match(F.concat_ws(" ", name, x), table)), lambda x: x.isNotNull()), F.lit(0))
    fragment = F.size(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+")) < least_words
    return F.coalesce(own, F.when(fragment, F.coalesce(by_level, rules.first_match(F.concat_ws(" ", name, context), table))))


_IU = "(?iuU)"


def clean_label(label: Column) -> Column:
    """A label with comma letters, a known misspelling mended, and the account for payments called an account."""
    text_ = F.regexp_replace(text.cedilla_to_comma(F.coalesce(label, F.lit(""))), r"(?iuU)\badministar", "administrar")
    return F.regexp_replace(text_, _IU + C.PAYMENT_ACCOUNT, " cont ")


def is_fragment(name: Column) -> Column:
    """Does a label not say by itself which service it is about? Notes, sentences and services without a concept do."""
    whole = name.rlike(_IU + C.NOTE) | name.rlike(_IU + C.UNNAMED) | (name.rlike("(?U)" + C.SENTENCE) & (F.size(F.split(F.trim(name), r"\s+")) >= C.SENTENCE_WORDS))
    return ~whole & ((F.length(name) < C.FRAGMENT_LENGTH) | name.rlike(_IU + C.FRAGMENT))


def service_concept(service: Column, section: Column, column: Column, detail: Column, source: Column) -> Column:
    """The concept of a fee by the ordered table of ``concepts``: by the service's own name; a fragment also asks the table column, then its
    section's levels from the innermost out, then all context. A label that lists its content is a package's; a transfer under standing orders is one of those."""
    table = [(label, _IU + pattern) for label, pattern in C.CONCEPTS]
    whole = clean_label(service)
    name = F.regexp_replace(whole, _IU + C.CONTENT_LIST, "")
    levels = F.split(clean_label(section), " > ")
    depths = F.when(F.size(levels) > 1, F.sequence(F.size(levels), F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    steps = F.concat(F.array(F.concat_ws(" ", name, clean_label(column))), F.transform(depths, lambda k: F.concat_ws(" ", name, F.array_join(F.slice(levels, k, F.size(levels)), " > "))))
    context = F.concat_ws(" ", name, clean_label(section), clean_label(column), clean_label(detail), clean_label(source))
    around = F.get(F.filter(F.transform(F.array_append(steps, context), lambda x: rules.first_match(x, table)), lambda x: x.isNotNull()), F.lit(0))
    found = F.coalesce(rules.first_match(name, table), F.when(is_fragment(name), around))
    found = F.coalesce(found, F.when(whole.rlike(_IU + C.CONTENT_LIST), "administrare_cont"))
    return F.when((found == "transfer_credit") & F.coalesce(section, F.lit("")).rlike(_IU + C.STANDING_ORDER), "plata_programata").otherwise(found)


def destination(concept: Column, name: Column, context: Column) -> Column:
    """Where money goes, for concepts that move it: what the name says beats the context; what excludes each other gives none."""
    own, around = (rules.all_matches(F.coalesce(c, F.lit("")), V.insensitive(V.DESTINATIONS)) for c in (name, context))
    found = F.when(F.size(own) > 0, own).otherwise(around)
    return F.when(concept.isin(*V.WITH_DESTINATION), rules.most_specific(found, V.DESTINATION_CHAIN, V.DESTINATION_EXCLUSIVE))


def rate_product(words: Column, page: Column) -> Column:
    """The product a rate belongs to: by its own text, else by its page's."""
    return F.coalesce(rules.first_match(words, V.insensitive(V.PRODUCTS)), rules.first_match(page, V.insensitive(V.PRODUCTS)))


def rate_segment(words: Column, page: Column, category: Column) -> Column:
    """The segment of a rate by its text and its page together; a page of the business category without one is for legal persons."""
    found = rules.first_match(F.concat_ws(" ", words, page), V.insensitive(V.RATE_SEGMENTS))
    return F.coalesce(found, F.when(category == "business", "pj"))


def canonical_product(words: Column, page: tuple[Column, ...], category: Column) -> Column:
    """Struct (product, segment) of a rate from the web: by its own text, which is the evidence at hand, else by its page (title, address, category); dashes are blanks."""
    plain = lambda c: F.translate(F.coalesce(c, F.lit("")), "-", " ")
    text_, around = plain(words), F.concat_ws(" ", *map(plain, page), plain(category))
    return F.struct(rate_product(text_, around).alias("product"), rate_segment(text_, around, category).alias("segment"))


def name_segment(name: Column) -> Column:
    """The segment in a document's name; letters on either side don't count as a border."""
    return rules.first_match(F.lower(name), V.NAME_SEGMENTS)


def slug(name: Column) -> Column:
    out = F.lower(F.trim(name))
    for alias, canonical in V.ALIASES.items():
        out = F.when(out == alias, F.lit(canonical)).otherwise(out)
    return out


def unit(kind: Column, currency: Column, value: Column) -> Column:
    code = F.upper(F.trim(currency))
    known = None
    for k, v in V.UNITS.items():
        known = F.when(code == k, F.lit(v)) if known is None else known.when(code == k, F.lit(v))
    return F.when(value.isNull(), F.lit(None)).when(kind.isin(*_PERCENT), "procent").when(kind == "gratuit", "lei").otherwise(known.otherwise("altele"))


def field(concept: Column, role: Column) -> Column:
    base = F.coalesce(F.nullif(concept, F.lit("")), F.lit("comision"))
    return F.when(role == "conditie", "conditie").when(role.isin("min", "max"), F.concat(base, F.lit("_"), role)).otherwise(base)


def product(kind: Column, category: Column) -> Column:
    chain = F.when((kind == "rate_fara_dobanda") & (category == "conturi_carduri"), "card-de-credit").when(kind == "rate_fara_dobanda", "dobanda-nominala")
    for k, v in V.RATE_PRODUCT.items():
        chain = chain.when(kind == k, v)
    return chain.otherwise("comisioane")


def scenario(*parts: Column) -> Column:
    """The parts that are known, joined by ``|``."""
    return F.nullif(F.array_join(F.filter(F.array(*(p.cast("string") for p in parts)), lambda x: x.isNotNull() & (x != "")), "|"), F.lit(""))


def implausible(unit_: Column, category: Column, value: Column) -> Column:
    limit = F.when(unit_ == "procent", F.coalesce(*(F.when(category == c, F.lit(V.LIMITS[c])) for c in ("depozite", "credite", "conturi_carduri")), F.lit(V.LIMITS["procent"]))).otherwise(F.lit(V.LIMITS["suma"]))
    return F.coalesce(value > limit, F.lit(False)) & (unit_ != "altele")


def normalise(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, rejected rows with ``reject_reason``) of raw records (``schemas.RAW_RECORD``)."""
    c = F.col
    reason = F.when(F.coalesce(F.trim("banca"), F.lit("")) == "", "no_bank").when(F.coalesce(F.trim("sursa"), F.lit("")) == "", "no_source").when(c("valoare").isNull() & c("valoare_text").isNull(), "no_value")
    marked = raw.withColumn("reject_reason", reason)
    u = unit(c("tip"), c("moneda"), c("valoare"))
    odd = implausible(u, c("categorie"), c("valoare"))
    good = marked.where("reject_reason is null").select(
        slug(c("banca")).alias("banca"),
        "sursa",
        product(c("tip"), c("categorie")).alias("produs"),
        field(c("concept"), c("rol")).alias("camp"),
        scenario(c("categorie"), c("segment"), c("canal"), c("destinatie"), c("perioada"), c("nr_rate")).alias("cod_scenariu"),
        c("valoare").alias("valoare_num"),
        "valoare_text",
        u.alias("unitate"),
        F.upper("moneda").alias("valuta"),
        F.left("citat", F.lit(500)).alias("citat"),
        numbers.confidence(c("incredere"), c("stare_data")).alias("confidence"),
        (F.coalesce("ambiguu", F.lit(False)) | odd).alias("ambiguu"),
        F.when(odd & c("motiv_ambiguu").isNull(), "valoare neplauzibila").otherwise(c("motiv_ambiguu")).alias("motiv_ambiguu"),
        F.left("serviciu", F.lit(300)).alias("serviciu"),
        *("sectiune", "conditie", "frecventa", "detaliu", "pagina", "data_vigoare", "stare_data", "coloana"),
    )
    return good, marked.where("reject_reason is not null")


def validate(rates: DataFrame, index: DataFrame, as_of: Column, tolerance: float = 0.05, stale: float = 0.5, year_typos: bool = False) -> DataFrame:
    """Adds verdict and why to rates (banca, kind, value, text, period_end): outside its interval SUSPECT, its declared period over SURSA_VECHE; a stated index value
    near the index in force is VALID, near an older quarter's SURSA_VECHE, far from all SUSPECT, and NEVERIFICAT without a reference. ``index`` is (kind, value, valid_from, valid_to).
    ``year_typos``: a stated value whose declared period is over but that is the index in force, and not nearer to the declared period's, has a wrong year beside it and is VALID."""
    limit = F.create_map(*(F.lit(x) for k, (a, b) in V.INTERVALS.items() for x in (k, f"{a},{b}")))
    ends = F.split(limit[F.col("kind")], ",")
    outside = ~F.col("value").between(ends[0].cast("double"), ends[1].cast("double"))
    current_ = index.where((F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of))).groupBy("kind").agg(F.max_by("value", "valid_from").alias("__now"))
    past = index.where(F.col("valid_to") < as_of).groupBy("kind").agg(F.collect_set("value").alias("__past"))
    # a kind has an entry for each quarter: a short array
    series = index.groupBy("kind").agg(F.collect_list(F.struct("valid_from", "valid_to", "value")).alias("__series"))
    joined = rates.join(current_, "kind", "left").join(past, "kind", "left").join(series, "kind", "left")
    declared = F.get(F.filter("__series", lambda q: F.col("period_end").between(q["valid_from"], F.coalesce(q["valid_to"], F.col("period_end")))), F.lit(0))["value"]
    gap = F.abs(F.col("value") - F.col("__now"))
    older = F.exists(F.coalesce("__past", F.array().cast("array<double>")), lambda v: F.abs(v - F.col("value")) <= tolerance)
    stated = F.col("kind").endswith("_valoare")
    said = lambda verdict, why=None: F.struct(F.lit(verdict).alias("verdict"), F.lit(why).cast("string").alias("why"))
    typo = F.lit(year_typos) & stated & (gap <= tolerance) & ~F.coalesce(F.abs(F.col("value") - declared) < gap, F.lit(False))
    verdict = (
        F.when(F.coalesce(outside, F.lit(False)), said("SUSPECT", "outside_interval"))
        .when((F.col("period_end") < as_of) & F.coalesce(typo, F.lit(False)), said("VALID", "year_typo"))
        .when(F.col("period_end") < as_of, said("SURSA_VECHE", "period_over"))
        .when(~stated, said("VALID"))
        .when(F.col("__now").isNull(), said("NEVERIFICAT", "no_reference"))
        .when(gap <= tolerance, said("VALID"))
        .when(older, said("SURSA_VECHE", "older_quarter"))
        .when(gap > stale, said("SUSPECT", "far_from_index"))
        .otherwise(said("SUSPECT", "off_index"))
    )
    return joined.withColumn("__v", verdict).select(*rates.columns, F.col("__v.verdict").alias("verdict"), F.col("__v.why").alias("why"))


def derived_totals(rates: DataFrame, index: DataFrame, as_of: Column) -> DataFrame:
    """The rates and, for each margin over an index in force, a nominal rate that adds both, marked derived."""
    now = index.where((F.col("valid_from") <= as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of))).groupBy("kind").agg(F.max_by("value", "valid_from").alias("__now"))
    base = rates.withColumn("derived", F.lit(False))
    margin = rates.where("kind in ('marja_ircc', 'marja_robor', 'marja_euribor')").withColumn("__k", F.concat(F.regexp_replace("kind", "^marja_", ""), F.lit("_valoare")))
    total = margin.join(now.withColumnRenamed("kind", "__k"), "__k").withColumns({"value": F.round(F.col("value") + F.col("__now"), 4), "kind": F.lit("nominala"), "derived": F.lit(True)})
    return base.unionByName(total.select(base.columns))


def interval_ends(rates: DataFrame) -> DataFrame:
    """Rates with a stated interval get a second row with its upper end."""
    top = rates.where("high is not null and high <> value").withColumn("value", F.col("high"))
    return rates.unionByName(top)


def page_invariants(rates: DataFrame) -> DataFrame:
    """Rates (url, kind, value, verdict) with the verdict SUSPECT on effective rates of a page all of which are below all its nominal ones: they include the fees, so
    that can't be. One aggregate for each page, joined back."""
    page = rates.groupBy(F.col("url").alias("__u")).agg(F.max(F.when(F.col("kind") == "dae", F.col("value"))).alias("__dae"), F.min(F.when((F.col("kind") == "nominala") & (F.col("value") > 0), F.col("value"))).alias("__nominal"))
    odd = page.where("__dae < __nominal").select("__u")
    joined = rates.join(odd, F.col("url") == F.col("__u"), "left")
    return joined.withColumn("verdict", F.when(F.col("__u").isNotNull() & (F.col("kind") == "dae"), "SUSPECT").otherwise(F.col("verdict"))).drop("__u")


def implied_verdicts(rates: DataFrame, now: Column, older: Sequence[float], tolerance: float = 0.05, stale: float = 0.5) -> DataFrame:
    """Rates (text, verdict) with the verdict SURSA_VECHE where the index that the line's total and margin imply is an older quarter's, or far from the one in
    force (``now``), unless they had another verdict than OK. Adds implied."""
    index = numbers.implied_index(F.col("text"))
    off = (F.abs(index - now) > tolerance) & (F.exists(F.array(*map(F.lit, older)), lambda v: F.abs(v - index) <= tolerance) | (F.abs(index - now) > stale))
    return rates.withColumns({"implied": index, "verdict": F.when((F.col("verdict") == "OK") & F.coalesce(off, F.lit(False)), "SURSA_VECHE").otherwise(F.col("verdict"))})


def consistent_margins(rates: DataFrame, now: Column, tolerance: float = 0.1) -> DataFrame:
    """(url, kind, value, consistent): margins over the index in force whose sum with it is one of their page's nominal rates. Rates meet in cells of the tolerance's width."""
    cell = lambda c: F.floor(c / F.lit(tolerance)).cast("long")
    nominal = rates.where("kind = 'nominala'").select(F.col("url").alias("__u"), F.col("value").alias("__n"), F.explode(F.sequence(cell(F.col("value")) - 1, cell(F.col("value")) + 1)).alias("__c")).distinct()
    margins = rates.where("kind = 'marja_ircc'").select("url", "kind", "value").distinct().withColumn("__total", F.col("value") + now)
    met = margins.join(nominal, (F.col("url") == F.col("__u")) & (cell(F.col("__total")) == F.col("__c")) & (F.abs(F.col("__n") - F.col("__total")) <= tolerance + 1e-9), "left_semi").select("url", "value")
    found = margins.join(met.select(F.col("url").alias("__u"), F.col("value").alias("__v")).distinct(), (F.col("url") == F.col("__u")) & (F.col("value") == F.col("__v")), "left")
    return found.select("url", "kind", "value", F.col("__u").isNotNull().alias("consistent"))
