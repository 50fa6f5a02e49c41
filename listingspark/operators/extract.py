"""Typed listing fields with provenance from page structure, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..sources.pages import PARTS, STRUCTURE
from ..functions.numbers import PRICE_BOX_PATTERN, PRICE_PATTERN, displayed_price, exact_price_value, first_number, whole_number

# Where listing text ends, and the patterns of its fields.
END_MARKERS = r"(?iU)\b(?:Seller Details|Similar Used Cars|Recommended Cars|You May Also Like)\b"
YEAR = r"\b((?:19|20)\d{2})\b"
MILEAGE = r"(?i)\b([\d,]+)\s*(?:kilometres|kilometers|kms?|KM)\b"
FUEL = r"(?i)\b(PHEV|Petrol|Diesel|Hybrid|CNG|Electric|LPG)\b"
TRANSMISSION = r"(?i)\b(Automatic|Manual|CVT)\b"
ENGINE = r"(?i)\b(\d{2,5})\s*cc\b"
CURRENT_PRICE = r"Current\s+Price\s*:?[\s\S]{0,100}?" + PRICE_PATTERN
UPPER_FUELS = ("CNG", "LPG", "PHEV")
KNOWN_FUELS = ("Petrol", "Diesel", "Hybrid", "CNG", "Electric", "LPG", "PHEV")
PRODUCT_TYPES = ("Product", "Car", "Vehicle")
LEAST_PRICE = 10_000
SCHEMA_VERSION = 2
REGISTERED = r"(?i)^(?:Registered(?:\s+(?:in|year))?|Registration(?:\s+year)?)\s*[:\-]?\s*((?:19|20)\d{2})[.!]?$"
FIRST_REGISTERED = (
    r"(?i)^First\s+(?:registration\s+in\s+([A-Za-z ]+)|(Pakistan)\s+registration)(?:\s+year)?\s*:\s*((?:19|20)\d{2})[.!]?$"
)
DATE_LABELS = (("last updated", "updated"), ("posted on", "posted"), ("date added", "posted"))
DATE_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-M-d")
REGISTRATION_SOURCE = "explicit_seller_registration_statement"


def listing_links(
    pages: DataFrame, *, key: str, base: str, path_pattern: str, hosts: Sequence[str] | None = None, html: str = "html",
) -> DataFrame:
    """Links of each page that lead to listings, canonical, at their first position.

    Relative links resolve against ``base``; only ``hosts`` (by default the base's own) and
    paths that match the whole pattern count.
    """
    allowed = [host.lower() for host in hosts or [base.split("//", 1)[1].split("/", 1)[0]]]
    visible = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    attribute = r"""(?is)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(visible, F.lit(attribute), F.lit(1))).alias("position", "__h"))
    href = F.replace(F.trim(F.regexp_replace("__h", r"""^["']|["']$""", "")), F.lit("&amp;"), F.lit("&"))
    absolute = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit(base.split("//", 1)[0]), href))
        .when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href))
        .otherwise(F.concat(F.lit(base + "/"), href))
    )
    bare = F.regexp_replace(absolute, r"[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://(?:[^/@]*@)?([^/:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[A-Za-z]+://[^/]*(/.*)?$", 1), "/+$", "")
    kept = found.select(key, "position", host.alias("__host"), path.alias("__path")).where(
        F.col("__host").isin(*allowed) & F.col("__path").rlike(f"(?i)^(?:{path_pattern})$")
    )
    return kept.groupBy(key, F.concat(F.lit(base), "__path").alias("url")).agg(F.min("position").cast("bigint").alias("position"))


def _clean(c: Column) -> Column:
    return F.nullif(text.squash(c), F.lit(""))


def primary_text(page: Column | dict[str, Column]) -> Column:
    """Visible text after the title, up to seller details or recommendations."""
    title = F.coalesce(page["title"], F.lit(""))
    at = F.position(title, page["text"])
    following = F.when((title != "") & (at > 0), F.substr(page["text"], at + F.length(title))).otherwise(page["text"])
    return F.get(F.split(following, END_MARKERS, 2), F.lit(0))


def _match_end(source: Column, pattern: str) -> Column:
    whole = F.regexp_extract(source, f"({pattern})", 1)
    return F.regexp_instr(source, F.lit(pattern)) + F.length(whole)


# The pieces of a page from which each column is read; the others need the url alone.
_BODY, _HEADED = ("title", "text"), ("title", "objects")
_READ_FROM = {
    "car_title": ("title",), "year": _BODY, "mileage_km": _BODY, "fuel": _BODY, "transmission": _BODY, "engine_cc": _BODY,
    **dict.fromkeys(("price_pkr", "price_source", "price_displayed", "missing_fields", "parse_status"), (*_BODY, "price_box")),
    **dict.fromkeys(("make", "model", "variant", "identity_status"), _HEADED),
    **dict.fromkeys(("assembly", "listing_date", "listing_date_type", "listing_date_displayed", "listing_date_label"), ("details",)),
    **dict.fromkeys(("body_type", "body_type_source"), ("details", "objects")),
    **dict.fromkeys([f"registration_{name}" for name in ("year", "year_meaning", "year_source", "year_status", "statements")], ("comments",)),
    "field_provenance": PARTS,
}


def parts_of(*columns: str) -> list[str]:
    """The pieces of a page that ``with_structure`` must read for these columns of ``extract_listings``."""
    needed = {part for name in columns for part in _READ_FROM.get(name, ())}
    return [part for part in PARTS if part in needed]


def extract_listings(structured: DataFrame, *, url: str = "url") -> DataFrame:
    """Fields, completeness and provenance of every page that went through ``with_structure``.

    Where only some pieces were read, the columns that need others are left out.
    """
    read = structured.schema["page"].dataType.names if "page" in structured.columns else []
    page = {part: F.col("page")[part] if part in read else F.lit(None).cast(STRUCTURE[part].dataType) for part in PARTS}
    scoped = structured.withColumns({
        "__title": F.coalesce(page["title"], F.lit("")), "__primary": primary_text(page), "__path": text.url_path(F.col(url)),
        "__product": listing_product(page["objects"], F.col(url)),
    })
    scoped = scoped.withColumns({
        "__start": F.left("__primary", F.lit(3500)),
        "__title_year": F.try_element_at(F.regexp_extract_all("__title", F.lit(YEAR), F.lit(1)), F.lit(-1)),
        "__body_year": F.try_element_at(F.regexp_extract_all(F.left("__primary", F.lit(1000)), F.lit(YEAR), F.lit(1)), F.lit(-1)),
    })
    start = F.col("__start")
    has_mileage = start.rlike(MILEAGE)
    near = F.when(has_mileage, F.substr("__primary", _match_end(start, MILEAGE), F.lit(180))).otherwise(F.left("__primary", F.lit(700)))
    # Casing reads the slug several times; as a column of its own it is searched for once.
    slug = F.nullif(F.regexp_extract("__path", r"(?i)-for-sale-in-(.+)-\d+$", 1), F.lit(""))
    scoped = scoped.withColumns({"__near": near, "__slug": slug, **price_columns(page["price_box"], F.col("__primary"), start)})
    fuel = F.nullif(F.regexp_extract("__near", FUEL, 1), F.lit(""))
    transmission = F.nullif(F.regexp_extract("__near", TRANSMISSION, 1), F.lit(""))
    engine = F.nullif(F.regexp_extract(F.left("__primary", F.lit(4500)), ENGINE, 1), F.lit(""))
    listing_id = F.nullif(F.regexp_extract("__path", r"-(\d+)$", 1), F.lit(""))
    fields = with_identity(scoped).withColumns({
        "listing_id": listing_id,
        "car_title": F.nullif("__title", F.lit("")),
        "year": F.coalesce("__title_year", "__body_year").cast("int"),
        "mileage_km": F.when(has_mileage, F.replace(F.regexp_extract(start, MILEAGE, 1), F.lit(","), F.lit("")).try_cast("bigint")),
        "fuel": F.when(F.upper(fuel).isin(*UPPER_FUELS), F.upper(fuel)).otherwise(F.initcap(fuel)),
        "transmission": F.initcap(transmission),
        "engine_cc": engine.try_cast("int"),
        "listing_city": text.city_from_slug(F.col("__slug")),
        "source_url": F.col(url),
        **detail_columns(page["details"], F.col("__body")),
        **registration_columns(page["comments"]),
        "collection_schema_version": F.lit(SCHEMA_VERSION),
    })
    missing = F.filter(F.array(*[
        F.when(F.col(column).isNull(), F.lit(name))
        for name, column in (("title", "car_title"), ("price_pkr", "price_pkr"), ("year", "year"), ("mileage_km", "mileage_km"))
    ]), lambda name: name.isNotNull())
    judged = fields.withColumn("missing_fields", F.array_join(missing, ", ")).withColumns({
        "parse_status": F.when(F.col("missing_fields") == "", F.lit("complete")).otherwise(F.lit("incomplete")),
        "field_provenance": provenance(),
    })
    unread = [name for name, parts in _READ_FROM.items() if not set(parts) <= set(read)]
    return judged.drop(*[name for name in judged.columns if name.startswith("__")], "page", *unread)


def price_columns(box: Column, primary: Column, start: Column) -> dict[str, Column]:
    """Price by falling authority: the main box alone, a stated current price, the first price.

    A box that shows no price gives none; no other text may stand in for it.
    """
    anywhere, current = f"(?iU){PRICE_PATTERN}", f"(?iU){CURRENT_PRICE}"
    stated = primary.rlike(current)
    value = F.when(box.isNotNull(), displayed_price(box)).when(stated, displayed_price(
        F.regexp_extract(primary, current, 0))).otherwise(displayed_price(start))
    shown = F.when(F.coalesce(box, F.lit("")) != "", box).when(stated & box.isNull(), F.regexp_extract(primary, current, 0)).when(
        box.isNull(), F.nullif(F.regexp_extract(start, anywhere, 0), F.lit("")))
    source = F.when(box.isNotNull(), F.lit("main_price_box")).when(stated, F.lit("explicit_current_price")).otherwise(
        F.lit("scoped_listing_text"))
    return {
        "price_pkr": F.when(value >= LEAST_PRICE, value),
        "price_source": source, "price_displayed": shown,
    }


# What any rule reads of a JSON-LD object, each value as its JSON text.
_OBJECT_FIELDS = (
    "@type", "brand", "model", "bodyType", "offers", "modelDate", "mileageFromOdometer", "vehicleEngine", "fuelType", "vehicleTransmission",
)
_OBJECT = T.StructType([T.StructField(name, T.StringType()) for name in _OBJECT_FIELDS])
_OFFERS = "array<struct<url:string,price:string>>"


def _as_list(value: Column) -> Column:
    """JSON text of a list, whether one object or a list was given."""
    return F.when(F.startswith(value, F.lit("{")), F.concat(F.lit("["), value, F.lit("]"))).when(F.startswith(value, F.lit("[")), value)


def read_objects(objects: Column) -> Column:
    """JSON-LD objects as structs of ``fields`` and ``offers``; every text is parsed once."""
    parsed = F.transform(objects, lambda item: F.from_json(item, _OBJECT))
    return F.transform(parsed, lambda item: F.struct(
        item.alias("fields"), F.from_json(_as_list(item["offers"]), _OFFERS).alias("offers")))


def listing_product(objects: Column, url: Column) -> Column:
    """The one distinct product object whose offer names this page (as ``read_objects`` gives it), or null."""
    def fits(item: Column) -> Column:
        kind = item["fields"]["@type"]
        kinds = F.when(F.startswith(kind, F.lit("[")), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
        typed = F.exists(kinds, lambda k: k.isin(*PRODUCT_TYPES))
        here = F.exists(item["offers"], lambda offer: text.url_key(offer["url"]) == text.url_key(url))
        return F.coalesce(typed & here, F.lit(False))

    matches = F.filter(read_objects(F.array_distinct(objects)), fits)
    # A list of the list of matches, kept where it has one: so the matches are an expression used once.
    single = F.filter(F.array(matches), lambda found: F.size(found) == 1)
    return F.get(F.get(single, F.lit(0)), F.lit(0))


def brand_name(fields: Column) -> Column:
    """The brand of an object, stated as a text or as an object with a name."""
    brand = fields["brand"]
    return F.when(F.startswith(brand, F.lit("{")), F.get_json_object(brand, "$.name")).otherwise(brand)


def with_identity(df: DataFrame) -> DataFrame:
    """Make and model of ``__product``; the variant is what the heading adds to them and the year."""
    fields = F.col("__product.fields")
    named = df.withColumns({
        "__make": _clean(brand_name(fields)), "__model": _clean(fields["model"]),
        "__body": _clean(fields["bodyType"]), "__heading": text.squash(F.col("__title")),
    })
    named = named.withColumns({
        "__known": F.col("__make").isNotNull() & F.col("__model").isNotNull(),
        "__prefix": F.lower(F.concat("__make", F.lit(" "), "__model")), "__suffix": F.concat(F.lit(" "), "__title_year"),
    })
    spare = F.length("__heading") - F.length("__prefix") - F.length("__suffix")
    named = named.withColumns({
        "__spare": spare, "__middle": F.substr("__heading", F.length("__prefix") + 1, spare),
    })
    fits = (
        (F.col("__spare") >= 0) & F.startswith(F.lower("__heading"), F.col("__prefix")) & F.endswith("__heading", F.col("__suffix"))
        & ((F.col("__middle") == "") | F.startswith("__middle", F.lit(" ")))
    )
    named = named.withColumn("__fits", F.coalesce(F.col("__known") & fits, F.lit(False)))
    return named.withColumns({
        "make": F.when(F.col("__known"), F.col("__make")), "model": F.when(F.col("__known"), F.col("__model")),
        "variant": F.when(F.col("__fits"), _clean(F.col("__middle"))),
        "identity_status": F.when(F.col("__fits"), F.lit("extracted_pending_review")).when(
            F.col("__known"), F.lit("family_extracted_variant_unmatched")).otherwise(F.lit("unmatched")),
    })


def detail_columns(details: Column, body: Column) -> dict[str, Column]:
    """Assembly, body type and displayed date from the label/value table."""
    labelled = F.map_from_entries(details)
    stated = lambda label: F.nullif(F.try_element_at(labelled, F.lit(label)), F.lit(""))
    shown = F.coalesce(*[stated(label) for label, _ in DATE_LABELS])
    kind, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, meaning in reversed(DATE_LABELS):
        kind = F.when(stated(name).isNotNull(), F.lit(meaning)).otherwise(kind)
        label = F.when(stated(name).isNotNull(), F.lit(name)).otherwise(label)
    parsed = F.coalesce(*[F.try_to_timestamp(shown, F.lit(pattern)) for pattern in DATE_FORMATS])
    return {
        "assembly": stated("assembly"),
        "body_type": F.coalesce(stated("body type"), body),
        "body_type_source": F.when(stated("body type").isNotNull(), F.lit("scroll_car_detail.body type")).when(
            body.isNotNull(), F.lit("url_matched_json_ld.bodyType")),
        "listing_date": parsed.cast("date"), "listing_date_type": kind,
        "listing_date_displayed": shown, "listing_date_label": label,
    }


def registration_columns(lines: Column) -> dict[str, Column]:
    """Registration year from full-line statements only; several values are a conflict."""
    def read(line: Column) -> Column:
        place = text.squash(F.concat(F.regexp_extract(line, FIRST_REGISTERED, 1), F.regexp_extract(line, FIRST_REGISTERED, 2)))
        meaning = F.when(line.rlike(REGISTERED), F.lit("unknown")).when(
            F.lower(place) == "pakistan", F.lit("first_pakistan_registration")).otherwise(F.lit("first_registration_other_jurisdiction"))
        year = F.when(line.rlike(REGISTERED), F.regexp_extract(line, REGISTERED, 1)).otherwise(F.regexp_extract(line, FIRST_REGISTERED, 3))
        return F.struct(year.try_cast("int").alias("year"), meaning.alias("meaning"))

    stating = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda line: line.rlike(REGISTERED) | line.rlike(FIRST_REGISTERED))
    values = F.array_distinct(F.transform(stating, read))
    single = F.size(values) == 1
    only = F.get(values, F.lit(0))
    any_stated = F.size(values) > 0
    return {
        "registration_year": F.when(single, only["year"]),
        "registration_year_meaning": F.when(single, only["meaning"]),
        "registration_year_source": F.when(any_stated, F.lit(REGISTRATION_SOURCE)),
        "registration_year_status": F.when(single, F.lit("extracted")).when(any_stated, F.lit("conflicting")).otherwise(F.lit("not_stated")),
        "registration_statements": F.when(any_stated, stating),
    }


def provenance() -> Column:
    """JSON document naming the rule behind each extracted field, keys in order."""
    def entry(condition: Column, **parts: Column) -> Column:
        return F.when(condition, F.struct(*[value.alias(name) for name, value in sorted(parts.items())]))

    has = lambda name: F.col(name).isNotNull()
    entries = {
        "assembly": entry(has("assembly"), source=F.lit("scroll_car_detail.assembly")),
        "body_type": entry(has("body_type"), source=F.col("body_type_source")),
        "listing_date": entry(
            has("listing_date_displayed"), source=F.concat(F.lit("scroll_car_detail."), "listing_date_label"),
            displayed=F.col("listing_date_displayed")),
        "make": entry(has("make"), source=F.lit("url_matched_json_ld.brand.name")),
        "model": entry(has("model"), source=F.lit("url_matched_json_ld.model")),
        "price_pkr": entry(F.lit(True), source=F.col("price_source"), displayed=F.col("price_displayed")),
        "registration_year": entry(
            has("registration_year_source"), source=F.col("registration_year_source"), statements=F.col("registration_statements")),
        "variant": entry(has("variant"), source=F.lit("h1_minus_verified_make_model_and_year")),
    }
    return F.to_json(F.struct(*[value.alias(name) for name, value in entries.items()]))


# The compared fields, and whether each is a number.
_COMPARED = (("price_pkr", True), ("year", True), ("mileage_km", True), ("engine_cc", True), ("fuel", False), ("transmission", False))


def _source_values(product: Column) -> dict[str, tuple[Column, bool]]:
    """Stored field -> (its source value, whether that is a number)."""
    fields = product["fields"]
    values = (
        F.get(product["offers"], F.lit(0))["price"], fields["modelDate"], fields["mileageFromOdometer"],
        F.get_json_object(fields["vehicleEngine"], "$.engineDisplacement"), fields["fuelType"], fields["vehicleTransmission"],
    )
    return {name: (value, numeric) for (name, numeric), value in zip(_COMPARED, values)}


def _page_evidence(pages: DataFrame) -> DataFrame:
    """What a review needs of each page, so that no page structure is shuffled."""
    slashless = lambda c: F.regexp_replace(c, "/+$", "")
    offered = lambda item: F.coalesce(
        F.startswith(item["fields"]["offers"], F.lit("{"))
        & (slashless(F.get(item["offers"], F.lit(0))["url"]) == slashless(F.col("url"))), F.lit(False),
    )
    box = F.coalesce(F.col("page.price_box"), F.lit(""))
    shown = f"(?i){PRICE_BOX_PATTERN}"
    box_value = F.when(box.rlike(shown), exact_price_value(F.regexp_extract(box, shown, 1), F.regexp_extract(box, shown, 2)))
    matched = pages.withColumn("__products", F.filter(read_objects(F.col("page.objects")), offered)).withColumns({
        "matched_product_count": F.size("__products"),
        "__product": F.when(F.size("__products") == 1, F.get("__products", F.lit(0))),
    })
    sources = [
        (first_number(value).cast("string") if numeric else value).alias(f"__{name}")
        for name, (value, numeric) in _source_values(F.col("__product")).items()
    ]
    return matched.select(
        *[name for name in ("position", "sha256", "actual_sha256") if name in pages.columns], F.col("url").alias("source_url"),
        F.col("page.title").alias("source_title"), box.alias("__box"), box_value.alias("__box_value"), "matched_product_count", *sources,
    )


def reconcile_evidence(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Compare stored rows with their saved pages; one review per row that has a page.

    ``rows`` are stored texts; ``pages`` hold ``url``, ``page`` (structure), ``sha256`` as
    recorded and ``actual_sha256`` as computed. Where pages were saved more than once they need a
    ``position`` in the log: the last page of a url counts (null positions come first, ties go to
    the larger checksum); without one every page is reviewed. Only a price confirmed twice or a known fuel
    yields an update; other mismatches become flags. ``checksum_ok`` false must stop a batch.
    """
    saved = _page_evidence(pages)
    if "position" in pages.columns:
        found = F.struct(*[name for name in saved.columns if name not in ("source_url", "position")])
        last = F.max_by(found, F.struct("position", "sha256", "actual_sha256")).alias("p")
        saved = saved.groupBy("source_url").agg(last).select("source_url", "p.*")
    matched = rows.join(saved, "source_url")
    unique = F.col("matched_product_count") == 1
    verified = F.when(unique, F.coalesce(F.col("__box_value").cast("string") == F.col("__price_pkr"), F.lit(False)))
    matched = matched.withColumn("price_verified", verified)

    def check(name: str, numeric: bool) -> Column:
        source, stored = F.col(f"__{name}"), F.col(name)
        same = (
            whole_number(stored).cast("string").eqNullSafe(source) if numeric else F.lower(stored).eqNullSafe(F.lower(source))
        )
        status = F.when(same, F.lit("match")).otherwise(F.lit("mismatch"))
        compared = unique & source.isNotNull() & (source != "")
        return F.when(compared, F.struct(F.lit(name).alias("field"), stored.alias("stored"), source.alias("source"), status.alias("status")))

    checks = F.array_compact(F.array(*[check(name, numeric) for name, numeric in _COMPARED]))
    matched = matched.withColumn("checks", F.when(unique, checks).otherwise(F.array().cast(
        "array<struct<field:string,stored:string,source:string,status:string>>")))
    wrong = F.filter("checks", lambda item: item["status"] == "mismatch")
    repairable = lambda item: ((item["field"] == "price_pkr") & F.col("price_verified")) | (
        (item["field"] == "fuel") & item["source"].isin(*KNOWN_FUELS)
    )
    repaired = F.filter(wrong, repairable)
    flags = F.when(unique, F.concat(
        F.when(F.col("price_verified"), F.array().cast("array<string>")).otherwise(F.array(F.lit("price_box_product_disagreement_or_unavailable"))),
        F.transform(F.filter(wrong, lambda item: ~repairable(item)), lambda item: F.concat(F.lit("unresolved_source_disagreement:"), item["field"])),
    )).otherwise(F.array(F.lit("no_unique_current_product")))
    return matched.select(
        "listing_id", "source_url", F.col("actual_sha256").alias("html_sha256"), (F.col("sha256") == F.col("actual_sha256")).alias("checksum_ok"),
        "source_title", "matched_product_count",
        F.when(unique, F.nullif(F.col("__box"), F.lit(""))).alias("price_box_displayed"), F.when(unique, F.col("__box_value")).alias("price_box_value"),
        "price_verified", "checks",
        F.map_from_entries(F.transform(repaired, lambda item: F.struct(item["field"], item["source"]))).alias("updates"), flags.alias("flags"),
    )


def check_counts(reviews: DataFrame) -> DataFrame:
    """Field comparisons by outcome."""
    return reviews.select(F.explode("checks").alias("c")).groupBy(F.col("c.field").alias("field"), F.col("c.status").alias("status")).agg(
        F.count(F.lit(1)).alias("count")
    )
