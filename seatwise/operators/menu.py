"""Menus: normalization, search by allergen, diet, service and words, lookup of a dish, and menu texts per venue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from seatwise.functions import lexicon
from seatwise.functions.scalars import csv_param, diet_ok, html_escape, nullif_blank, pipe_list, price_label, slug
from seatwise.session import spread

_STRINGS = "array<string>"


def normalize_menu(raw: DataFrame) -> DataFrame:
    """Raw rows (lists as arrays, ``kind`` food or drink) in the shape of the item table.

    Drinks and ``all_day`` are served all day; blank price and spice are 0; blank dates and unit are null.
    """
    everywhere = F.array(*[F.lit(s) for s in lexicon.SERVICES])
    all_day = (F.col("kind") == "drink") | F.array_contains("service", "all_day")
    number = {c: F.coalesce(nullif_blank(F.col(c)).try_cast("int"), F.lit(0)) for c in ("price_thb", "spicy")}
    return raw.withColumns({
        "service": F.when(all_day, everywhere).otherwise(F.col("service")),
        "price_thb": number["price_thb"], "spicy": number["spicy"],
        "available": F.col("available") == "yes",
        "unit": nullif_blank(F.col("unit")),
        "available_from": nullif_blank(F.col("available_from")).try_cast("date"),
        "available_to": nullif_blank(F.col("available_to")).try_cast("date"),
    })


def union_menu(food: DataFrame, drinks: DataFrame) -> DataFrame:
    """Food and drink files as one raw table with a ``kind``; columns one file lacks are blank."""
    both = food.withColumn("kind", F.lit("food")).unionByName(drinks.withColumn("kind", F.lit("drink")), allowMissingColumns=True)
    lists = {c: F.coalesce(F.col(c), F.array().cast(_STRINGS)) for c in ("service", "allergens", "diet", "contains")}
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("unit", "spicy", "available_from", "available_to")}
    return both.withColumns({**lists, **texts})


def listed(menu: DataFrame, today: date) -> DataFrame:
    """Available and not yet expired; items still to come are kept."""
    return menu.where(F.col("available") & (F.col("available_to").isNull() | (F.col("available_to") >= today)))


# --------------------------------------------------------------------------------------------------------- search

PARAMS = ["kind", "exclude_allergens", "diet", "service", "on_date", "exclude_contains", "dish", "words"]


def distinct_filters(requests: DataFrame, today: date) -> DataFrame:
    """Each distinct set of search parameters per venue once, parsed; ``f_*`` are the raw values to join back on."""
    raw = requests.select("venue_id", *[F.coalesce(F.col(c), F.lit("")).alias(f"f_{c}") for c in PARAMS]).distinct()
    return raw.select(
        "*",
        F.when(F.col("f_kind") != "", F.col("f_kind")).alias("p_kind"),
        csv_param(F.col("f_exclude_allergens")).alias("p_allergens"),
        F.when(F.col("f_diet") != "", F.lower("f_diet")).alias("p_diet"),
        F.when(F.col("f_service") != "", F.lower("f_service")).alias("p_service"),
        F.coalesce(nullif_blank(F.col("f_on_date")).try_cast("date"), F.lit(today)).alias("p_date"),
        csv_param(F.col("f_exclude_contains")).alias("p_contains"),
        nullif_blank(F.col("f_dish")).alias("p_dish"),
        F.array_remove(F.split(F.lower(F.trim("f_words")), " "), "").alias("p_words"),
        nullif_blank(F.col("f_dish")).isNotNull().alias("lookup"))


def matching_items(filters: DataFrame, menu: DataFrame) -> DataFrame:
    """Items per filter set. Search applies every filter; looking up a dish by name applies only availability and kind,
    and reports the conflicts instead. ``%`` and ``_`` in a word or name act as wildcards."""
    items = menu.where("available").select(
        "venue_id", "id", F.col("kind").alias("i_kind"), "section", "name", "description", "price_thb", "unit",
        F.col("service").alias("i_service"), "allergens", F.col("diet").alias("i_diet"), "spicy", "contains", "notes",
        "available_from", "available_to",
        F.lower(F.concat_ws(" ", "name", "description", "section")).alias("haystack"))

    def around(text):
        # a backslash that escapes nothing stands for itself
        literal = F.regexp_replace(text, r"\G((?:[^\\]|\\[%_\\])*+)\\(?![%_\\])", r"$1\\\\")
        return F.concat(F.lit("%"), literal, F.lit("%"))

    def wild(text):
        return F.contains(text, F.lit("%")) | F.contains(text, F.lit("_")) | F.contains(text, F.lit("\\"))

    # a plain word is looked for as it is; only one with a wildcard needs a pattern
    found_words = F.forall("p_words", lambda w: F.when(wild(w), F.like(F.col("haystack"), around(w))).otherwise(F.contains("haystack", w)))
    searched = (
        ~F.arrays_overlap("allergens", "p_allergens") & ~F.arrays_overlap("contains", "p_contains")
        & diet_ok(F.col("p_diet"), F.col("i_diet"))
        & (F.col("p_service").isNull() | F.array_contains("i_service", F.col("p_service")))
        & (F.col("available_from").isNull() | (F.col("available_from") <= F.col("p_date")))
        & (F.col("available_to").isNull() | (F.col("available_to") >= F.col("p_date")))
        & ((F.size("p_words") == 0) | found_words))
    named = F.when(wild(F.col("p_dish")), F.ilike(F.col("name"), around(F.col("p_dish")))).otherwise(
        F.contains(F.lower("name"), F.lower("p_dish")))
    wanted = F.when(F.col("lookup"), named).otherwise(searched)
    return (
        spread(filters, *[f"f_{c}" for c in PARAMS]).join(items, "venue_id")
        .where((F.col("p_kind").isNull() | (F.col("i_kind") == F.col("p_kind"))) & wanted)
        .withColumn("allergen_conflicts", F.array_sort(F.array_intersect("allergens", "p_allergens")))
        .withColumn("contains_conflicts", F.array_sort(F.array_intersect("contains", "p_contains")))
        .withColumn("diet_ok", diet_ok(F.col("p_diet"), F.col("i_diet")))
        .withColumn("suits_guest", (F.size("allergen_conflicts") == 0) & (F.size("contains_conflicts") == 0) & F.col("diet_ok"))
        .drop("haystack")
    )


def _back_to_requests(requests: DataFrame, per_filter: DataFrame) -> DataFrame:
    keyed = requests.select("request_id", "venue_id", *[F.coalesce(F.col(c), F.lit("")).alias(f"f_{c}") for c in PARAMS])
    return keyed.join(per_filter, ["venue_id", *[f"f_{c}" for c in PARAMS]])


def find_dishes(requests: DataFrame, menu: DataFrame, today: date) -> DataFrame:
    """One row per request and matching item; order by (request_id, id). Equal requests are searched once."""
    return _back_to_requests(requests, matching_items(distinct_filters(requests, today), menu))


def found_counts(requests: DataFrame, menu: DataFrame, today: date) -> DataFrame:
    """Per searching request that finds something: how many items, the first and the last id. Items are counted per set of parameters, and only
    the counts go back to the requests."""
    keys = ["venue_id", *[f"f_{c}" for c in PARAMS]]
    per_filter = matching_items(distinct_filters(requests, today).where(~F.col("lookup")), menu).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
    return _back_to_requests(requests, per_filter).groupBy("request_id").agg(
        F.sum("n").alias("n_items"), F.min("first").alias("first_id"), F.max("last").alias("last_id"))


def search_envelope(requests: DataFrame, menu: DataFrame, today: date) -> DataFrame:
    """One answer per request: mode, status, count, the filters applied and the items, prices only when looked up."""
    filters = distinct_filters(requests, today)
    in_lookup = F.col("lookup")

    def only_lookup(c):
        return F.when(in_lookup, F.col(c)).alias(c)

    item = F.struct("id", "section", "name", "description", "unit", "allergens", F.col("i_diet").alias("diet"), "spicy",
                    "contains", "notes", "available_from", "available_to", only_lookup("price_thb"),
                    only_lookup("allergen_conflicts"), only_lookup("contains_conflicts"), only_lookup("diet_ok"), only_lookup("suits_guest"))
    keys = ["venue_id", *[f"f_{c}" for c in PARAMS]]
    found = matching_items(filters, menu).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    per_filter = filters.select(*keys, "lookup").join(found, keys, "left")
    count = F.coalesce(F.size("items"), F.lit(0))
    count = F.when(F.col("items").isNull(), 0).otherwise(count)

    def shown(c, default):
        return F.when(F.col(f"f_{c}") == "", default).otherwise(F.col(f"f_{c}")).alias(c)

    answered = per_filter.select(
        *keys, F.when(in_lookup, "lookup").otherwise("search").alias("mode"),
        F.when(count > 0, "ok").when(in_lookup, "not_found").otherwise("no_match").alias("status"), count.alias("count"),
        F.struct(shown("kind", "any"), shown("exclude_allergens", ""), shown("diet", ""), shown("service", ""),
                 shown("on_date", "today"), shown("exclude_contains", ""), shown("dish", ""), shown("words", "")).alias("filters"),
        F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"))
    return _back_to_requests(requests, answered).drop(*keys[1:])


# ---------------------------------------------------------------------------------------------------------- texts

def _joined(order: list[str], text: Column, separator: str) -> Column:
    """Texts of a group in the given order, joined; null for an empty group."""
    parts = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("text")))))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: p["text"]), separator))


def _placed(menu: DataFrame) -> DataFrame:
    """With the column ``at`` to sort by: the id and, of items that share one, the ``place`` in the table where the menu tells it."""
    return menu.withColumn("at", F.struct("id", *[c for c in ("place",) if c in menu.columns]))


def menu_summary(menu: DataFrame, today: date, named_sections: tuple[str, ...] = lexicon.NAMED_DRINK_SECTIONS,
                 menu_url: str = "https://example.org/menu") -> DataFrame:
    """Per venue: food sections, signature dishes, time-bound groups, what is off today, and drinks, as one text.

    Sections come in the order of their first item. Items are first joined per section, then sections per venue.
    """
    menu = _placed(menu)
    live = F.col("available") & (F.col("available_to").isNull() | (F.col("available_to") >= today))
    food, drink = F.col("kind") == "food", F.col("kind") == "drink"
    bounded = F.col("available_from").isNotNull() | F.col("available_to").isNotNull()
    span = F.concat(F.col("section"), F.lit(" ("), F.coalesce(F.col("available_from").cast("string"), F.lit("now")), F.lit(" to "),
                    F.coalesce(F.col("available_to").cast("string"), F.lit("further notice")), F.lit("): "))
    per_section = menu.where(live).groupBy("venue_id", "kind", "section").agg(
        F.min("at").alias("first"), F.count("*").alias("n"),
        _joined(["at"], F.when(drink & F.col("section").isin(*named_sections), F.col("name")), "; ").alias("names"))
    drinks_text = F.coalesce("names", F.concat(F.col("n").cast("string"), F.lit(" items")))
    sections = per_section.groupBy("venue_id").agg(
        _joined(["first"], F.when(food, F.col("section")), " · ").alias("food_sections"),
        _joined(["first"], F.when(drink, F.concat("section", F.lit(": "), drinks_text)), " | ").alias("drinks"))
    timed = menu.where(live & bounded).groupBy("venue_id", span.alias("span")).agg(_joined(["at"], F.col("name"), ", ").alias("names"))
    timed = timed.groupBy("venue_id").agg(_joined([], F.concat("span", "names"), "; ").alias("timed"))
    named = menu.groupBy("venue_id").agg(
        _joined(["at"], F.when(live & food & F.col("notes").like("Signature%"), F.col("name")), "; ").alias("signature"),
        _joined(["at"], F.when(~F.col("available"), F.col("name")), ", ").alias("off"))
    lines = [
        F.lit("# Menu summary (live from the kitchen's menu; prices in THB plus 10% service and applicable taxes)"),
        F.lit(f"Full menu for guests: {menu_url}"),
        F.concat(F.lit("Food sections: "), "food_sections", F.lit(".")),
        F.concat(F.lit("Signature dishes: "), "signature", F.lit(".")),
        F.concat(F.lit("Time-bound items: "), F.coalesce("timed", F.lit("none")), F.lit(".")),
        F.concat(F.lit("Not available today: "), F.coalesce("off", F.lit("nothing")), F.lit(".")),
        F.concat(F.lit("Drinks — "), "drinks", F.lit(".")),
    ]
    return named.join(sections, "venue_id", "left").join(timed, "venue_id", "left").select(
        "venue_id", F.concat_ws("\n", *lines).alias("menu_text"))


def _all_day() -> Column:
    return F.size("service") == len(lexicon.SERVICES)


def menu_document(menu: DataFrame, today: date) -> DataFrame:
    """Per venue: the compact text of everything listed, section by section in order of first appearance."""
    empty = F.lit("")
    has_dates = F.col("available_from").isNotNull() | F.col("available_to").isNotNull()
    tags = F.array_compact(F.array(
        F.when(F.col("spicy") > 0, F.concat(F.lit("spicy "), F.col("spicy").cast("string"))),
        F.when(F.size("contains") > 0, F.concat(F.lit("contains "), F.array_join("contains", ", "))),
        F.when(~_all_day(), F.concat(F.array_join("service", " & "), F.lit(" only"))),
        F.when(has_dates, F.concat(F.lit("only "), F.coalesce(F.col("available_from").cast("string"), F.lit("now")), F.lit(" to "),
                                   F.coalesce(F.col("available_to").cast("string"), F.lit("further notice"))))))
    described = F.when(F.col("description") != "", F.concat(F.lit(" — "), "description")).otherwise(empty)
    noted = F.when(F.col("notes") != "", F.concat(F.lit(" ("), "notes", F.lit(")"))).otherwise(empty)
    tagged = F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, "; "), F.lit("]"))).otherwise(empty)
    price = price_label(F.col("price_thb"))
    food_line = F.concat(F.lit("- "), "name", described, F.lit(". "), price, noted, tagged)
    drink_item = F.concat("name", F.when(F.col("description") != "", F.concat(F.lit(" ("), "description", F.lit(")"))).otherwise(empty),
                          F.lit(" "), price, F.lit("/"), F.coalesce("unit", empty))
    is_food = F.col("kind") == "food"
    sections = _placed(listed(menu, today)).groupBy("venue_id", "kind", "section").agg(
        F.min("at").alias("first"),
        _joined(["at"], F.when(is_food, food_line), "\n").alias("food_lines"),
        _joined(["at"], F.when(~is_food, drink_item), "; ").alias("drink_items"))
    blocks = sections.groupBy("venue_id").agg(
        _joined(["first"], F.when(is_food, F.concat(F.lit("## "), "section", F.lit("\n"), "food_lines")), "\n").alias("food"),
        _joined(["first"], F.when(~is_food, F.concat(F.lit("- "), "section", F.lit(": "), "drink_items")), "\n").alias("drinks"))
    head = [F.lit("# Menu (prices in THB, plus 10% service and applicable taxes)"),
            F.lit("Allergens and diets are deliberately not listed here: for any allergy, diet or restriction use the dish search. "
                  "Tags: spicy 1-3; contains; service if not all day; dates for time-bound items.")]
    return blocks.select("venue_id", F.concat(F.concat_ws("\n", *head, "food", F.lit("## Drinks"), "drinks"), F.lit("\n")).alias("document"))


def _labels(values: Column, labels: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.transform(values, lambda v: F.coalesce(F.try_element_at(table, v), v))


def _span_label() -> Column:
    return F.concat_ws(" – ", F.date_format("available_from", "d MMM yyyy"), F.date_format("available_to", "d MMM yyyy"))


def menu_page(menu: DataFrame, today: date, title: str = "Menu") -> DataFrame:
    """Per venue: the guest-facing page content (navigation, escaped items, badges, allergens), without styling."""
    quote = "&#x27;"

    def badge(kind, text):
        return F.concat(F.lit(f'<span class="b b-{kind}">'), html_escape(text, quote), F.lit("</span>"))

    empty = F.lit("")
    has_dates = F.col("available_from").isNotNull() | F.col("available_to").isNotNull()
    badges = F.concat(
        F.array_join(F.transform(_labels(F.col("diet"), lexicon.DIET_LABELS), lambda d: badge("diet", d)), ""),
        F.when(F.col("spicy") > 0, badge("spicy", F.concat(F.lit("Spicy "), F.repeat(F.lit("•"), F.col("spicy"))))).otherwise(empty),
        F.when(~_all_day(), badge("svc", F.array_join("service", " & "))).otherwise(empty),
        F.when(has_dates, badge("svc", _span_label())).otherwise(empty))
    allergens = F.when(F.size("allergens") > 0, F.concat(
        F.lit('<span class="alg">Contains: '), F.array_join(_labels(F.col("allergens"), lexicon.ALLERGEN_LABELS), ", "),
        F.lit("</span>"))).otherwise(empty)
    meta = F.concat(badges, allergens)
    signature = F.col("notes").startswith("Signature")
    note = F.regexp_replace(F.regexp_replace("notes", "^Signature", ""), r"^[ .]+|[ .]+$", "")
    described = F.when(F.col("description") != "", F.concat(
        F.lit('<p class="desc">'), html_escape(F.col("description"), quote), F.lit("</p>"))).otherwise(empty)
    name = html_escape(F.col("name"), quote)
    food = F.concat(
        F.lit('<li class="item"><div class="row"><h3>'), name,
        F.when(signature, F.lit(' <span class="sig">Signature</span>')).otherwise(empty), F.lit('</h3><span class="price">'),
        price_label(F.col("price_thb")), F.lit("</span></div>"), described,
        F.when(note != "", F.concat(F.lit('<p class="note">'), html_escape(note, quote), F.lit("</p>"))).otherwise(empty),
        F.when(meta != "", F.concat(F.lit('<div class="meta">'), meta, F.lit("</div>"))).otherwise(empty), F.lit("</li>"))
    drink = F.concat(
        F.lit('<li class="item"><div class="row"><h3>'), name, F.lit('</h3><span class="price">'), price_label(F.col("price_thb")),
        F.lit("<small> / "), html_escape(F.col("unit"), quote), F.lit("</small></span></div>"), described, F.lit("</li>"))
    is_drink = F.col("kind") == "drink"
    heading = F.when(is_drink, F.concat(F.lit("Drinks · "), "section")).otherwise(F.col("section"))
    sections = _placed(listed(menu, today)).groupBy("venue_id", is_drink.alias("is_drink"), "section", heading.alias("heading")).agg(
        F.min("at").alias("first"), _joined(["at"], F.when(is_drink, drink).otherwise(food), "").alias("items"))
    link = F.concat(F.lit('<a href="#'), slug(F.col("heading")), F.lit('">'), html_escape(F.col("section"), quote), F.lit("</a>"))
    body = F.concat(F.lit('<section id="'), slug(F.col("heading")), F.lit('"><h2>'), html_escape(F.col("heading"), quote),
                    F.lit("</h2><ul>"), "items", F.lit("</ul></section>"))
    pages = sections.groupBy("venue_id").agg(
        _joined(["is_drink", "first"], link, "").alias("nav"), _joined(["is_drink", "first"], body, "").alias("body"))
    return pages.select("venue_id", "nav", F.concat(
        F.lit(f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>{title}</title></head><body>\n<nav>'), "nav",
        F.lit("</nav>\n<main>"), "body", F.lit("</main>\n</body></html>\n")).alias("html"))


def raw_menu_lists(flat: DataFrame) -> DataFrame:
    """A flat menu table (lists still ``|``-separated) in the shape ``read_menu`` returns."""
    return flat.withColumns({c: pipe_list(F.col(c)) for c in ("service", "allergens", "diet", "contains")})
