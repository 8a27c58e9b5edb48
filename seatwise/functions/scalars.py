"""Column functions: every one is a composition of built-in expressions, so it stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seatwise.functions import lexicon


def nullif_blank(c: Column) -> Column:
    """Trimmed text, or null when nothing is left."""
    trimmed = F.trim(c)
    return F.when(trimmed != "", trimmed)


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def phone_normalize(raw: Column) -> Column:
    """Strip spaces and signs, ``00`` prefix to ``+``, drop the national 0 after a listed country code."""
    bare = F.translate(F.coalesce(raw, F.lit("")), " \t\n\x0b\f\r().-", "")
    plus = F.regexp_replace(F.trim(bare), "^00", "+")
    codes = "|".join(lexicon.ZERO_DROPPING_COUNTRY_CODES)
    return F.regexp_replace(plus, rf"^\+({codes})0", r"+$1")


def date_label(d: Column) -> Column:
    return F.date_format(d, "EEEE d MMMM yyyy")


def hhmm(minutes: Column) -> Column:
    return F.concat_ws(":", F.lpad((F.floor(minutes / 60)).cast("string"), 2, "0"),
                       F.lpad((minutes % 60).cast("string"), 2, "0"))


def minutes_of(text: Column) -> Column:
    """``HH:MM`` as minutes of the day; null when it is not a time."""
    hour = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})", 1).try_cast("int")
    minute = F.regexp_extract(text, r"^(\d{1,2}):(\d{2})", 2).try_cast("int")
    total = hour * 60 + minute
    return F.when((hour < 24) & (minute < 60), total)


def bound_minutes(text: Column) -> Column:
    """``HH:MM`` of opening hours, which may end at 24:00."""
    return F.when(F.trim(text) == "24:00", F.lit(1440)).otherwise(minutes_of(text))


def csv_param(c: Column) -> Column:
    """A comma list from a request: lower case, no white space, no empties."""
    packed = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s", "")
    return F.array_remove(F.split(packed, ","), "")


def pipe_list(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "")


def epoch_ts(epoch: Column | int) -> Column:
    return F.timestamp_seconds(epoch if isinstance(epoch, Column) else F.lit(epoch))


def local_date(epoch: Column | int, tz: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(epoch_ts(epoch), tz))


def local_minute(epoch: Column | int, tz: Column) -> Column:
    local = F.from_utc_timestamp(epoch_ts(epoch), tz)
    return F.hour(local) * 60 + F.minute(local)


def day_number(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date"))


def absolute_minute(d: Column, minute: Column) -> Column:
    """Local wall-clock time as minutes since the epoch day, so that times compare across midnight."""
    return day_number(d).cast("long") * 1440 + minute


def local_absolute_second(epoch: Column | int, tz: Column) -> Column:
    local = F.from_utc_timestamp(epoch_ts(epoch), tz)
    return F.unix_timestamp(local)


def within_hours(ts: Column, tz: Column | str, start: int = 480, end: int = 1380) -> Column:
    """Local time of an instant lies in [start, end), in minutes of the day."""
    local = F.from_utc_timestamp(ts, tz)
    minute = F.hour(local) * 60 + F.minute(local)
    return (minute >= start) & (minute < end)


def mask_contact(email: Column) -> Column:
    return F.regexp_replace(email, r"^(.).*(@.*)$", "$1***$2")


def html_escape(c: Column, apostrophe: str = "&#39;") -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def calendar_escape(c: Column) -> Column:
    out = c.cast("string")
    for char, escaped in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        out = F.replace(out, F.lit(char), F.lit(escaped))
    return out


def price_label(price: Column) -> Column:
    return F.when(F.coalesce(price, F.lit(0)) == 0, F.lit("included")).otherwise(F.format_number(price, 0))


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 40)


def diet_ok(diet: Column, item_diets: Column) -> Column:
    """Whether an item suits a (lower-cased) diet; an unknown diet suits nothing, no diet suits everything."""
    chain = F.when(diet.isNull(), F.lit(True))
    for name, accepted in lexicon.DIET_ACCEPTS.items():
        chain = chain.when(diet == name, F.arrays_overlap(item_diets, F.array(*[F.lit(a) for a in accepted])))
    return F.coalesce(chain.otherwise(F.lit(False)), F.lit(False))


def pick(values: list[str], index: Column) -> Column:
    """The ``index``-th (0-based) of a short fixed list of words."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def supported_language(c: Column) -> Column:
    """The first two letters when they name a supported language, else English."""
    code = F.substring(F.lower(F.coalesce(c, F.lit(""))), 1, 2)
    return F.when(code.isin(*lexicon.LANGUAGES), code).otherwise("en")


def by_language(lang: Column, table: dict[str, Column | str]) -> Column:
    """One of three per-language values."""
    as_col = {k: v if isinstance(v, Column) else F.lit(v) for k, v in table.items()}
    return F.when(lang == "es", as_col["es"]).when(lang == "th", as_col["th"]).otherwise(as_col["en"])


def localized_date(d: Column, lang: Column) -> Column:
    """Weekday, day, month and year in Spanish, English or Thai, each in its own layout."""
    weekday = F.dayofweek(d) - 1
    month = F.month(d) - 1
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")

    def words(code):
        return pick(lexicon.WEEKDAYS[code], weekday), pick(lexicon.MONTHS[code], month)

    (es_w, es_m), (en_w, en_m), (th_w, th_m) = words("es"), words("en"), words("th")
    return by_language(lang, {
        "es": F.concat(es_w, F.lit(" "), day, F.lit(" de "), es_m, F.lit(" de "), year),
        "en": F.concat_ws(" ", en_w, day, en_m, year),
        "th": F.concat(th_w, F.lit("ที่ "), day, F.lit(" "), th_m, F.lit(" "), year),
    })
