"""Release-date parsing; every parser returns a struct of date text, year and reason."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marlstone.functions.text import Text, as_column

# Month names (English and Russian, full and short).
MONTHS: dict[str, int] = {
    "jan": 1, "january": 1, "янв": 1, "января": 1,
    "feb": 2, "february": 2, "фев": 2, "февраля": 2,
    "mar": 3, "march": 3, "мар": 3, "марта": 3,
    "apr": 4, "april": 4, "апр": 4, "апреля": 4,
    "may": 5, "мая": 5,
    "jun": 6, "june": 6, "июн": 6, "июня": 6,
    "jul": 7, "july": 7, "июл": 7, "июля": 7,
    "aug": 8, "august": 8, "авг": 8, "августа": 8,
    "sep": 9, "sept": 9, "september": 9, "сен": 9, "сентября": 9,
    "oct": 10, "october": 10, "окт": 10, "октября": 10,
    "nov": 11, "november": 11, "ноя": 11, "ноября": 11,
    "dec": 12, "december": 12, "дек": 12, "декабря": 12,
}
_DATED = r"(\d{1,2})\s+([A-Za-zА-Яа-я.]+)\s*,?\s*(\d{4})"


def iso_release_date(value: Text) -> Column:
    """struct(date, year, reason) of an ISO date, a leading year, or neither."""
    text = F.trim(as_column(value))
    parsed = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    full = (F.length(text) >= 10) & parsed.isNotNull() & F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$")
    partial = text.rlike(r"^\d{4}")
    return F.struct(
        F.when(full, F.date_format(parsed, "yyyy-MM-dd")).alias("date"),
        F.when(full, F.year(parsed)).when(partial, F.substring(text, 1, 4).try_cast("int")).alias("year"),
        F.when(text.isNull() | (text == ""), F.lit("missing_release_date"))
        .when(full, F.lit(None).cast("string"))
        .when(partial, F.lit("partial_release_date"))
        .otherwise(F.lit("invalid_release_date"))
        .alias("reason"),
    )


def store_release_date(value: Text) -> Column:
    """struct(date, year) of ``3 Sep, 2013`` in English or Russian, else the first 19xx/20xx year."""
    text = F.trim(as_column(value))
    months = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    day = F.nullif(F.regexp_extract(text, _DATED, 1), F.lit("")).try_cast("int")
    month = F.try_element_at(months, F.lower(F.regexp_replace(F.regexp_extract(text, _DATED, 2), r"^\.+|\.+$", "")))
    year = F.nullif(F.regexp_extract(text, _DATED, 3), F.lit("")).try_cast("int")
    known = day.isNotNull() & month.isNotNull() & year.isNotNull()
    bare = F.nullif(F.regexp_extract(text, r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int")
    return F.struct(
        F.when(known, F.format_string("%04d-%02d-%02d", year, month, day)).alias("date"),
        F.when(known, year).otherwise(bare).alias("year"),
    )


def prefix_release_date(value: Text) -> Column:
    """struct(date, year) of text that starts like a date; the calendar is not checked."""
    date = F.nullif(F.regexp_extract(as_column(value), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return F.struct(date.alias("date"), F.substring(date, 1, 4).try_cast("int").alias("year"))


def epoch_release_date(value: Text) -> Column:
    """struct(date, year) of epoch seconds in UTC; anything else is null."""
    seconds = as_column(value).cast("string").try_cast("bigint")
    # Years 1 to 9999, which is what a date can hold.
    usable = seconds.between(-62135596800, 253402300799)
    days = F.floor(F.when(usable, seconds) / 86400).cast("int")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days)
    return F.struct(F.date_format(date, "yyyy-MM-dd").alias("date"), F.year(date).alias("year"))
