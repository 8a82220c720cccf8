"""Alias, time, size, name and JSON expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from transhume.values import ASSETS_PREFIX, TABLES_PREFIX

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
LAST_SECOND = 253402300799  # end of year 9999
FIRST_SECOND = -62135596800  # start of year 1
# Date texts beyond ISO, and the order of their parts in ISO.  Fixed values: names of months and days.
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+"
DATE_FORMS = (
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2"),
    (r"^([A-Z][a-z]{2})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})", "$3-$1-$2"),
    (r"^(\d{1,2})[\s-]([A-Z][a-z]{2})[a-z]*\.?,?[\s-](\d{4})", "$3-$2-$1"),
)
HALF_DAY = r"^(.*\s)(\d{1,2})(:\d{2}(?::\d{2})?(?:\.\d+)?)\s*([AaPp])[Mm]$"
NUMBER = r"^-?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"


def unless(value: Column, *unset: object) -> Column:
    """The value, or null where it equals one of the values that count as not set."""
    for other in unset:
        value = F.nullif(value, F.lit(other))
    return value


def first_set(values: Sequence[Column], *unset: object) -> Column:
    """First value that is neither null nor one of the ``unset`` values."""
    return F.coalesce(*[unless(value, *unset) for value in values])


def text_or(value: Column, default: str) -> Column:
    return F.coalesce(unless(value, ""), F.lit(default))


def utc_of(seconds: Column) -> Column:
    """Seconds since the epoch as a timestamp without zone, whatever the zone of the session."""
    inside = F.when(seconds.between(FIRST_SECOND, LAST_SECOND), seconds.cast("decimal(18,6)"))
    return F.expr(EPOCH) + F.make_dt_interval(secs=inside)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where repeating it would grow the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def iso_text(text: Column) -> Column:
    """A date text in another order, with a month's name, or with half days, put as ISO has it."""
    value = F.regexp_replace(text, WEEKDAY, "")
    for pattern, order in DATE_FORMS:
        value = F.regexp_replace(value, pattern, order)

    def with_month(v: Column) -> Column:
        name = F.regexp_extract(v, "^[0-9]{4}-([A-Z][a-z]{2})-", 1)
        place = F.instr(F.lit(MONTHS), name)
        month = F.floor((place + 2) / F.lit(3)).cast("string")
        return F.when((name != "") & (place % 3 == 1), F.replace(v, name, month)).otherwise(v)

    def with_clock(v: Column) -> Column:
        hour = F.regexp_extract(v, HALF_DAY, 2).try_cast("int")
        late = F.lower(F.regexp_extract(v, HALF_DAY, 4)) == "p"
        hour = F.when(hour.between(1, 12), hour % 12 + F.when(late, 12).otherwise(0))
        parts = F.regexp_extract(v, HALF_DAY, 1), hour.cast("string"), F.regexp_extract(v, HALF_DAY, 3)
        return F.when(v.rlike(HALF_DAY), F.concat(*parts)).otherwise(v)

    return bind(bind(value, with_month), with_clock)


def parsed_timestamp(text: Column) -> Column:
    """Date text as a UTC timestamp without zone; of plain numbers only years and yyyyMMdd are dates.

    A text without zone is in UTC; one with a zone is converted.  Nothing depends on the session.
    """
    return bind(F.regexp_replace(F.trim(text), r"\s*(?:GMT|UTC)$", ""), utc_timestamp)


def utc_timestamp(plain: Column) -> Column:
    zoned = plain.rlike(r":[0-9.]+\s*(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)$")
    absolute = F.when(zoned, utc_of(F.unix_seconds(plain.try_cast("timestamp"))))
    local = F.coalesce(
        plain.try_cast("timestamp_ntz"),
        F.when(plain.rlike(r"[/\sA-Z]"), iso_text(plain)).try_cast("timestamp_ntz"),
    )
    packed = F.regexp_replace(plain, "^(....)(..)(..)$", "$1-$2-$3")
    return (
        F.when(plain.rlike("^[0-9]{8}$"), packed.try_cast("timestamp_ntz"))
        .when(plain.rlike(NUMBER) & ~plain.rlike("^[0-9]{4}$"), F.lit(None))
        .otherwise(F.when(zoned, absolute).otherwise(local))
    )


def to_second(stamp: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a timestamp without zone."""
    return F.left(stamp.cast("string"), F.lit(19))


def norm_timestamp(value: Column, ms_threshold: float = 1e9) -> Column:
    """Epoch number or date text as ``YYYY-MM-DDTHH:MM:SSZ``; unreadable text is left as it is.

    Numbers, also with sign, fraction or exponent, are cut to whole ones.  Those above
    ``ms_threshold`` are milliseconds, the others seconds.
    """
    text = value.cast("string")
    number = F.when(text.rlike(NUMBER), text.try_cast("double").try_cast("bigint"))
    seconds = F.when(number > ms_threshold, F.floor(number / F.lit(1000))).otherwise(number)
    stamp = F.when(number.isNotNull(), utc_of(seconds)).otherwise(parsed_timestamp(text))
    iso = F.concat(F.replace(to_second(stamp), F.lit(" "), F.lit("T")), F.lit("Z"))
    return F.coalesce(iso, text)


def display_ts(value: Column) -> Column:
    return F.coalesce(to_second(parsed_timestamp(value)), F.lit(""))


def kilobytes(size: Column) -> Column:
    return F.bround(F.coalesce(size, F.lit(0)) / F.lit(1024.0), 2)


def megabytes(size: Column) -> Column:
    return F.bround(F.coalesce(size, F.lit(0)) / F.lit(1048576.0), 2)


def gigabytes(size: Column) -> Column:
    return F.coalesce(size, F.lit(0)) / F.lit(1073741824.0)


def fq_name(catalog: Column, schema: Column, name: Column) -> Column:
    return F.concat_ws(
        ".",
        F.coalesce(catalog, F.lit("unknown")),
        F.coalesce(schema, F.lit("default")),
        F.coalesce(name, F.lit("")),
    )


def parse_fq(value: Column) -> Column:
    """``catalog.schema.rest`` as a struct; two parts have no name, one part is only a name."""
    parts = F.split(value, r"\.", 3)
    single = F.size(parts) == 1
    return F.struct(
        F.when(single, F.lit("")).otherwise(parts[0]).alias("catalog"),
        F.when(single, F.lit("")).otherwise(F.get(parts, 1)).alias("schema"),
        F.when(single, parts[0]).otherwise(F.coalesce(F.get(parts, 2), F.lit(""))).alias("name"),
    )


def table_key(catalog: Column, schema: Column, name: Column) -> Column:
    return F.concat_ws(
        "/",
        F.lit(TABLES_PREFIX),
        text_or(catalog, "default"),
        text_or(schema, "default"),
        text_or(name, "table"),
    )


def asset_key(path: Column) -> Column:
    return F.concat(F.lit(ASSETS_PREFIX + "/"), F.regexp_replace(path, "^/+", ""))
