"""Numbers, dates, coercions and set algebra, as Columns."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_sum(*xs: Column) -> Column:
    """The sum of what is not null; null if all are."""
    total = reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0)) for x in xs))
    return F.when(F.coalesce(*xs).isNotNull(), total)


def true_count(*flags: Column) -> Column:
    """How many flags are true; null instead of 0."""
    return F.nullif(reduce(lambda a, b: a + b, (F.coalesce(x.cast("int"), F.lit(0)) for x in flags)), F.lit(0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def closeness(days: Column, window: int) -> Column:
    """1 on the same day, falling in a line to 0 at the window."""
    return F.greatest(F.lit(0.0), 1 - F.abs(days) / F.lit(float(window)))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(w) * F.coalesce(x, F.lit(0.0)) for w, x in parts))


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds between, 0 at least; null if an end is."""
    seconds = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0.0), seconds / F.lit(1e6)))


def age_bucket(at: Column, as_of: Column, steps: list[tuple[int, str]], last: str) -> Column:
    """The name of the first step (hours, name) that the age does not exceed."""
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(3.6e9)
    out = F.when(at.isNull(), F.lit(last))
    for h, name in steps:
        out = out.when(hours <= h, F.lit(name))
    return out.otherwise(F.lit(last))


def age_label(at: Column, as_of: Column) -> Column:
    """How long ago, in words."""
    m = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(6e7))
    return (
        F.when(at.isNull(), F.lit("never"))
        .when(m < 1, F.lit("just now"))
        .when(m < 60, F.concat(m.cast("string"), F.lit(" min ago")))
        .when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit(" d ago")))
    )


def parse_iso(x: Column) -> Column:
    """An ISO-8601 time with Z or an offset, null where it is none."""
    return F.try_to_timestamp(x)


def local_day(at: Column, zone: str, offset: int = 0) -> Column:
    return F.date_add(F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone)), offset)


def coerce_date(x: Column) -> Column:
    """A date in one of the forms that sheets hold."""
    return F.coalesce(*(F.try_to_date(x, f) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(x, F.lit(f))) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM-dd-yyyy", "yyyy-MM-dd HH:mm:ss")))


def coerce_int(x: Column) -> tuple[Column, Column]:
    """(value, error) of a cell: whole numbers pass, also written with a zero fraction; blank is null."""
    t = F.trim(x)
    number = F.when(t.rlike(r"^[+-]?[0-9]+(\.0+)?$"), F.try_cast(F.regexp_replace(t, r"\.0+$", ""), "bigint") if hasattr(F, "try_cast") else F.regexp_replace(t, r"\.0+$", "").try_cast("bigint"))
    return number, F.when((t != "") & number.isNull(), F.concat(F.lit("not a whole number: "), x))


def coerce_flag(x: Column) -> tuple[Column, Column]:
    """(value, error) of a yes/no cell."""
    t = F.lower(F.trim(x))
    flag = F.when(t.isin("1", "true", "yes", "y", "1.0"), F.lit(True)).when(t.isin("0", "false", "no", "n", "0.0"), F.lit(False))
    return flag, F.when((t != "") & flag.isNull(), F.concat(F.lit("not yes or no: "), x))


def coerce_count(x: Column) -> tuple[Column, Column]:
    """(value, error) of a count: a whole number that is not negative."""
    n, error = coerce_int(x)
    return F.when(n >= 0, n), F.coalesce(error, F.when(n < 0, F.concat(F.lit("negative: "), x)))


def coerce_direct(x: Column) -> tuple[Column, Column]:
    """(value, error) of a direct/indirect mark: D or I."""
    t = F.lower(F.trim(x))
    mark = F.when(t.isin("d", "direct"), F.lit("D")).when(t.isin("i", "indirect"), F.lit("I"))
    return mark, F.when((t != "") & mark.isNull(), F.concat(F.lit("neither D nor I: "), x))


def map_diff(old: Column, new: Column) -> Column:
    """Entries of new that differ from old, null-safely."""
    return F.map_filter(new, lambda k, v: ~v.eqNullSafe(F.element_at(old, k)))


def sorted_set(xs: Column) -> Column:
    """Sorted distinct values in lower case, blanks dropped."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(xs, lambda x: F.lower(F.trim(x))), lambda x: x != "")))
