"""Column expressions that turn numbers and times into words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units from small to large.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_size(num_bytes: Column) -> Column:
    """``1536`` -> ``1.5 KB``; whole bytes stay whole."""
    value = num_bytes.cast("double")
    out = None
    for power, unit in enumerate(SIZE_UNITS):
        scaled = value / float(1024 ** power)
        text = F.concat(F.format_number(scaled, 0 if power == 0 else 1), F.lit(" " + unit))
        if power == len(SIZE_UNITS) - 1:
            return out.otherwise(text)
        fits = F.abs(scaled) < 1024.0
        out = F.when(fits, text) if out is None else out.when(fits, text)


def signed(number: Column) -> Column:
    return F.when(number > 0, F.concat(F.lit("+"), number.cast("string"))).otherwise(number.cast("string"))


def plural(count: Column, noun: str) -> Column:
    return F.concat(count.cast("string"), F.lit(" " + noun), F.when(count != 1, F.lit("s")).otherwise(F.lit("")))


def age_label(ts: Column, as_of: Column) -> Column:
    """How long before ``as_of``, in words; the date itself past sixty days."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    minutes, hours, days = (F.floor(seconds / n).cast("bigint") for n in (60, 3600, 86400))

    def ago(value: Column, noun: str) -> Column:
        return F.concat(plural(value, noun), F.lit(" ago"))

    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(minutes < 60, ago(minutes, "minute"))
        .when(hours < 24, ago(hours, "hour"))
        .when(days == 1, F.lit("yesterday"))
        .when(days < 14, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 60, ago(F.floor(days / 7).cast("bigint"), "week"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
