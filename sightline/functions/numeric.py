"""Dates, ages, prices and report labels as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline import constants as K


def _nonzero(col: Column) -> Column:
    return F.when(col != 0, col)


def round2(x: Column) -> Column:
    """Non-negative double to two digits, half-even on its exact binary value.

    ``round`` and ``bround`` look at the printed decimal, so that 70.695, which is
    stored slightly lower, would go up. The distance to the half-way point
    ``(2m + 1) / 200`` is exact here: ``x`` is split in two parts short enough that
    no product is rounded.
    """
    m = F.floor(x * 100)
    big = x * 134217729.0
    high = big - (big - x)
    over = (high * 200 - (m * 2 + 1)) + (x - high) * 200
    up = (over > 0) | ((over == 0) & (m % 2 == 1))
    return F.when(up, (m + 1) / 100.0).otherwise(m / 100.0)


def derived_psf(psf: Column, rent: Column, area: Column) -> Column:
    """Price per area unit to two digits, where it is not given."""
    ratio = F.try_divide(_nonzero(rent).cast("double"), _nonzero(area).cast("double"))
    return F.coalesce(psf, F.when(ratio.isNotNull(), round2(ratio)))


def ratio_close(a: Column, b: Column, tolerance: float) -> Column:
    x, y = _nonzero(a).cast("double"), _nonzero(b).cast("double")
    ratio = F.when(x.isNotNull() & y.isNotNull(), F.try_divide(F.abs(x - y), F.greatest(x, y)))
    return F.coalesce(ratio <= tolerance, F.lit(False))


def age_days(start: Column, end: Column) -> Column:
    """Days from one timestamp to another, never below 0; null if either is missing."""
    days = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86400e6)
    return F.when(days < 0, F.lit(0.0)).otherwise(days)


def lag_bucket(age: Column) -> Column:
    first, second, third, more, unknown = K.LAG_BUCKETS
    return (
        F.when(age.isNull(), F.lit(unknown))
        .when(age <= 7, F.lit(first))
        .when(age <= 14, F.lit(second))
        .when(age <= 30, F.lit(third))
        .otherwise(F.lit(more))
    )


def full_years(since: Column, as_of: Column) -> Column:
    """Whole years between dates by the birthday rule, never below 0."""
    before = F.struct(F.month(as_of), F.dayofmonth(as_of)) < F.struct(F.month(since), F.dayofmonth(since))
    years = F.year(as_of) - F.year(since) - before.cast("int")
    return F.when(years < 0, F.lit(0)).otherwise(years)


def age_from_iso_date(text: Column, as_of: Column) -> Column:
    valid = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ])"), F.left(text, F.lit(10)))
    return full_years(valid.try_cast("date"), as_of)


def age_from_millis(millis: Column, as_of: Column) -> Column:
    ms = _nonzero(millis.try_cast("double")).try_cast("bigint")
    return full_years(F.to_date(F.timestamp_millis(ms)), as_of)


def int_or_none(col: Column) -> Column:
    """Number truncated towards zero; anything else is null."""
    return col.try_cast("double").try_cast("int")


def layout_from_bedroom(col: Column) -> Column:
    n = F.regexp_replace(col.cast("string"), r"\.0+$", "").try_cast("int")  # a JSON number may be spelt 2.0
    return F.when(n == 0, F.lit(K.STUDIO)).otherwise(F.concat(n.cast("string"), F.lit(K.ROOM)))


def start_of_local_day(started_at: Column, local_date: Column) -> Column:
    """Start of ``local_date`` in the session zone, for a run started at ``started_at``."""
    return F.when(started_at.isNotNull(), local_date.cast("timestamp"))


def discount_pct(psf: Column, avg: Column) -> Column:
    return F.try_divide((psf - avg), avg) * 100


def delta(current: Column, previous: Column) -> Column:
    return current - previous


def action_note(
    discount: Column, rent: Column, sources: Column, age: Column, low_rent: Column, fresh: bool = False
) -> Column:
    """Reasons to look at a row, in fixed order; '-' when there is none."""
    pct = F.format_string("%.0f", F.bround(F.abs(discount), 0))
    parts = [
        F.lit(K.NOTE_NEW) if fresh else F.lit(None).cast("string"),
        F.when(discount <= K.VALUE_DISCOUNT_PCT, F.concat(F.lit(K.NOTE_DISCOUNT), pct, F.lit("%"))),
        F.when(rent <= low_rent, F.lit(K.NOTE_BUDGET)),
        F.when(sources >= 2, F.lit(K.NOTE_CROSS)),
        F.when(age <= 1, F.lit(K.NOTE_JUST)),
    ]
    note = F.concat_ws(K.NOTE_JOIN, *parts)
    return F.when(note == "", F.lit("-")).otherwise(note)


def nice_step(value: Column) -> Column:
    """Smallest of 1, 2, 5 or 10 times a power of ten that reaches ``value``; 500 at least, 1000 for none."""
    v = F.when(value > 0, value.cast("double"))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    step = F.when(unit >= v, unit).when(unit * 2 >= v, unit * 2).when(unit * 5 >= v, unit * 5).otherwise(unit * 10)
    return F.when(v.isNotNull(), F.greatest(F.lit(500), step.cast("bigint"))).otherwise(F.lit(1000))


def date_in_range(text: Column, after: Column, upto: Column) -> Column:
    """``after < text <= upto``; a text that is no date is outside."""
    d = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).try_cast("date")
    return F.coalesce((d > after) & (d <= upto), F.lit(False))
