"""Birth dates and ages as written in texts: parsing, calendar checks and plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No one is older.
MAX_AGE = 150


def birthdate(value: Column) -> Column:
    """The date of YYYY-MM-DD, MM/DD/YYYY or, where the first number can't be a month, DD/MM/YYYY, with surrounding
    blanks; null for any other form and for days that the calendar doesn't have."""
    v = F.trim(value)
    part = lambda i, form: F.regexp_extract(v, form, i)
    iso, slashed = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([1-9][0-9]{3})$"
    day_first = F.coalesce(part(1, slashed).try_cast("int") > 12, F.lit(False))
    made = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    return (
        F.when(v.rlike(iso), made(part(1, iso), part(2, iso), part(3, iso)))
        .when(v.rlike(slashed) & day_first, made(part(3, slashed), part(2, slashed), part(1, slashed)))
        .when(v.rlike(slashed), made(part(3, slashed), part(1, slashed), part(2, slashed)))
    )


def is_birthdate(value: Column, today: Column | None = None) -> Column:
    """Whether a value is a calendar date whose year isn't in the future; null counts as no."""
    return F.coalesce(F.year(birthdate(value)) <= F.year(today if today is not None else F.current_date()), F.lit(False))


def age_at(born: Column, day: Column) -> Column:
    """Full years from birth to a day; null where no one has that age."""
    years = F.floor(F.months_between(day, born) / 12).cast("int")
    return F.when(plausible_age(years), years)


def plausible_age(years: Column) -> Column:
    return (years >= 0) & (years <= MAX_AGE)


def is_age(value: Column) -> Column:
    """Whether a value is a bare age that someone may have; null counts as no."""
    v = F.trim(value)
    return F.coalesce(v.rlike("^[0-9]{1,9}$") & plausible_age(v.try_cast("int")), F.lit(False))
