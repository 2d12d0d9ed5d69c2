"""Column functions: time, text, and missing values. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that mark a downloaded body as a web page instead of data.
HTML_PREFIXES = ("<!doctype", "<!DOCTYPE", "<html", "<HTML")
#: The archive changed its file names on this day.
LONG_NAMES_FROM = "2023-08-07"


def finite(x: Column) -> Column:
    """Null for NaN and infinities; floats only."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 in UTC, rounded down; naive stamps are read as UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def aware_epoch(text: Column) -> Column:
    """Whole seconds since 1970 of an ISO time that names its zone; one that doesn't is refused, a null stays null."""
    zoned = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    fault = F.raise_error(F.concat(F.lit("a time without a zone: "), text)).cast("long")
    return F.when(text.isNull(), None).when(zoned, F.unix_seconds(F.to_timestamp(text))).otherwise(fault)


def ut_hours(epoch: Column) -> Column:
    """Decimal hour of the UTC day."""
    return F.pmod(epoch, F.lit(86400)) / F.lit(3600.0)


def epoch_date(epoch: Column) -> Column:
    return F.date_from_unix_date(F.floor(epoch / 86400).cast("int"))


def year_start(year: Column) -> Column:
    """Epoch of the first second of a UTC year."""
    return F.unix_date(F.make_date(year, F.lit(1), F.lit(1))).cast("long") * 86400


def day_key(day: Column) -> Column:
    """Year and day of year, as in 2015-001."""
    return F.concat_ws("-", F.lpad(F.year(day).cast("string"), 4, "0"), F.lpad(F.dayofyear(day).cast("string"), 3, "0"))


def key_day(key: Column) -> Column:
    """The date that ``day_key`` made a key of."""
    return F.date_add(F.make_date(F.split(key, "-")[0].cast("int"), F.lit(1), F.lit(1)), F.split(key, "-")[1].cast("int") - 1)


def stamp(year: Column, doy: Column, hour: Column, minute: Column) -> Column:
    """Epoch seconds of year, day of year, hour and minute."""
    return year_start(year) + (doy.cast("long") - 1) * 86400 + hour.cast("long") * 3600 + minute.cast("long") * 60


def map_file_names(day: Column, center: str) -> Column:
    """Candidate file names of a day, the likelier one first: short names before the change, long ones after."""
    doy = F.lpad(F.dayofyear(day).cast("string"), 3, "0")
    short = F.concat(F.lit(center.lower() + "g"), doy, F.lit("0."), F.lpad((F.year(day) % 100).cast("string"), 2, "0"), F.lit("i.Z"))
    long = F.concat(F.lit(center.upper() + "0OPSFIN_"), F.year(day).cast("string"), doy, F.lit("0000_01D_02H_GIM.INX.gz"))
    return F.when(day < F.lit(LONG_NAMES_FROM).cast("date"), F.array(short, long)).otherwise(F.array(long, short))


def download_outcome(code: Column, size: Column, body: Column, least: int = 2048) -> Column:
    """What a finished download counts as: ok, 404, auth, http_N, or why its content is bad."""
    return (
        F.when(code == 404, "404")
        .when(code.isin(401, 403), "auth")
        .when(code != 200, F.concat(F.lit("http_"), code.cast("string")))
        .when(size < least, "bad_content:too_small")
        .when(is_html(body), "bad_content:html_page")
        .otherwise("ok")
    )


def is_html(body: Column) -> Column:
    """Whether the first 256 characters, white space before them aside, begin as a web page does."""
    head = F.regexp_replace(F.substring(body, 1, 256), r"^[ \t\r\n]+", "")
    return F.coalesce(
        F.startswith(head, F.lit(HTML_PREFIXES[0]))
        | F.startswith(head, F.lit(HTML_PREFIXES[1]))
        | F.startswith(head, F.lit(HTML_PREFIXES[2]))
        | F.startswith(head, F.lit(HTML_PREFIXES[3])),
        F.lit(False),
    )


def permanent_gap(status: Column, reason: Column) -> Column:
    return F.coalesce((status == "failed") & (reason == "404"), F.lit(False))


def credential_failure(reason: Column) -> Column:
    return F.coalesce(reason.isin("auth", "bad_content:html_page"), F.lit(False))


def one_decimal(x: Column) -> Column:
    """Rounded to one decimal, halves to the even digit."""
    return F.rint(x * 10.0) / 10.0


def hours_text(hours: Column) -> Column:
    """Hours without needless zeros: 2, 0.5, 12."""
    return F.regexp_replace(F.format_string("%.6f", hours.cast("double")), r"\.?0+$", "")


def horizon_label(step: Column, cadence_seconds: int) -> Column:
    """How far back so many steps reach, as in 12h."""
    return F.concat(hours_text(step * cadence_seconds / 3600), F.lit("h"))


def lead_labels(steps: Column, cadence_seconds: int) -> Column:
    """Lead times of the first steps, as in +2/+4/+6h."""
    each = F.transform(F.sequence(F.lit(1), steps.cast("int")), lambda k: F.concat(F.lit("+"), hours_text(k * cadence_seconds / 3600)))
    return F.concat(F.array_join(each, "/"), F.lit("h"))


def step_label(step: Column, cadence_seconds: int) -> Column:
    """A single step's name, as in t+2h."""
    return F.concat(F.lit("t+"), horizon_label(step, cadence_seconds))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th ... 11th."""
    suffix = (
        F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    )
    return F.concat(n.cast("string"), suffix)


def subsolar_hour(hour: Column) -> Column:
    return F.pmod(F.pmod(hour, F.lit(24.0)) + 24.0, F.lit(24.0))


def wrap_longitude(degrees: Column) -> Column:
    """The same longitude from 0 to below 360."""
    return F.pmod(F.pmod(degrees, F.lit(360.0)) + 360.0, F.lit(360.0))


def driver_file_name(year: Column) -> Column:
    """Name of a year's five-minute driver file."""
    return F.concat(F.lit("omni_5min"), year.cast("string"), F.lit(".asc"))


def date_key(day: Column) -> Column:
    """A date as its file's name has it, 2015-02-01."""
    return F.date_format(day, "yyyy-MM-dd")


def two_digits(n: Column) -> Column:
    """A number below 100 in two digits; larger ones whole."""
    return F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def diverging(x: Column, limit: float = 30.0) -> Column:
    """Where a difference stands on a two-sided scale, from -1 to 1, full at the limit."""
    return F.least(F.greatest(x / F.lit(limit), F.lit(-1.0)), F.lit(1.0))


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return t * t * (3.0 - 2.0 * t)


def ecliptic_longitude(day_of_year: Column) -> Column:
    """Degrees of the sun along the ecliptic from the March equinox, uniform over the year; days count from 1, with fractions."""
    return F.pmod((day_of_year - 79) * F.lit(360.0 / 365.24), F.lit(360.0))


def year_list(text: Column) -> Column:
    """Years of a comma-separated list."""
    return F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda y: y.cast("int"))


def hour_slice(day_values: Column, hour: Column, cells: int) -> Column:
    """One hour's cells of a day's flat values."""
    return F.slice(day_values, hour * cells + 1, F.lit(cells))
