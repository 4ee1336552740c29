"""Times: modified Julian dates (double), Unix seconds, ISO-8601 text. All UTC."""

from pyspark.sql import Column, functions as F

from .blanks import as_column

# The Unix epoch as a modified Julian date, and the offset of Julian dates.
UNIX_EPOCH_MJD = 40587
JD_OFFSET = 2400000.5
_DAY = 86400


def unix_to_mjd(seconds) -> Column:
    return as_column(seconds) / float(_DAY) + float(UNIX_EPOCH_MJD)


def mjd_to_unix(mjd) -> Column:
    return (as_column(mjd) - float(UNIX_EPOCH_MJD)) * float(_DAY)


def jd_to_mjd(jd) -> Column:
    return as_column(jd) - JD_OFFSET


def _day_and_second(mjd) -> tuple[Column, Column]:
    """Calendar date and whole second of the day, rounded, without any session time zone."""
    seconds = F.round(as_column(mjd) * _DAY).cast("long")
    days = F.floor(seconds / _DAY).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days - UNIX_EPOCH_MJD), F.pmod(seconds, F.lit(_DAY))


def format_iso(mjd) -> Column:
    """``yyyy-mm-ddThh:mm:ss`` to the nearest second."""
    day, second = _day_and_second(mjd)
    clock = [F.floor(second / 3600), F.floor(second / 60) % 60, second % 60]
    text = F.concat_ws(":", *[F.lpad(c.cast("string"), 2, "0") for c in clock])
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), text)


def parse_iso(text) -> Column:
    """The MJD of ``yyyy-mm-dd`` with an optional time of day; blank when it is not a date."""
    text = as_column(text)
    parts = r"^\s*(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}(?:\.\d*)?))?)?Z?\s*$"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(text, parts, i).try_cast("double"), F.lit(0.0))

    day = F.datediff(F.regexp_extract(text, parts, 1).try_cast("date"), F.lit("1970-01-01").cast("date"))
    return day + float(UNIX_EPOCH_MJD) + (part(2) * 3600 + part(3) * 60 + part(4)) / _DAY


def timestamp_to_mjd(timestamp) -> Column:
    """The MJD of a timestamp; one without time zone is taken as UTC, whatever the session's zone."""
    timestamp = as_column(timestamp)
    instant = timestamp.cast("timestamp")
    as_utc = F.from_utc_timestamp(instant, F.current_timezone())
    zoned = F.typeof(timestamp) == "timestamp"
    micros = F.when(zoned, F.unix_micros(instant)).otherwise(F.unix_micros(as_utc))
    return micros / (_DAY * 1e6) + float(UNIX_EPOCH_MJD)


def day_of_year(mjd) -> Column:
    day, _ = _day_and_second(mjd)
    return F.dayofyear(day)


def year_to_mjd(year) -> Column:
    """The MJD of a calendar year with a fraction; the fraction is in units of that year's length."""
    year = as_column(year).cast("double")
    whole = F.floor(year).cast("int")
    start, end = F.make_date(whole, F.lit(1), F.lit(1)), F.make_date(whole + 1, F.lit(1), F.lit(1))
    since = F.datediff(start, F.lit("1970-01-01").cast("date"))
    return since + float(UNIX_EPOCH_MJD) + (year - whole) * F.datediff(end, start)
