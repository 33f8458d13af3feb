"""Wall-clock parsing, time zones and formatting.

A wall clock is a TIMESTAMP_NTZ. Every function below gives the same result in any session time
zone: parsing goes through an explicit +0000 offset and zone shifts work on seconds, so a session in
a daylight-saving zone cannot move the hours that zone skips.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridcast.functions import as_col

LOCAL_ZONE = "America/New_York"

# Fixed formats of the hourly files.
US_12H = "M/d/yyyy h:mm:ss a"
ISO_SPACE = "yyyy-MM-dd HH:mm:ss"
ISO_T = "yyyy-MM-dd'T'HH:mm:ss"

# What a text in one of them looks like; there is no year 0.
_PLAIN = {f: rf"^(?!0000)[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{sep}[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\z" for f, sep in ((ISO_SPACE, " "), (ISO_T, "T"))}

# Formats tried, in order, when a text is not in the expected one.
GENERAL_FORMATS = (
    ISO_SPACE,
    ISO_T,
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "M/d/yyyy h:mm a",
    "MMM d, yyyy",
    "MMM d, yyyy h:mm:ss a",
    "MMM d, yyyy H:mm:ss",
    "MMMM d, yyyy",
    "d MMM yyyy",
)
# With a fraction of a second, which is kept.
FRACTION_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
# With an offset: these name an instant.
OFFSET_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XX",
)


def _epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def parse_fixed_ts(c: Column | str, fmt: str = US_12H) -> Column:
    """text in one format to a wall clock; anything else is null."""
    slow = _shift(_epoch(), F.unix_seconds(_instant(c, fmt)))
    if fmt not in _PLAIN:
        return slow
    # A cast reads these two at a fraction of the cost; it takes more forms, hence the test of the form.
    c = as_col(c)
    return F.coalesce(F.when(c.rlike(_PLAIN[fmt]), c.try_cast("timestamp_ntz")), slow)


def _instant(c: Column | str, fmt: str) -> Column:
    return F.try_to_timestamp(F.concat(as_col(c), F.lit(" +0000")), F.lit(fmt + " xx"))


def _shift_micros(instant: Column) -> Column:
    return _epoch() + F.expr("interval '0.000001' second") * F.unix_micros(instant)


def parse_coalesced_ts(
    c: Column | str, first: str = US_12H, others: tuple[str, ...] = GENERAL_FORMATS, zone: str = LOCAL_ZONE
) -> Column:
    """the first format that fits, else null. A fraction of a second is kept; a text with an offset
    names an instant and gives the wall clock of ``zone`` at that instant."""
    fractions = [_shift_micros(_instant(c, f)) for f in FRACTION_FORMATS]
    offsets = [utc_to_local(_shift_micros(F.try_to_timestamp(as_col(c), F.lit(f))), zone) for f in OFFSET_FORMATS]
    rest = F.coalesce(*[parse_fixed_ts(c, f) for f in others], *fractions, *offsets)
    # Each format that fails costs more than one that fits, and a text without digits fits none.
    return F.coalesce(parse_fixed_ts(c, first), F.when(as_col(c).rlike("[0-9]"), rest))


def _clock_seconds(w: Column) -> Column:
    """Seconds of a wall clock since 1970, as if it were UTC. Names ``w`` once, so a filter pushed
    through several of these functions stays small."""
    return (w - _epoch()).cast("interval second").cast("bigint")


def _to_utc_s(s: Column, zone: str) -> Column:
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(s), zone))


def _from_utc_s(s: Column, zone: str) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), zone))


def _shift(w: Column, seconds: Column) -> Column:
    # A product of whole numbers; building the interval from parts would go through decimals.
    return w + F.expr("interval '1' second") * seconds


def plus_hours(w: Column, hours: Column) -> Column:
    return w + F.expr("interval '1' hour") * hours


def local_to_utc(w: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock of ``zone`` to the UTC clock; an ambiguous one counts as the earlier instant."""
    w = as_col(w)
    s = _clock_seconds(w)
    return _shift(w, _to_utc_s(s, zone) - s)


def utc_to_local(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """UTC clock to the wall clock of ``zone``."""
    w = as_col(ts)
    s = _clock_seconds(w)
    return _shift(w, _from_utc_s(s, zone) - s)


def is_nonexistent(w: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """The wall clock falls into the gap of the spring change."""
    s = _clock_seconds(as_col(w))
    return _from_utc_s(_to_utc_s(s, zone), zone) != s


def is_ambiguous(w: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """The wall clock happens twice at the autumn change."""
    s = _clock_seconds(as_col(w))
    u = _to_utc_s(s, zone)
    return (_from_utc_s(u + 3600, zone) == s) | (_from_utc_s(u - 3600, zone) == s)


def localize_or_null(w: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """keep a wall clock that names exactly one instant, null the others.

    Nearly all rows have the same offset a day before and a day after; only the rest pays for the
    exact test.
    """
    w = as_col(w)
    s = _clock_seconds(w)
    same_offset = _to_utc_s(s + 86400, zone) - _to_utc_s(s - 86400, zone) == 172800
    return F.when(same_offset, w).when(~is_nonexistent(w, zone) & ~is_ambiguous(w, zone), w)


def floor_hour(w: Column | str) -> Column:
    """beginning of the hour; stays TIMESTAMP_NTZ."""
    w = as_col(w)
    return plus_hours(F.to_date(w).cast("timestamp_ntz"), F.hour(w))


def format_ts(w: Column | str, fmt: str = US_12H) -> Column:
    """F8: wall clock to text, ``M/d/yyyy h:mm:ss a`` by default.

    The three fixed formats are put together from the clock's own parts. Any other pattern goes
    through the session's time zone and wants a session in UTC.
    """
    w = as_col(w)
    iso = F.substring(w.cast("string"), 1, 19)
    if fmt == ISO_SPACE:
        return iso
    if fmt == ISO_T:
        return F.translate(iso, " ", "T")
    if fmt == US_12H:
        hour = F.hour(w)
        day = F.concat_ws("/", F.month(w), F.dayofmonth(w), F.year(w))
        clock = F.concat((hour + 11) % 12 + 1, F.substring(iso, 14, 6), F.when(hour < 12, " AM").otherwise(" PM"))
        return F.when(w.isNotNull(), F.concat_ws(" ", day, clock))
    return F.date_format(w, fmt)


def pad_seconds(c: Column | str) -> Column:
    """append ``:00`` to a text that ends in HH:MM."""
    c = as_col(c)
    return F.when(F.size(F.split(c, ":")) == 2, F.concat(c, F.lit(":00"))).otherwise(c)


def next_day_of(as_of: Column | str) -> Column:
    """the day after the run date."""
    return F.date_add(as_col(as_of), 1)


def month_end(day: Column | str, as_of: Column | str | None = None) -> Column:
    """last day of the month, not later than the run date."""
    last = F.last_day(as_col(day))
    return last if as_of is None else F.least(last, as_col(as_of))
