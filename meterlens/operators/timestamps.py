"""Text to timestamp, per row, for columns that mix formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted shapes. Year-first dates are read year, month, day; all others day first. Parts may be
# separated by dash, slash or dot and need no padding; a time may have a fraction of a second, AM/PM in any spelling
# ("p. m."), and a zone.
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.? ?[Mm]\.?)?"
_ZONE = r"(?: ?(?:[Zz]|UTC|[+-]\d{2}(?::?\d{2})?))?"
YEAR_FIRST = rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:[ T]{_TIME}{_ZONE})?$"
DAY_FIRST = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:[ T]{_TIME}{_ZONE})?$"
FIXED = r"^(\d{1,2})-(\d{1,2})-(\d{4}) (\d{1,2}):(\d{2}):(\d{2}) ([AaPp])[Mm]$"


def parse_timestamp(text: Column | str) -> Column:
    """``TIMESTAMP_NTZ`` from mixed text; null where no accepted shape fits.

    Fractions are kept to the microsecond. The clock time is taken as written: readings carry no zone, so a zone in the
    text is dropped. Where the day and month of a day-first date can only be the other way round, they are swapped.
    """
    raw = F.col(text) if isinstance(text, str) else text
    s = F.trim(F.regexp_replace(raw.cast("string"), r"[\s\x{a0}\x{202f}]+", " "))
    year_first = F.when(s.rlike(YEAR_FIRST), F.regexp_replace(s, YEAR_FIRST, "$1|$3|$4|$5|$6|$7|$9|$8|"))
    return _build(year_first.when(s.rlike(DAY_FIRST), F.regexp_replace(s, DAY_FIRST, "$4|$3|$1|$5|$6|$7|$9|$8|d")))


def parse_fixed_timestamp(text: Column | str) -> Column:
    """The 12-hour ``dd-mm-yyyy hh:mm:ss AM`` shape first, else any accepted shape."""
    raw = F.col(text) if isinstance(text, str) else text
    s = F.trim(raw.cast("string"))
    fixed = F.when(s.rlike(FIXED), F.regexp_replace(s, FIXED, "$3|$2|$1|$4|$5|$6|$7||"))
    return F.coalesce(_build(fixed), parse_timestamp(raw))


def _build(ordered: Column) -> Column:
    """Timestamp from ``year|month|day|hour|minute|second|half|fraction|swappable``; a missing time is midnight."""

    def stamp(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
        # Two-digit years: 69-99 belong to the last century.
        century = F.when(number(0) >= 69, 1900).otherwise(2000)
        year = number(0) + F.when(F.length(part(0)) == 2, century).otherwise(0)
        swap = (part(8) == "d") & (number(1) > 12) & (number(2) <= 12)
        month, day = (F.when(swap, number(b)).otherwise(number(a)) for a, b in ((1, 2), (2, 1)))
        half = F.lower(part(6))
        clock12 = number(3) % 12 + F.when(half == "p", 12).otherwise(0)
        on_dial = F.when(number(3).between(1, 12), clock12)  # 0 or 13 with AM/PM is no time
        hour = F.when(half == "", number(3)).otherwise(on_dial)
        micros = F.substring(F.rpad(part(7), 6, "0"), 1, 6)
        second = F.concat(number(5).cast("string"), F.lit("."), micros).try_cast("decimal(16,6)")
        return F.try_make_timestamp_ntz(year, month, day, hour, number(4), second)

    # The one-element transform names the split parts, so the text is matched once per row.
    return F.get(F.transform(F.array(F.split(ordered, r"\|")), stamp), F.lit(0))
