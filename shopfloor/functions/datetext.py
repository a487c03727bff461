"""Date texts as staff pages show them, read into one timestamp.

An ordered set of guarded shapes (ISO is tried first and on its own): every
shape is one anchored pattern; its parts are put together to one ISO text,
which is cast once.  A text without a zone is local (session) time; a day that
its month does not have is no date.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES — what a browser reads as a date.
DATE_RE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
ZONE_HOURS = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
STARTS_RE, ENDS_RE = r"^[\w+\-]", r"[\w+\-]$"  # first and last character of a text that counts as a date

LONGEST = 80  # no accepted text is longer (a zone's comment included)
_MONTH = rf"({'|'.join(MONTHS)})[a-z]*\.?"
_DAY_NAME = rf"(?:(?:{'|'.join(WEEKDAYS)})[a-z]*\.?,?\s+)?"
_CLOCK = (
    r"(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?:\s*([ap])\.?m\.?)?"
    rf"(?:\s*({'|'.join(ZONE_HOURS)})?\s*([+-]\d{{2}}:?\d{{2}})?(?:\s*\([^)]*\))?)?)?"
)
# pattern of the day, and which of its groups are year, month and day
SHAPES = [
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 1, 2)),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", (1, 2, 3)),
    (rf"{_DAY_NAME}{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})", (3, 1, 2)),
    (rf"{_DAY_NAME}(\d{{1,2}})[\s-]+{_MONTH}[\s-]+(\d{{4}})", (3, 2, 1)),
]


def _iso_text(parts: Column) -> Column:
    """year, month, day, hour, minute, second, fraction, half of the day, zone and offset as an ISO date-time."""
    year, month, day, hour, minute, second, fraction, half, zone, offset = (F.get(parts, k) for k in range(10))
    pad = lambda c: F.lpad(c, 2, "0")
    number = F.floor((F.instr(F.lit("".join(MONTHS)), month) + 2) / 3).cast("string")
    date = F.concat(year, F.lit("-"), pad(F.when(month.rlike("^[a-z]"), number).otherwise(month)), F.lit("-"), pad(day))
    clock = hour.try_cast("int")
    # an hour above 12 with AM or PM is no time
    clock = F.when(half == "", clock).when(clock <= 12, clock % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(99)
    hours = F.from_json(F.lit(json.dumps({n: f"{h:+03d}:00" for n, h in ZONE_HOURS.items()})), "map<string,string>")
    shift = F.when(offset != "", F.regexp_replace(offset, r"(\d{2}):?(\d{2})", "$1:$2")).otherwise(F.coalesce(F.try_element_at(hours, zone), F.lit("")))
    time = F.concat(
        F.lit("T"), pad(clock.cast("string")), F.lit(":"), minute, F.lit(":"), F.when(second == "", "00").otherwise(second),
        F.when(fraction == "", "").otherwise(F.concat(F.lit("."), F.substring(fraction, 1, 6))), shift,
    )
    return F.concat(date, F.when(hour == "", "").otherwise(time))


def may_be_date(s: Column) -> Column:
    """Cheap guard: short, and led by a digit or by the first letters of a month or weekday."""
    lead = F.lower(F.substring(s, 1, 3))
    return (F.length(s) <= LONGEST) & (F.substring(s, 1, 1).between("0", "9") | lead.isin(*MONTHS, *WEEKDAYS))


def parse_date(s: Column) -> Column:
    """Timestamp of a date text; NULL where it is none."""
    low = F.lower(s)
    parts = F.lit(None).cast("string")
    for day, groups in reversed(SHAPES):
        pattern = f"^{day}{_CLOCK}$"
        found = F.regexp_replace(low, pattern, "|".join(f"${g}" for g in (*groups, *range(4, 11))))
        parts = F.when(low.rlike(pattern), found).otherwise(parts)
    # one lambda builds the text, whatever the shape (the plan stays small)
    built = F.get(F.transform(F.array(F.split(parts, r"\|")), _iso_text), 0)
    iso = F.when(s.rlike(DATE_RE), s).otherwise(built)
    return F.when(may_be_date(s), iso).try_cast("timestamp")


def is_date(s: Column) -> Column:
    """Whether a grid takes the text for a date: it parses, and begins and ends with a word character or sign."""
    return F.when(may_be_date(s), s.rlike(STARTS_RE) & s.rlike(ENDS_RE) & parse_date(s).isNotNull()).otherwise(False)
