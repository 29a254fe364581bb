"""Functions of time: instants known to a precision, buckets, and values whose unit has to be guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import text as x
from tidewater.functions import vocabulary as v


def minute(at: Column) -> Column:
    return F.date_format(F.date_trunc("minute", at), "yyyy-MM-dd'T'HH:mm")


def iso(at: Column) -> Column:
    """An instant in ISO form, to the second, in UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def precision(name: Column) -> Column:
    names = F.create_map(*[F.lit(n) for pair in v.PRECISION_NAMES.items() for n in pair])
    return F.coalesce(F.element_at(names, F.coalesce(name, F.lit(""))), F.when(F.coalesce(name, F.lit("")) == "", "unknown"), name)


def _written(when: Column) -> tuple[Column, Column, Column]:
    """The text with a month's first day added, its instant (UTC if it names no zone), and whether it names one."""
    text = x.stripped(when)
    text = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    text = F.regexp_replace(text, r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})$", "$1:00$2")
    good = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)?$")
    return text, F.when(good, text.try_cast("timestamp")), text.rlike(r"\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")


def instant(when: Column, grain: Column, zone: str) -> Column:
    """The instant by which an event is sorted: a stated time by its zone, a day, week or month by its first midnight in UTC."""
    text, at, zoned = _written(when)
    grain = precision(grain)
    day = F.when(at.isNotNull(), F.left(text, F.lit(10)).try_cast("timestamp"))
    return (
        F.when(grain == "exact", F.when(zoned, at).otherwise(F.to_utc_timestamp(at, zone)))
        .when(grain == "week", F.date_trunc("week", day))
        .when(grain == "month", F.date_trunc("month", day))
        .otherwise(day)
    )


def iso_week(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def bucket(kind: Column, action: Column, when: Column, grain: Column, title: Column, zone: str) -> Column:
    """The day, week or month that tells mentions of one event from those of another; undated ones go by title."""
    text, at, zoned = _written(when)
    day = F.when(at.isNotNull(), F.when(zoned, F.to_date(F.from_utc_timestamp(at, zone))).otherwise(F.to_date(F.left(text, F.lit(10)))))
    monthly = (grain == "month") | ((kind == "medication") & F.coalesce(action.isin(*v.MONTHLY_ACTIONS), F.lit(False)))
    return (
        F.when(day.isNull(), F.concat(F.lit("undated:"), F.left(F.sha1(x.slug(title)), F.lit(8))))
        .when(monthly, F.date_format(day, "yyyy-MM"))
        .when(grain == "week", iso_week(day))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )


def sniffed(value: Column) -> Column:
    """An instant from ISO text, epoch seconds or epoch milliseconds; null for anything else."""
    text = x.stripped(value)
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    seconds = F.when(number > 1e11, number / 1000).when(number > 0, number)
    known = F.when(seconds < 253402300800, F.timestamp_micros((seconds * 1_000_000).cast("long")))
    return F.when(number.isNotNull(), known).otherwise(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp")))


def duration(payload: Column) -> Column:
    """Seconds of audio that a JSON payload declares, at one of the places where they may stand; large numbers are milliseconds."""
    keys = ("duration", "seconds", "duration_seconds", "length")
    paths = [f"$.{k}" for k in keys] + [f"$.{m}.{k}" for m in ("audio", "voice", "ptt") for k in keys]
    numbers = [x.stripped(F.get_json_object(payload, p)).try_cast("double") for p in paths]
    return F.coalesce(*[F.when(n > 6000, n / 1000).when(n > 0, n) for n in numbers])


def shown(at: Column, grain: Column, zone: str) -> Column:
    """A date as precise as it is known."""
    local = F.from_utc_timestamp(at, zone)
    day = F.date_format(local, "yyyy-MM-dd")
    return (
        F.when(grain == "exact", F.date_format(local, "yyyy-MM-dd HH:mm"))
        .when(grain == "week", F.concat(F.lit("week of "), day))
        .when(grain == "month", F.concat(F.date_format(local, "yyyy-MM"), F.lit(" (month only)")))
        .when(grain == "unknown", F.concat(day, F.lit(" (date uncertain)")))
        .otherwise(day)
    )


def local_day(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def countdown(at: Column, now: Column, zone: str) -> Column:
    """Local days from ``now`` to an event."""
    return F.datediff(local_day(at, zone), local_day(now, zone))


def day_heading(at: Column, now: Column, zone: str) -> Column:
    days = countdown(at, now, zone)
    return F.when(days == 0, "Today").when(days == -1, "Yesterday").otherwise(F.date_format(local_day(at, zone), "EEEE d MMMM yyyy"))


def window_start(at: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(at) / seconds) * seconds)


def retry_after(at: Column, seconds: int) -> Column:
    """Seconds until the window of ``at`` ends, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.unix_timestamp(window_start(at, seconds)) + seconds - F.unix_timestamp(at))


def date_matches(said: Column, said_grain: Column, found: Column, found_grain: Column, zone: str) -> Column:
    """Whether two dates agree, as precisely as the first is said: an unknown one always does, and a missing second never else.

    Exact times count by the zone's day; days, weeks and months are kept as midnights in UTC and count as they stand.
    """
    day = lambda at, grain: F.when(precision(grain) == "exact", local_day(at, zone)).otherwise(F.to_date(at))
    a, b, grain = day(said, said_grain), day(found, found_grain), precision(said_grain)
    same = F.when(grain == "month", F.trunc(a, "month") == F.trunc(b, "month")).when(grain == "week", F.date_trunc("week", a) == F.date_trunc("week", b)).otherwise(a == b)
    return F.when(grain == "unknown", F.lit(True)).otherwise(F.coalesce(same, F.lit(False)))


def from_wall_clock(shown: Column, zone: str) -> Column:
    """The instant at which clocks of a zone show a time; of two, when they go back, the first."""
    return F.to_utc_timestamp(shown.cast("timestamp"), zone)
