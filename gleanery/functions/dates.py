"""Date functions on columns. The session's time zone is UTC; `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats tried in order where a text is neither a number nor ISO.
FORMATS = [
    "EEE, d MMM yyyy HH:mm:ss Z", "EEE, d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy",
]
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def epoch(n: Column) -> Column:
    """Seconds, or milliseconds from 1e11 on; zero is none."""
    seconds = F.when(n > 1e11, n / 1000).otherwise(n.cast("double"))
    return F.when((n != 0) & (seconds < 253402300800), F.timestamp_seconds(seconds))


def parsed(text: Column) -> Column:
    """Timestamp of an epoch number, an ISO date, a mail date or one of the formats; null for others."""
    text = F.trim(text)
    words = F.regexp_replace(text, r"\bGMT$|\bUT$", "+0000")
    tries = [F.when(text.rlike(ISO), F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))]
    tries += [F.try_to_timestamp(words, F.lit(f)) for f in FORMATS if not f.startswith("EEE")]
    # the day's name says nothing that the date does not
    bare = F.regexp_replace(words, r"^[A-Za-z]{3},\s*", "")
    tries += [F.try_to_timestamp(bare, F.lit(f.removeprefix("EEE, "))) for f in FORMATS if f.startswith("EEE")]
    return F.when(text.rlike(r"^\d{1,18}$"), epoch(text.try_cast("long"))).otherwise(F.coalesce(*tries))


def staleness(posted: Column, expires: Column, now: Column, most_days: int) -> Column:
    """Why a posting is stale, null if it is fresh."""
    age = F.floor((F.unix_micros(now) - F.unix_micros(posted)) / 86_400_000_000)
    expired = F.concat(F.lit("Posting expired on "), F.date_format(expires, "yyyy-MM-dd"))
    old = F.concat(F.lit("Posted "), age.cast("string"), F.lit(f" days ago (limit {most_days})"))
    return F.when(expires < now, expired).when(posted < now - F.make_dt_interval(days=F.lit(most_days)), old)


def local_day(ts: Column, timezone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, timezone))


def months_between_years(start_year: Column, start_month: Column, end_year: Column, end_month: Column) -> Column:
    """Months of experience, both ends included, never negative."""
    return F.greatest(F.lit(0), (end_year - start_year) * 12 + end_month - start_month)
