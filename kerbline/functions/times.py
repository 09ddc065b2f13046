"""Times: epoch seconds of zone-less timestamps, epoch-aligned buckets, mixed time formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 as double, to the microsecond; a timestamp without zone counts as UTC."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp_ntz")) / 1e6


def bucket_start(epoch: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket as whole epoch seconds."""
    return (F.floor(epoch / seconds) * seconds).cast("long")


def auto_bucket(span_s: float) -> int:
    """Bucket width in seconds for a span."""
    for longest, width in ((3600, 60), (6 * 3600, 300), (86_400, 900), (7 * 86_400, 3600)):
        if span_s <= longest:
            return width
    return 21_600


def parsed(value: Column) -> Column:
    """Timestamp from text that is either epoch seconds or an ISO time."""
    number = value.try_cast("double")
    return F.coalesce(F.timestamp_micros((number * 1e6).cast("long")), F.try_to_timestamp(value))


#: Seconds of the named periods, and the longest span that may be asked for.
PERIODS, LONGEST_S = {"15m": 900, "1h": 3600, "6h": 6 * 3600, "24h": 86_400, "7d": 7 * 86_400, "30d": 30 * 86_400}, 92 * 86_400


def window_of(now: float, period: str = "1h", since: float | None = None, until: float | None = None) -> tuple[float, float]:
    """The half-open span [since, until) that is asked for: a named period up to now unless its ends are given; ``until`` is now at the latest."""
    until = now if until is None else min(until, now)
    since = until - PERIODS[period] if since is None else since
    if since >= until:
        raise ValueError("the span's start must be before its end")
    if until - since > LONGEST_S:
        raise ValueError("the span is longer than 92 days")
    return since, until
