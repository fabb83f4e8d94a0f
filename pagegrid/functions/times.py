"""Date, interval, back-off and cron expressions. ``now`` is always a parameter."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagegrid.functions.urls import let

# Lower and upper bound of each cron field, in order.
CRON_FIELDS = [("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("dow", 0, 7)]


def add_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_interval(mins=minutes)


def valid_interval(minutes: Column) -> Column:
    """Whole minutes in 1..10080, else null."""
    n = F.floor(minutes.cast("string").try_cast("double")).cast("int")
    return F.when(n.between(1, 10080), n)


def zoned_parts(ts: Column, tz: Column | str) -> Column:
    local = F.from_utc_timestamp(ts, tz)
    return F.struct(
        F.minute(local).alias("minute"),
        F.hour(local).alias("hour"),
        F.dayofmonth(local).alias("day"),
        F.month(local).alias("month"),
        (F.dayofweek(local) - 1).alias("dow"),
    )


def age_minutes(ts: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(60_000_000)).cast("long")


def not_negative_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000))).cast("long")


def month_day(d: Column) -> Column:
    return F.greatest(F.lit(1), F.dayofmonth(d))


def month_days(d: Column) -> Column:
    return F.greatest(F.lit(28), F.dayofmonth(F.last_day(d)))


def job_backoff_seconds(attempt: Column, jitter: Column, base: int = 15, factor: int = 2, cap: int = 900) -> Column:
    """Exponential back-off with up to 20 % jitter; ``jitter`` is a column in [0, 1)."""
    exp = F.lit(float(base)) * F.pow(F.lit(float(factor)), F.greatest(F.lit(0), attempt - 1))
    extra = F.floor(jitter * F.greatest(F.lit(1), F.floor(exp * 0.2)))
    return F.least(F.lit(cap), F.greatest(F.lit(base), F.floor(exp + extra))).cast("long")


def retry_delay_ms(strategy: Column, base: Column, attempt: Column, low: Column, high: Column, jitter_mode: Column, jitter_ms: Column, jitter: Column) -> Column:
    """Fixed, linear or exponential page retry delay within [low, high]; bounded jitter uses 45 % of its window."""
    attempt = F.greatest(F.lit(1), attempt)
    scaled = F.when(strategy == "linear", base * attempt).when(strategy == "exponential", base * F.pow(F.lit(2.0), attempt - 1)).otherwise(base)
    bounded = F.greatest(low, F.least(F.floor(scaled), high))
    window = F.when(jitter_mode == "full", jitter_ms).when(jitter_mode == "bounded", F.floor(jitter_ms * 0.45)).otherwise(0)
    return F.greatest(low, F.least(bounded + F.floor(jitter * window), high)).cast("long")


def list_retry_delay_ms(base: Column, factor: Column, attempt: Column, jitter: Column) -> Column:
    b = F.greatest(F.lit(0), F.least(F.lit(60000), base))
    f = F.greatest(F.lit(1), F.least(F.lit(5), factor))
    return F.least(F.lit(60000), F.least(F.lit(60000), F.floor(b * F.pow(f.cast("double"), attempt.cast("double")))) + jitter).cast("long")


def _base_values(token: Column, low: int, high: int) -> Column:
    """Array for '*', 'a-b' or 'a'; null when malformed or out of bounds."""

    def build(p: Column) -> Column:
        start, end = p["start"], p["end"]
        inside = (start >= low) & (end <= high) & (start <= end)
        return F.when(p["token"] == "*", F.sequence(F.lit(low), F.lit(high))).when(inside, F.sequence(start, F.greatest(start, end)))

    pieces = F.struct(
        token.alias("token"),
        F.split_part(token, F.lit("-"), F.lit(1)).try_cast("int").alias("start"),
        F.when(token.contains("-"), F.split_part(token, F.lit("-"), F.lit(2))).otherwise(token).try_cast("int").alias("end"),
    )
    return let(pieces, build)


def cron_values(field: Column, low: int, high: int, weekday: bool = False) -> Column:
    """Sorted distinct values of one cron field; null when invalid. Steps walk the value list by position."""

    def norm(values: Column) -> Column:
        return F.transform(values, lambda v: F.when(v == 7, 0).otherwise(v)) if weekday else values

    def stepped(values: Column, step: Column) -> Column:
        ordered = F.array_sort(F.array_distinct(values))
        return F.when(step > 0, F.filter(ordered, lambda _, i: i % F.greatest(F.lit(1), step) == 0))

    def segment(s: Column) -> Column:
        pieces = F.split(s, "/", -1)
        base = let(F.trim(F.get(pieces, F.lit(0))), lambda b: F.when((b == "") & s.contains("/"), F.lit("*")).otherwise(b))
        step = F.trim(F.get(pieces, F.lit(1))).try_cast("int")
        return let(
            F.struct(norm(let(base, lambda b: _base_values(b, low, high))).alias("values"), step.alias("step")),
            lambda p: F.when(~s.contains("/"), p["values"]).otherwise(stepped(p["values"], p["step"])),
        )

    def merge(expanded: Column) -> Column:
        ok = (F.size(expanded) > 0) & ~F.exists(expanded, lambda a: a.isNull())
        return F.when(ok, F.array_sort(F.array_distinct(F.flatten(expanded))))

    segments = F.filter(F.transform(F.split(F.trim(field), ",", -1), lambda x: F.trim(x)), lambda s: s != "")
    return let(F.transform(segments, segment), merge)


def cron_fields(expr: Column) -> Column:
    """Struct of five arrays plus ``valid``; arrays are null where a field is malformed."""

    def build(tokens: Column) -> Column:
        return F.struct(
            (F.size(tokens) == 5).alias("five"),
            *[cron_values(F.get(tokens, F.lit(i)), lo, hi, name == "dow").alias(name) for i, (name, lo, hi) in enumerate(CRON_FIELDS)],
        )

    def judge(k: Column) -> Column:
        valid = k["five"]
        for name, _, _ in CRON_FIELDS:
            valid = valid & k[name].isNotNull()
        return F.struct(*[k[name].alias(name) for name, _, _ in CRON_FIELDS], F.coalesce(valid, F.lit(False)).alias("valid"))

    tokens = F.split(F.trim(F.regexp_replace(F.coalesce(expr, F.lit("")), r"\s+", " ")), " ", -1)
    return let(let(tokens, build), judge)
