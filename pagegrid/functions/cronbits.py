"""Next run of cron fields in a time zone, by arithmetic on bit words.

The values of a field are bits of a word, and the next value is the lowest bit that is left above a place. Months are
turned into a word of matching days (days of the month and weekdays together), so a day is found a month at a time.

Between two changes of a zone's offset local time runs evenly. A zone's stretches between changes are a short sorted array;
the search starts in the stretch that holds the start and goes on to later ones while nothing is found. Times that a zone
skips never come up, repeated ones come up twice, whole days included. All of it is local to a row and stays in the JVM.

The session time zone must be UTC.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagegrid.functions.times import CRON_FIELDS

c = F.col

_DAY, _DAY_MINUTES = 86_400, 1_440
#: months after the first that a search of 366 days can reach
_MONTHS = 13
#: names of fixed offsets that only the engine's short list knows
_SHORT = ("EST", "MST", "HST")


# Expressions are put together as text: the search is a few hundred operators, which the parser reads at once.


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` bound to ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _bits(values: str) -> str:
    """A word with a bit for each value (below 63)."""
    return f"aggregate({values}, 0L, (word, v) -> word | shiftleft(1L, v))"


def _next_bit(word: str, place: str) -> str:
    """The lowest bit of ``word`` at or above ``place``; null if there is none."""
    return _let(f"({word}) & shiftleft(-1L, cast({place} as int))", "left_bits", "case when left_bits <> 0 then bit_count((left_bits & -left_bits) - 1) end")


def words(fields: str) -> Column:
    """The five fields of ``times.cron_fields`` as words."""
    return F.expr("struct(" + ", ".join(f"{_bits(f'{fields}.{name}')} as {name}" for name, _, _ in CRON_FIELDS) + ")")


def _month_days(k: str, first: str) -> str:
    """Matching days of the month that begins at ``first``, bit 0 for its first day."""
    # bit i of a turned week says whether the weekday i days after the month's first is listed
    turned = f"(shiftright({k}.dow, dayofweek({first}) - 1) | shiftleft({k}.dow, 8 - dayofweek({first}))) & 127L"
    five_weeks = f"({turned}) * {1 + (1 << 7) + (1 << 14) + (1 << 21) + (1 << 28)}L"
    days = f"shiftright({k}.day, 1) & ({five_weeks}) & (shiftleft(1L, day(last_day({first}))) - 1)"
    return f"case when (shiftleft(1L, month({first})) & {k}.month) <> 0 then {days} else 0L end"


def _next_day(k: str, day: str) -> str:
    """First matching day (days since 1970) from ``day`` on within the months of the search; else null."""

    def of_month(first: str, place: str) -> str:
        return _let(first, "first_day", f"datediff(first_day, date'1970-01-01') + {_next_bit(_month_days(k, 'first_day'), place)}")

    later = f"array_min(transform(sequence(1, {_MONTHS}), j -> {of_month("add_months(trunc(a_date, 'MM'), j)", '0')}))"
    return _let(f"date_add(date'1970-01-01', cast({day} as int))", "a_date", f"coalesce({of_month("trunc(a_date, 'MM')", 'day(a_date) - 1')}, {later})")


def _next_of_day(k: str, minute: str) -> str:
    """First matching minute of a day from ``minute`` on; else null."""
    same = f"case when (shiftleft(1L, hour_at) & {k}.hour) <> 0 then hour_at * 60 + {_next_bit(f'{k}.minute', f'{minute} - hour_at * 60')} end"
    after = f"{_next_bit(f'{k}.hour', 'hour_at + 1')} * 60 + {_next_bit(f'{k}.minute', '0')}"
    return _let(f"cast({minute} div 60 as int)", "hour_at", f"coalesce({same}, {after})")


def _next_local(k: str, at: str) -> str:
    """First matching local minute (minutes since 1970) from ``at`` on; else null."""
    first = f"{_next_bit(f'{k}.hour', '0')} * 60 + {_next_bit(f'{k}.minute', '0')}"
    today = f"case when {_next_day(k, 'p.on_day')} = p.on_day then p.on_day * {_DAY_MINUTES} + {_next_of_day(k, 'p.at_minute')} end"
    later = f"{_next_day(k, 'p.on_day + 1')} * {_DAY_MINUTES} + {first}"
    place = f"struct(floor({at} / {_DAY_MINUTES}) as on_day, cast(pmod({at}, {_DAY_MINUTES}) as int) as at_minute)"
    return _let(place, "p", f"coalesce({today}, {later})")


def _in_stretch(k: str, stretch: str, start: str, end: str) -> str:
    """First matching second, a whole minute, of [start, end) inside a stretch (lo, hi, offset); else null."""
    # at whole minutes of UTC the local minute is the minute plus the whole minutes of the offset
    local = _let(f"cast(ceil(greatest({stretch}.lo, {start}) / 60) as bigint) + floor({stretch}.offset / 60)", "from_minute", _next_local(k, "from_minute"))
    found = f"({local} - floor({stretch}.offset / 60)) * 60"
    return _let(found, "found_at", f"case when found_at < {stretch}.hi and found_at < {end} then found_at end")


def next_run(k: str, stretches: str, start: str, end: str) -> Column:
    """First second in [start, end), a whole minute, whose local time matches; else null. ``k``: column of ``words``."""
    reached = f"filter({stretches}, s -> s.hi > {start} and s.lo < {end})"
    here = _let("get(reached, 0)", "st", _in_stretch(k, "st", start, end))
    later = f"array_min(transform(slice(reached, 2, greatest(size(reached) - 1, 0)), st -> {_in_stretch(k, 'st', start, end)}))"
    return F.expr(_let(reached, "reached", f"coalesce({here}, {later})"))


def valid_zone(zone: Column) -> Column:
    """Whether the engine knows the zone."""
    # the engine reads one-digit hours of an offset with minutes
    spelled = F.regexp_replace(zone, r"([+-])(\d):", "$10$2:")
    return F.try_reflect(F.lit("java.time.ZoneId"), F.lit("of"), spelled).isNotNull() | zone.isin(*_SHORT)


def zone_stretches(spans: DataFrame) -> DataFrame:
    """(zone, stretches) for (zone, lo, hi): the stretches (lo, hi, offset) of constant offset between two instants, in
    seconds. A zone's offset is looked at day by day, and where two days differ by the minute and by the second.
    """

    def offset(at: Column) -> Column:
        return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), c("zone"))) - at

    def steps(df: DataFrame, width: int, inside: int) -> DataFrame:
        """The parts of ``width`` seconds of rows (zone, at) whose offset changes, ``inside`` of them per row."""
        opened = df.select("zone", F.explode(F.transform(F.sequence(F.lit(0), F.lit(inside - 1)), lambda i: c("at") + i * width)).alias("at"))
        return opened.filter(offset(c("at")) != offset(c("at") + width))

    known = spans.filter(valid_zone(c("zone")))
    days = F.transform(F.sequence(F.floor(c("lo") / _DAY), F.floor(c("hi") / _DAY)), lambda d: d * _DAY)
    daily = known.select("zone", F.explode(days).alias("at")).filter(offset(c("at")) != offset(c("at") + _DAY))
    exact = steps(steps(daily, 60, _DAY_MINUTES), 1, 60).select("zone", (c("at") + 1).alias("at"))
    begins = exact.unionByName(known.select("zone", c("lo").alias("at"))).select("zone", "at", offset(c("at")).alias("offset"))
    per = begins.groupBy("zone").agg(F.sort_array(F.collect_set(F.struct("at", "offset"))).alias("b"))  # a few a year
    ends = lambda i: F.coalesce(F.get("b", i + 1)["at"], F.lit((1 << 62)))
    return per.select("zone", F.transform("b", lambda x, i: F.struct(x["at"].alias("lo"), ends(i).alias("hi"), x["offset"].alias("offset"))).alias("stretches"))
