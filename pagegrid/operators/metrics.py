"""Request metrics, service levels and usage over event tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagegrid.functions.labels import AUTH_SLO_PATHS, LICENSE_SLO_PATHS, request_family
from pagegrid.functions.numbers import percent, round_half_up
from pagegrid.plans.ordered import running

c = F.col


def in_window(df: DataFrame, now: str, minutes: int = 60, ts: str = "ts") -> DataFrame:
    """Events of the trailing window ending at ``now``; the time bounds push down to the scan."""
    end = F.lit(now).cast("timestamp")
    return df.filter((c(ts) >= end - F.make_interval(mins=F.lit(minutes))) & (c(ts) <= end))


def money(col: str) -> Column:
    """Durations and amounts are summed as decimals, so totals do not depend on task order."""
    return c(col).cast("decimal(18,4)")


def mean2(col: str) -> Column:
    return round_half_up(F.sum(money(col)).cast("double") / F.count(F.lit(1)))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, p: float, name: str) -> DataFrame:
    """Exact nearest-rank percentile per key without holding a key's values in one task.

    Values are counted first (combinable), then accumulated in order over range slices. Without
    keys the whole frame is one group.
    """
    if not keys:
        return nearest_rank(df.withColumn("__all", F.lit(1)), ["__all"], value, p, name).drop("__all")
    counts = df.filter(c(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    cumulative = running(counts, keys, [value], sums={"upto": c("n")})
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    same = [cumulative[k].eqNullSafe(totals[k]) for k in keys]
    joined = cumulative.join(totals, same).drop(*[totals[k] for k in keys])
    rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * c("total")))
    return joined.filter((c("upto") >= rank) & (c("upto") - c("n") < rank)).select(*keys, round_half_up(c(value)).alias(name))


def request_summary(df: DataFrame, keys: Sequence[Column | str] = ()) -> DataFrame:
    """Counts by class; 3xx counts as success here."""
    code = c("status_code")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.count_if((code >= 200) & (code < 400)).alias("status_2xx"),
        F.count_if((code >= 400) & (code < 500)).alias("status_4xx"),
        F.count_if(code >= 500).alias("status_5xx"),
        percent(F.count_if(code >= 500), F.count(F.lit(1))).alias("error_rate_percent"),
    )


def family_summary(df: DataFrame) -> DataFrame:
    d = df.select(request_family(c("path")).alias("family"), "status_code", "duration_ms")
    base = d.groupBy("family").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(c("status_code") >= 400).alias("failures"),
        percent(F.count_if(c("status_code") >= 400), F.count(F.lit(1))).alias("failure_rate_percent"),
        mean2("duration_ms").alias("avg_duration_ms"),
    )
    return base.join(nearest_rank(d, ["family"], "duration_ms", 0.95, "p95_duration_ms"), "family", "left")


def running_totals(df: DataFrame) -> DataFrame:
    """All-time totals; 2xx means 200-299 here, unlike the window summary."""
    code, path = c("status_code"), c("path")
    return df.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if((code >= 200) & (code < 300)).alias("status_2xx"),
        F.count_if((code >= 400) & (code < 500)).alias("status_4xx"),
        F.count_if(code >= 500).alias("status_5xx"),
        F.count_if(path.startswith("/api/auth/") & (code >= 400)).alias("auth_failures"),
        F.count_if(path.startswith("/api/license/") & (code >= 400)).alias("license_failures"),
        F.count_if(path.startswith("/api/devices") & (code >= 400)).alias("device_failures"),
    )


def top_routes(df: DataFrame, limit: int = 25) -> DataFrame:
    routes = df.groupBy("method", "path").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(c("status_code") >= 400).alias("error_count"), mean2("duration_ms").alias("avg_duration_ms")
    )
    return routes.orderBy(c("count").desc(), c("path"), c("method")).limit(limit)


def service_levels(df: DataFrame) -> DataFrame:
    """(name, samples, value, target): availability and the two latency objectives; null without samples."""
    health = df.filter("path = '/healthz'").agg(
        F.count(F.lit(1)).alias("samples"),
        percent(F.count_if(c("status_code").between(200, 399)), F.count(F.lit(1)), 4).alias("value"),
    )
    out = health.select(F.lit("availability_percent").alias("name"), "samples", "value", F.lit(99.5).alias("target"))
    slo = df.select(
        F.when(c("path").isin(AUTH_SLO_PATHS), "auth_p95_ms").when(c("path").isin(LICENSE_SLO_PATHS), "license_p95_ms").alias("name"), "duration_ms"
    ).filter("name IS NOT NULL")
    names = df.sparkSession.createDataFrame([("auth_p95_ms", 400.0), ("license_p95_ms", 350.0)], "name string, target double")
    samples = slo.groupBy("name").agg(F.count(F.lit(1)).alias("samples"))
    p95 = nearest_rank(slo, ["name"], "duration_ms", 0.95, "value")
    latency = names.join(samples, "name", "left").join(p95, "name", "left").select("name", F.coalesce("samples", F.lit(0)).alias("samples"), "value", "target")
    return out.unionByName(latency)


# Measure -> (minimum samples, limit, direction of the breach).
SLO_RULES = [
    ("availability_percent", 2, 99.5, "below"),
    ("window_5xx_percent", 20, 2.0, "above"),
    ("auth_p95_ms", 10, 600.0, "above"),
    ("license_p95_ms", 10, 600.0, "above"),
    ("auth_failure_percent", 10, 20.0, "above"),
    ("license_failure_percent", 10, 20.0, "above"),
    ("devices_failure_percent", 10, 20.0, "above"),
]


def service_breaches(df: DataFrame) -> DataFrame:
    """One row per breached rule; a rule needs its minimum of samples."""
    levels = service_levels(df).select("name", "samples", "value")
    overall = request_summary(df).select(F.lit("window_5xx_percent").alias("name"), c("requests_total").alias("samples"), c("error_rate_percent").alias("value"))
    fam = df.select(request_family(c("path")).alias("family"), "status_code").groupBy("family").agg(
        F.count(F.lit(1)).alias("samples"), percent(F.count_if(c("status_code") >= 400), F.count(F.lit(1))).alias("value")
    )
    fam = fam.select(F.concat("family", F.lit("_failure_percent")).alias("name"), "samples", "value")
    rules = df.sparkSession.createDataFrame(SLO_RULES, "name string, min_samples long, bound double, side string")
    all_values = levels.unionByName(overall).unionByName(fam)
    hit = F.when(c("side") == "below", c("value") < c("bound")).otherwise(c("value") > c("bound"))
    return all_values.join(F.broadcast(rules), "name").filter((c("samples") >= c("min_samples")) & hit).select("name", "samples", "value", "bound")


def exposition(df: DataFrame) -> DataFrame:
    """Metric text lines (line_no, line) of a request table; null values print as NaN."""
    totals = running_totals(df)
    window = request_summary(df)

    def show(col: Column) -> Column:
        return F.coalesce(F.regexp_replace(col.cast("string"), r"\.0$", ""), F.lit("NaN"))

    def part(frame: DataFrame, start: int, items: list[tuple[str, str]]) -> DataFrame:
        rows = [F.struct(F.lit(start + i).alias("line_no"), F.concat(F.lit(label + " "), show(c(col))).alias("line")) for i, (label, col) in enumerate(items)]
        return frame.select(F.explode(F.array(*rows)).alias("x")).select("x.*")

    t = "control_api_requests_total"
    w = "control_api_window_requests_total"
    head = {
        1: (t, "Total requests since process start", "counter"),
        21: ("control_api_failures_total", "Failures by endpoint family", "counter"),
        41: (w, "Requests in current rolling window", "gauge"),
        61: ("control_api_window_error_rate_percent", "5xx error rate in rolling window", "gauge"),
        81: ("control_api_window_family_failure_rate_percent", "Failure rate by endpoint family", "gauge"),
        101: ("control_api_window_family_p95_ms", "p95 latency by endpoint family in rolling window", "gauge"),
        121: ("control_api_slo_value", "SLO values in current window", "gauge"),
    }
    comments = [(n, f"# HELP {name} {text}") for n, (name, text, _) in head.items()] + [(n + 1, f"# TYPE {name} {kind}") for n, (name, _, kind) in head.items()]
    out = df.sparkSession.createDataFrame(comments, "line_no int, line string")
    out = out.unionByName(part(totals, 3, [(t, "requests")] + [(f'{t}{{status_class="{k}"}}', f"status_{k}") for k in ("2xx", "4xx", "5xx")]))
    out = out.unionByName(part(totals, 23, [(f'control_api_failures_total{{family="{f}"}}', col) for f, col in (("auth", "auth_failures"), ("license", "license_failures"), ("devices", "device_failures"))]))
    out = out.unionByName(part(window, 43, [(w, "requests_total")] + [(f'{w}{{status_class="{k}"}}', f"status_{k}") for k in ("2xx", "4xx", "5xx")]))
    out = out.unionByName(part(window, 63, [("control_api_window_error_rate_percent", "error_rate_percent")]))
    fam = family_summary(df)
    for start, metric, col in ((83, "control_api_window_family_failure_rate_percent", "failure_rate_percent"), (103, "control_api_window_family_p95_ms", "p95_duration_ms")):
        label = F.concat(F.lit(metric + '{family="'), "family", F.lit('"} '), show(c(col)))
        place = F.lit(start) + F.array_position(F.array(*[F.lit(f) for f in ("auth", "devices", "health", "license", "observability", "other")]), c("family"))
        out = out.unionByName(fam.select(place.cast("int").alias("line_no"), label.alias("line")))
    slo = service_levels(df)
    name = F.when(c("name") == "availability_percent", "healthz_availability_percent").otherwise(c("name"))
    place = F.lit(122) + F.array_position(F.array(*[F.lit(x) for x in ("healthz_availability_percent", "auth_p95_ms", "license_p95_ms")]), name)
    return out.unionByName(slo.select(place.cast("int").alias("line_no"), F.concat(F.lit('control_api_slo_value{name="'), name, F.lit('"} '), show(c("value"))).alias("line")))


def usage_counters(df: DataFrame, account: str, metric: str, ts: str) -> DataFrame:
    return df.groupBy(c(account).alias("account_id"), c(metric).alias("metric"), F.to_date(ts).alias("period_start")).agg(F.count(F.lit(1)).alias("count"))


#: up to this many rows per key Spark limits ranks in the map tasks (its default threshold)
_MAP_RANKS = 1000


def tail_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """Newest ``keep`` rows per key; ``order`` must tell the rows of a key apart.

    Short tails are limited by Spark in every map task before the shuffle. It does not do so for longer ones, so these are
    numbered over range slices, where a hot key spans many tasks.
    """
    if keep <= _MAP_RANKS:
        numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        numbered = running(df, keys, order, number="__rn")
    return numbered.filter(c("__rn") <= keep).drop("__rn")


# -- spend ----------------------------------------------------------------------------------


def daily_anomaly(days: DataFrame) -> DataFrame:
    """Score each day against all earlier days (at least three); one row per day, so one small task."""
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    usd = c("usd").cast("double")
    d = days.select("day", usd.alias("usd"), F.count(F.lit(1)).over(before).alias("n"), F.avg(usd).over(before).alias("mean"), F.stddev_samp(usd).over(before).alias("sigma"))
    z = (c("usd") - c("mean")) / F.nullif(c("sigma"), F.lit(0.0))
    flat = (c("usd") > c("mean") * 1.5) & (c("usd") > 0)
    return d.select(
        "day", round_half_up(c("usd")).alias("usd"),
        F.when(c("n") < 3, "not_enough_samples").alias("reason"),
        F.when(c("n") >= 3, round_half_up(z)).alias("z_score"),
        F.when(c("n") < 3, False).when(c("sigma") == 0, flat).otherwise(F.coalesce(z >= 2.5, F.lit(False))).alias("is_anomaly"),
    )


def spend_projection(days: DataFrame, today: str, budget: float = 5.0, alert: float = 80.0, cap: float = 100.0) -> DataFrame:
    """Month-to-date and projected spend against the budget with one flag per rule."""
    from pagegrid.functions.times import month_day, month_days

    d = F.lit(today).cast("date")
    mtd = days.filter((c("day") >= F.trunc(d, "month")) & (c("day") <= d)).agg(F.coalesce(F.sum("usd"), F.lit(0)).cast("double").alias("mtd"))
    projected = c("mtd") / month_day(d) * month_days(d)
    out = mtd.select(
        round_half_up(c("mtd"), 4).alias("month_to_date_usd"), round_half_up(projected, 4).alias("projected_usd"),
        round_half_up(c("mtd") / budget * 100).alias("usage_percent"), round_half_up(projected / budget * 100).alias("projected_percent"),
    )
    return out.select(
        "*", (c("usage_percent") >= cap).alias("usage_over_cap"), (c("projected_percent") >= cap).alias("projected_over_cap"),
        (c("usage_percent") >= alert).alias("usage_over_alert"), (c("projected_percent") >= alert).alias("projected_over_alert"),
    )
