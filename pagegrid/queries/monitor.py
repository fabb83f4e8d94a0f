"""Monitor snapshots, history and change records."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.operators import monitor as mon
from pagegrid.operators import pages
from pagegrid.operators.metrics import tail_per_key
from pagegrid.plans.registry import query
from pagegrid.queries import sqltext as s
from pagegrid.queries.pages import _SUMMARY
from pagegrid.sources import records

c = F.col

_SNAP = """'{"lang":"' || lang || '","linkCount":' || link_count || ',"targetUrl":"' || target_url || '","title":"' || title || '"}'"""


def _runs(t):
    v = t.v_monitor
    snap = mon.snapshot_json(v)
    return v.select("account_id", "monitor_key", "run_at", "run_id", "target_url", snap.alias("snapshot")).withColumn("snapshot_hash", mon.snapshot_hash(c("snapshot")))


@query(
    "f33_snapshots",
    f"""SELECT page_id, sha256('{{"canonicalUrl":"","charCount":' || char_count || ',"headingCounts":{{"h1":' || h1_count || ',"h2":' || h2_count || ',"h3":' || h3_count || '}},"lang":"' || lang || '","linkCount":' || link_count || ',"metaDescription":"","targetUrl":"' || target_url || '","wordCount":' || word_count || '}}') AS snapshot_hash FROM ({_SUMMARY})""",
)
def _(t):
    p = pages.summary(t.pages)
    return p.select("page_id", mon.snapshot_hash(mon.snapshot_json(p, {"includeTitle": False})).alias("snapshot_hash"))


@query("f34_monitor_keys", "SELECT page_id, 'url.' || left(sha256(url), 24) AS by_url, 'page:' || page_id || '.x' AS explicit, CAST(NULL AS VARCHAR) AS bad FROM pages")
def _(t):
    return t.pages.select(
        "page_id", mon.monitor_key(F.lit(" "), c("url")).alias("by_url"), mon.monitor_key(F.concat(F.lit(" PAGE:"), "page_id", F.lit(".X")), c("url")).alias("explicit"),
        mon.monitor_key(F.concat(F.lit("a b"), "page_id"), c("url")).alias("bad"),
    )


_HIST = f"""WITH r AS (SELECT *, sha256({_SNAP}) AS snapshot_hash FROM v_monitor), l AS (SELECT *, lag(snapshot_hash) OVER (PARTITION BY account_id, monitor_key ORDER BY run_at, run_id) AS previous_hash FROM r),
  f AS (SELECT *, previous_hash IS NULL AS first_run, coalesce(previous_hash <> snapshot_hash, false) AS changed FROM l)"""


@query(
    "w08_monitor_history",
    f"""{_HIST} SELECT run_id, account_id, monitor_key, first_run, changed, row_number() OVER w AS run_count, CAST(sum(CAST(changed AS INT)) OVER w AS BIGINT) AS change_count, max(CASE WHEN changed THEN run_at END) OVER w AS last_change_at FROM f
      WINDOW w AS (PARTITION BY account_id, monitor_key ORDER BY run_at, run_id ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    return mon.history(_runs(t)).select("run_id", "account_id", "monitor_key", "first_run", "changed", "run_count", "change_count", "last_change_at")


@query(
    "j12_monitor_upsert",
    f"""{_HIST} SELECT account_id, monitor_key, arg_max(snapshot_hash, run_id) AS snapshot_hash, count(*) AS run_count, count(*) FILTER (WHERE changed) AS change_count, min(run_at) AS first_seen_at, max(run_at) AS last_seen_at, max(run_at) FILTER (WHERE changed) AS last_change_at FROM f GROUP BY 1, 2""",
)
def _(t):
    r = _runs(t)
    early, late = r.filter("run_at < '2024-01-12 00:00:00'"), r.filter("run_at >= '2024-01-12 00:00:00'")
    empty = early.limit(0).select("account_id", "monitor_key", "target_url", "snapshot_hash", "snapshot", F.lit(0).cast("long").alias("run_count"), F.lit(0).cast("long").alias("change_count"), c("run_at").alias("first_seen_at"), c("run_at").alias("last_seen_at"), c("run_at").alias("last_change_at"))
    return mon.upsert_state(mon.upsert_state(empty, early), late).drop("target_url", "snapshot")


def _latest_two(t):
    two = tail_per_key(_runs(t), mon.KEYS, [c("run_at").desc(), c("run_id").desc()], 2)
    last = two.groupBy(*mon.KEYS).agg(F.max_by(F.struct("snapshot", "snapshot_hash", "target_url"), F.struct("run_at", "run_id")).alias("n"), F.min_by(F.struct("snapshot", "snapshot_hash"), F.struct("run_at", "run_id")).alias("o"), F.count(F.lit(1)).alias("k"))
    now = last.select(*mon.KEYS, "n.*")
    old = last.filter("k = 2").select(*mon.KEYS, "o.*")
    return now, old


_TWO = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY account_id, monitor_key ORDER BY run_at DESC, run_id DESC) AS rn FROM v_monitor),
  u AS (SELECT a.account_id, a.monitor_key, unnest(['lang', 'linkCount', 'targetUrl', 'title']) AS field, unnest([b.lang, CAST(b.link_count AS VARCHAR), b.target_url, b.title]) AS previous, unnest([a.lang, CAST(a.link_count AS VARCHAR), a.target_url, a.title]) AS "current" FROM n a JOIN n b ON b.account_id = a.account_id AND b.monitor_key = a.monitor_key AND a.rn = 1 AND b.rn = 2)"""


@query("j08_snapshot_join", f"""{_TWO} SELECT account_id, monitor_key, field, previous, "current" FROM u""")
def _(t):
    now, old = _latest_two(t)
    return mon.field_diff(now, old, mon.KEYS, changed_only=False)


@query("f32_field_diff", f"""{_TWO} SELECT account_id, monitor_key, count(*) AS diff_count, string_agg(field || ':' || previous || '>' || "current", '|' ORDER BY field) AS diff FROM u WHERE previous IS DISTINCT FROM "current" GROUP BY 1, 2""")
def _(t):
    now, old = _latest_two(t)
    d = mon.diff_lists(mon.field_diff(now, old, mon.KEYS), mon.KEYS)
    return d.select(*mon.KEYS, "diff_count", F.array_join(F.transform("diff", lambda x: F.concat(x["field"], F.lit(":"), x["previous"], F.lit(">"), x["current"])), "|").alias("diff"))


@query("u07_key_union", "SELECT field, count(*) AS n FROM (SELECT account_id, monitor_key, unnest(['lang', 'linkCount', 'targetUrl', 'title']) AS field FROM (SELECT account_id, monitor_key FROM v_monitor GROUP BY 1, 2 HAVING count(*) > 1)) GROUP BY 1")
def _(t):
    now, old = _latest_two(t)
    return mon.field_diff(now, old, mon.KEYS, changed_only=False).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s16_notification_outbox",
    f"""{_TWO}, d AS (SELECT account_id, monitor_key, count(*) AS diff_count FROM u WHERE previous IS DISTINCT FROM "current" GROUP BY 1, 2)
      SELECT d.account_id, d.monitor_key, 'https://hooks.example.com/' || d.account_id AS webhook_url, CASE WHEN c_mktsegment = 'BUILDING' THEN 'site.changed' ELSE 'monitor.page.changed' END AS event_type, CAST(diff_count AS VARCHAR) AS diff_count, c_mktsegment AS team, 'override' AS source FROM d JOIN customer ON c_custkey = d.account_id AND c_acctbal > 0""",
)
def _(t):
    now, old = _latest_two(t)
    d = mon.diff_lists(mon.field_diff(now, old, mon.KEYS), mon.KEYS)
    changes = now.join(old.select(*mon.KEYS, c("snapshot_hash").alias("previous_hash")), mon.KEYS).join(d, mon.KEYS).withColumn("changed", F.lit(True))
    hooks = t.customer.filter("c_acctbal > 0").select(
        c("c_custkey").alias("account_id"), F.explode(F.array(*[F.lit(f"mon.{k}") for k in ("view", "click", "purchase", "signup", "error")])).alias("monitor_key"),
        F.concat(F.lit("https://hooks.example.com/"), "c_custkey").alias("webhook_url"), F.when(c("c_mktsegment") == "BUILDING", "site.changed").alias("event_type"),
        F.create_map(F.lit("team"), c("c_mktsegment")).alias("metadata"), F.create_map(F.lit("source"), F.lit("override")).alias("body"),
    )
    out = records.notification_bodies(changes, hooks)
    return out.select(*mon.KEYS, "webhook_url", "event_type", c("metadata.diffCount").alias("diff_count"), c("metadata.team").alias("team"), c("metadata.source").alias("source"))
