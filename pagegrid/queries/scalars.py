"""Scalar functions over whole columns."""
from __future__ import annotations

from pyspark.sql import functions as F

from pagegrid.functions import contacts, labels, numbers, text, times, urls
from pagegrid.plans.registry import query
from pagegrid.plans.tables import NOW
from pagegrid.queries import sqltext as s

c = F.col
now = lambda: F.lit(NOW).cast("timestamp")


@query("f01_clean_text", f"SELECT doc_id, {s.clean('text')} AS cleaned FROM documents")
def _(t):
    return t.documents.select("doc_id", text.clean_text(c("text")).alias("cleaned"))


@query(
    "f02_field_slug",
    f"""SELECT p_partkey, coalesce(nullif({s.sub(s.sub("lower(p_name || ' / ' || p_type)", "[^a-z0-9_]+", "_"), "^_+|_+$", "")}, ''), 'field_1') AS slug,
      coalesce(nullif({s.sub(s.sub("lower(regexp_replace(p_name, '[a-z ]', '', 'g'))", "[^a-z0-9_]+", "_"), "^_+|_+$", "")}, ''), 'field_' || p_size) AS fallback
      FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        text.field_slug(F.concat_ws(" / ", "p_name", "p_type"), "field_1").alias("slug"),
        text.field_slug(F.regexp_replace("p_name", "[a-z ]", ""), F.concat(F.lit("field_"), "p_size")).alias("fallback"),
    )


@query("f03_entity_decode", f"SELECT page_id, {s.decode('html')} AS decoded FROM pages")
def _(t):
    return t.pages.select("page_id", text.decode_entities(c("html")).alias("decoded"))


@query("f04_strip_html", f"SELECT page_id, {s.strip('html')} AS plain FROM pages")
def _(t):
    return t.pages.select("page_id", text.strip_html(c("html")).alias("plain"))


@query("f05_tag_text", f"SELECT page_id, {s.tag_text('html', 'title')} AS title, {s.tag_text('html', 'h1')} AS h1, {s.tag_text('html', 'article')} AS article FROM pages")
def _(t):
    return t.pages.select("page_id", *[text.tag_text(c("html"), k).alias(k) for k in ("title", "h1", "article")])


_META = r"""(?i)<meta\b[^>]*charset\s*=\s*["']([^"']*)["'][^>]*>"""
_DESC = r"""(?i)<meta\b[^>]*name\s*=\s*["']description["'][^>]*content\s*=\s*["']([^"']*)["'][^>]*>"""
_DESC_REV = r"""(?i)<meta\b[^>]*content\s*=\s*["']([^"']*)["'][^>]*name\s*=\s*["']description["'][^>]*>"""


@query(
    "f06_meta_content",
    f"""WITH h AS (SELECT page_id, '<meta name="description" content="' || page_id || ' of ' || url || '">' || html AS head_first,
        html || '<meta content=''' || url || ' &amp; more'' name="description">' AS tail_last FROM pages)
      SELECT page_id, {s.decode(f"CASE WHEN regexp_matches(head_first, {s.q(_DESC)}) THEN regexp_extract(head_first, {s.q(_DESC)}, 1) ELSE regexp_extract(head_first, {s.q(_DESC_REV)}, 1) END")} AS forward,
        {s.decode(f"CASE WHEN regexp_matches(tail_last, {s.q(_DESC)}) THEN regexp_extract(tail_last, {s.q(_DESC)}, 1) ELSE regexp_extract(tail_last, {s.q(_DESC_REV)}, 1) END")} AS backward FROM h""",
)
def _(t):
    p = t.pages
    first = F.concat(F.lit('<meta name="description" content="'), c("page_id"), F.lit(" of "), c("url"), F.lit('">'), c("html"))
    last = F.concat(c("html"), F.lit("<meta content='"), c("url"), F.lit(" &amp; more' name=\"description\">"))
    return p.select("page_id", text.meta_content(first, "description").alias("forward"), text.meta_content(last, "description").alias("backward"))


@query("f07_canonical_lang", f"SELECT page_id, {s.lang('html')} AS lang, url AS forward, url AS backward, '' AS absent FROM pages")
def _(t):
    h = c("html")
    forward = F.concat(F.lit('<link rel="canonical" href="'), c("url"), F.lit('">'), h)
    backward = F.concat(h, F.lit("<link href=' "), c("url"), F.lit(" ' rel='canonical'>"))
    return t.pages.select(
        "page_id", text.html_lang(h).alias("lang"), text.canonical_url(forward).alias("forward"),
        text.canonical_url(backward).alias("backward"), text.canonical_url(h).alias("absent"),
    )


@query("f08_word_counts", f"SELECT doc_id, {s.words('text')} AS words, CAST(length(text) AS BIGINT) AS chars FROM documents")
def _(t):
    return t.documents.select("doc_id", text.word_count(c("text")).alias("words"), F.char_length("text").cast("long").alias("chars"))




@query(
    "f11_emails",
    f"""WITH d AS (SELECT doc_id AS id, 'document' AS kind, text AS body FROM documents UNION ALL SELECT page_id, 'page', {s.visible('html')} FROM pages),
      m AS (SELECT id, kind, {s.emails('body')} AS found FROM d),
      u AS (SELECT id, kind, found, {s.first_of_each('found')} AS uniq FROM m),
      v AS (SELECT *, list_transform(uniq, lambda e: string_split(e, '@')[2]) AS doms FROM u)
      SELECT id, kind, array_to_string(uniq, '|') AS emails, CAST(len(uniq) AS BIGINT) AS email_count,
        array_to_string({s.first_of_each('doms')}, '|') AS email_domains FROM v""",
)
def _(t):
    d = t.documents.select(c("doc_id").alias("id"), F.lit("document").alias("kind"), c("text").alias("body"))
    p = t.pages.select(c("page_id").alias("id"), F.lit("page").alias("kind"), text.visible_text(c("html")).alias("body"))
    e = d.unionByName(p).select("id", "kind", contacts.emails(c("body")).alias("found"))
    return e.select(
        "id",
        "kind",
        F.array_join("found", "|").alias("emails"),
        F.size("found").cast("long").alias("email_count"),
        F.array_join(contacts.email_domains(c("found")), "|").alias("email_domains"),
    )




@query(
    "f12_phones",
    f"""WITH d AS (SELECT doc_id AS id, 'document' AS kind, text AS body FROM documents UNION ALL SELECT page_id, 'page', {s.visible('html')} FROM pages),
      m AS (SELECT id, kind, {s.phones('body')} AS found FROM d)
      SELECT id, kind, array_to_string({s.first_of_each('found')}, '|') AS phones, CAST(len({s.first_of_each('found')}) AS BIGINT) AS phone_count FROM m""",
)
def _(t):
    d = t.documents.select(c("doc_id").alias("id"), F.lit("document").alias("kind"), c("text").alias("body"))
    p = t.pages.select(c("page_id").alias("id"), F.lit("page").alias("kind"), text.visible_text(c("html")).alias("body"))
    e = d.unionByName(p).select("id", "kind", contacts.phones(c("body")).alias("found"))
    return e.select("id", "kind", F.array_join("found", "|").alias("phones"), F.size("found").cast("long").alias("phone_count"))


@query(
    "f13_contact_counts",
    f"""SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, {s.q(s.EMAIL)}), lambda m: lower(m)))) AS BIGINT) AS email_count,
      CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(text, {s.q(s.PHONE)}), lambda m: trim(regexp_replace(m, {s.q(s.WS + '+')}, ' ', 'g'), ' ')), lambda x: length(x) >= 7))) AS BIGINT) AS phone_count
      FROM documents""",
)
def _(t):
    mails, numbers_ = contacts.signal_counts(c("text"))
    return t.documents.select("doc_id", mails.alias("email_count"), numbers_.alias("phone_count"))


@query(
    "f20_url_signature",
    f"""SELECT page_id, regexp_replace({s.url_full('url', fragment=False)}, '/+$', '') AS page_signature,
      lower({s.url_part('url', 1)}) || '://' || lower({s.url_part('url', 2)}) || {s.url_path('url')} || {s.path_encoded(s.url_part('url', 4))} AS target_signature FROM pages""",
)
def _(t):
    return t.pages.select("page_id", urls.signature(c("url")).alias("page_signature"), urls.target_signature(c("url")).alias("target_signature"))


@query(
    "f22_absolute_url",
    f"""WITH l AS (SELECT page_id, url, html, regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"', 1) AS hrefs FROM pages),
      e AS (SELECT page_id, url, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS pos FROM l)
      SELECT page_id, CAST(pos AS BIGINT) AS pos, href, {s.absolute('href', 'url')} AS link FROM e""",
)
def _(t):
    hrefs = F.regexp_extract_all(c("html"), F.lit(r'(?i)<a\b[^>]*\bhref\s*=\s*"([^"]*)"'), F.lit(1))
    e = t.pages.select("page_id", "url", F.posexplode(hrefs).alias("i", "href"))
    return e.select("page_id", (c("i") + 1).cast("long").alias("pos"), "href", urls.absolute(c("href"), c("url")).alias("link"))


@query("f23_host_key", f"SELECT page_id, regexp_replace(regexp_replace({s.url_host('url')}, '^www\\.', ''), '\\.+$', '') AS host_key FROM pages")
def _(t):
    return t.pages.select("page_id", urls.host_key(c("url")).alias("host_key"))


@query(
    "f24_url_templates",
    """WITH r AS (SELECT p_partkey, p_name, unnest(generate_series(p_size, p_size + 9, 3)) AS n FROM part)
      SELECT p_partkey, CAST(n AS BIGINT) AS n, 'https://example.com/' || replace(replace(replace(replace(replace(replace(url_encode(p_name), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~') || '/page/' || lpad(CAST(n AS VARCHAR), 4, '0') AS url FROM r""",
)
def _(t):
    from pagegrid.operators.seeds import expand_range, fill_template

    p = expand_range(t.part.select("p_partkey", "p_name", "p_size"), c("p_size"), c("p_size") + 9, step=3, padding=4)
    url = fill_template("https://example.com/{seed}/page/{n}", seed=c("p_name"), number=c("n_text"))
    return p.select("p_partkey", c("n").cast("long").alias("n"), url.alias("url"))


_IMG_NAME = "list_has_any(['image','img','photo','thumbnail','picture','logo','icon'], [lower(x)])"


@query(
    "f28_image_like",
    r"""SELECT row_seq, (starts_with(lower(image_url), 'data:image/') OR regexp_matches(lower(image_url), '\.(png|jpe?g|gif|webp|svg|bmp|avif)(\?|#|$)') OR contains(lower(image_url), 'images/') OR contains(lower(image_url), '/image/') OR contains(lower(image_url), 'img')) AS url_is_image,
      (starts_with(seg_lower, 'data:image/') OR regexp_matches(seg_lower, '\.(png|jpe?g|gif|webp|svg|bmp|avif)(\?|#|$)') OR contains(seg_lower, 'images/') OR contains(seg_lower, '/image/') OR contains(seg_lower, 'img')) AS segment_is_image,
      regexp_matches(lower('Photo of ' || segment), 'image|img|photo|thumbnail|picture|logo|icon') AS name_is_image FROM v_rows""",
)
def _(t):
    from pagegrid.operators.profile import image_like_name_column, image_like_value

    return t.v_rows.select(
        "row_seq",
        image_like_value(c("image_url")).alias("url_is_image"),
        image_like_value(c("seg_lower")).alias("segment_is_image"),
        image_like_name_column(F.concat(F.lit("Photo of "), "segment")).alias("name_is_image"),
    )


_FAMILY = "CASE WHEN starts_with(path, '/api/auth/') THEN 'auth' WHEN starts_with(path, '/api/license/') THEN 'license' WHEN starts_with(path, '/api/devices') THEN 'devices' WHEN path IN ('/healthz', '/readyz') THEN 'health' WHEN starts_with(path, '/api/observability/') OR path = '/metrics' THEN 'observability' ELSE 'other' END"


@query(
    "f37_request_class",
    f"SELECT event_id, {_FAMILY} AS family, CASE WHEN status_code >= 500 THEN '5xx' WHEN status_code >= 400 THEN '4xx' WHEN status_code >= 300 THEN '3xx' WHEN status_code >= 200 THEN '2xx' ELSE '1xx' END AS status_class FROM v_requests",
)
def _(t):
    return t.v_requests.select("event_id", labels.request_family(c("path")).alias("family"), labels.status_class(c("status_code")).alias("status_class"))


def _taxonomy_sql(index: int) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v[index]}'" for k, v in labels.EVENT_TAXONOMY.items())
    return f"CASE event_type {arms} ELSE '{labels.EVENT_TAXONOMY['automation.progress'][index]}' END"


@query(
    "f38_event_taxonomy",
    f"""SELECT event_id, {_taxonomy_sql(0)} AS event_name, {_taxonomy_sql(1)} AS severity, {_taxonomy_sql(2)} AS stage,
      CASE event_id % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'metadata' WHEN 2 THEN (CASE WHEN event_id % 3 = 0 THEN 'email' WHEN event_id % 3 = 1 THEN 'maps' ELSE 'pages' END) ELSE 'unknown' END AS tool_type FROM v_lifecycle""",
)
def _(t):
    runner = F.element_at(F.array(*[F.lit(x) for x in ("listExtractor", "metadataExtractor", "pageExtractor", "other")]), (c("event_id") % 4 + 1).cast("int"))
    action = F.element_at(F.array(*[F.lit(x) for x in (" extract_pages_email", "EXTRACT_PAGES_GOOGLE_MAPS", "")]), (c("event_id") % 3 + 1).cast("int"))
    return t.v_lifecycle.select("event_id", labels.event_taxonomy(c("event_type")).alias("x"), labels.tool_type(runner, action).alias("tool_type")).select(
        "event_id", "x.event_name", "x.severity", "x.stage", "tool_type"
    )


_HAY = "lower('E_' || conv_id || ' ' || text)"


@query(
    "f39_error_triage",
    f"""WITH e AS (SELECT conv_id, turn, text, CASE WHEN contains({_HAY}, 'permission') THEN 'permission' WHEN contains({_HAY}, 'timeout') OR contains({_HAY}, 'timed out') THEN 'timeout'
        WHEN contains({_HAY}, 'selector') THEN 'selector' WHEN contains({_HAY}, 'network') OR contains({_HAY}, 'fetch') OR contains({_HAY}, 'socket') OR contains({_HAY}, 'connect') THEN 'network'
        WHEN contains({_HAY}, 'invalid') OR contains({_HAY}, 'validation') THEN 'validation' ELSE 'unexpected' END AS error_type FROM conversations)
      SELECT conv_id, turn, error_type, CASE WHEN error_type IN ('permission', 'unexpected') THEN 'critical' WHEN error_type = 'validation' THEN 'warning' ELSE 'error' END AS severity,
        error_type IN ('timeout', 'network', 'selector') AS recoverable, left(text, 1200) AS message FROM e""",
)
def _(t):
    e = t.conversations.withColumn("error_type", labels.error_type(F.concat(F.lit("E_"), "conv_id"), c("text")))
    return e.select(
        "conv_id", "turn", "error_type",
        labels.error_severity(c("error_type")).alias("severity"),
        labels.error_recoverable(c("error_type")).alias("recoverable"),
        F.left("text", F.lit(1200)).alias("message"),
    )


def _hint_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


_H = {k: _hint_sql(v) for k, v in labels.HINTS.items()}


@query(
    "f40_goal_flags",
    f"""WITH r AS (SELECT conv_id, turn, {s.clean('text')} AS raw FROM conversations), l AS (SELECT *, lower(raw) AS low FROM r),
      f AS (SELECT *, {_H['access']} AS wants_access, {_H['export']} AS wants_export, {_H['maps']} AS wants_maps, {_H['local_leads']} AS wants_local_leads, {_H['email']} AS wants_email,
        {_H['phone']} AS wants_phone, {_H['text']} AS wants_text, {_H['metadata']} AS wants_metadata, {_H['exhaustive']} AS wants_exhaustive, {_H['data']} AS hinted FROM l)
      SELECT conv_id, turn, wants_access, wants_export, wants_maps, wants_local_leads, wants_email, wants_phone, wants_text, wants_metadata, wants_exhaustive,
        regexp_matches(low, '\\b({'|'.join(labels.VERBS)})\\b') OR contains(low, 'quick extract') OR (raw <> '' AND NOT wants_access AND NOT wants_export AND (regexp_matches(raw, {s.q(labels.CONVERSATIONAL)}) OR hinted OR wants_maps OR wants_local_leads OR wants_email OR wants_phone OR wants_text OR wants_metadata)) AS wants_extract,
        contains(low, 'fresh') OR regexp_matches(raw, '(?i)\\bup[-\\s]?to[-\\s]?date\\b') OR contains(low, 'latest') OR contains(low, 'today') OR contains(low, 'recent') OR contains(low, 'newly') AS wants_fresh,
        least(50000, CAST(coalesce(nullif(regexp_extract(raw, {s.q(labels.TARGET_WORDS)}, 1), ''), nullif(regexp_extract(raw, {s.q(labels.TARGET_TOP)}, 1), ''), '0') AS BIGINT)) AS result_target,
        CASE WHEN contains(low, 'xlsx') OR contains(low, 'excel') THEN 'xlsx' WHEN contains(low, 'json') THEN 'json' ELSE 'csv' END AS export_format,
        regexp_extract(raw, {s.q(labels.FIRST_URL)}) AS explicit_url FROM f""",
)
def _(t):
    f = labels.goal_flags(c("text"))
    keep = ["explicit_url", "wants_extract", "wants_access", "wants_export", "wants_maps", "wants_local_leads", "wants_email", "wants_phone", "wants_text", "wants_metadata", "wants_exhaustive", "wants_fresh", "result_target", "export_format"]
    return t.conversations.select("conv_id", "turn", *[f[k].alias(k) for k in keep])


def _instruction_sql(expr: str) -> str:
    for p in labels.INSTRUCTION_PATTERNS:
        expr = f"trim(regexp_replace({expr}, {s.q(p)}, ''))"
    return s.clean(expr)


_FOR = r"(?i)\b(?:for|about|on)\s+(.+)$"
_FRESH = r"regexp_matches(raw, '(?i)\bup[-\s]?to[-\s]?date\b')"
_VERB = r"regexp_matches(low, '\b(" + "|".join(labels.VERBS) + r")\b')"
_AFTER_SEARCH = r"regexp_replace(raw, '(?i)^.*?\bsearch\b\s*', '')"
_ENCODED = "replace(replace(replace(replace(replace(replace(url_encode(intent_query), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%7E', '~'), '%20', '+')"


@query(
    "f40_goal_strategy",
    f"""WITH r AS (SELECT conv_id, turn, {s.clean('text')} AS raw FROM conversations), l AS (SELECT *, lower(raw) AS low, regexp_extract(raw, {s.q(labels.FIRST_URL)}) AS explicit_url FROM r),
      f AS (SELECT *, {_H['access']} AS wants_access, {_H['export']} AS wants_export, {_H['maps']} OR {_H['local_leads']} AS maps, {_H['email']} OR {_H['phone']} OR {_H['text']} OR {_H['metadata']} AS page, {_H['data']} AS hinted,
        contains(low, 'fresh') OR {_FRESH} OR contains(low, 'latest') OR contains(low, 'today') OR contains(low, 'recent') OR contains(low, 'newly') AS fresh FROM l),
      q AS (SELECT *, {_VERB} OR contains(low, 'quick extract') OR (raw <> '' AND NOT wants_access AND NOT wants_export AND (regexp_matches(raw, {s.q(labels.CONVERSATIONAL)}) OR hinted OR maps OR page)) AS wants_extract,
        CASE WHEN explicit_url <> '' THEN '' WHEN regexp_extract(raw, {s.q(_FOR)}, 1) <> '' THEN {s.clean(f"regexp_extract(raw, {s.q(_FOR)}, 1)")}
          WHEN contains(low, 'search') THEN {_instruction_sql(_AFTER_SEARCH)} ELSE {_instruction_sql('raw')} END AS intent_query FROM f),
      e AS (SELECT *, {_ENCODED} AS enc FROM q),
      d AS (SELECT *, CASE WHEN explicit_url <> '' THEN explicit_url WHEN intent_query = '' THEN '' WHEN maps THEN 'https://www.google.com/maps/search/' || enc ELSE 'https://www.google.com/search?q=' || enc || CASE WHEN fresh THEN '&tbs=qdr:d' ELSE '' END END AS discovery_url FROM e),
      m AS (SELECT *, maps OR contains(lower(discovery_url), 'google.com/maps') OR contains(lower(discovery_url), 'maps.google.') AS map_mode, contains(low, 'point') AND contains(low, 'follow') AS pointing FROM d)
      SELECT conv_id, turn, intent_query, discovery_url, CASE WHEN wants_access AND NOT wants_extract AND NOT pointing AND NOT wants_export THEN 'access_only' WHEN wants_export AND NOT wants_extract THEN 'export_only' WHEN pointing THEN 'point_follow_guided'
        WHEN wants_extract AND map_mode THEN 'maps_autopilot' WHEN wants_extract AND page THEN 'page_autopilot' WHEN wants_extract THEN 'list_autodetect_autopilot' ELSE 'idle' END AS strategy FROM m""",
)
def _(t):
    raw = t.conversations.select("conv_id", "turn", "text")
    flags = labels.goal_flags(c("text"))
    d = raw.select("*", *[v.alias(k) for k, v in flags.items()]).withColumn("intent_query", labels.goal_query(c("text")))
    by_name = {k: c(k) for k in flags}
    d = d.withColumn("discovery_url", labels.goal_discovery_url(c("intent_query"), by_name))
    return d.select("conv_id", "turn", "intent_query", "discovery_url", labels.goal_strategy(by_name, c("discovery_url")).alias("strategy"))


@query(
    "d01_interval_next_run",
    "SELECT id, created_at + to_minutes(interval_minutes) AS next_run_at FROM v_schedules WHERE schedule_kind = 'interval'",
)
def _(t):
    s_ = t.v_schedules.filter("schedule_kind = 'interval'")
    return s_.select("id", times.add_minutes(c("created_at"), times.valid_interval(c("interval_minutes"))).alias("next_run_at"))


@query(
    "d03_zone_parts",
    """WITH z AS (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS local_ts FROM events)
      SELECT event_id, CAST(minute(local_ts) AS INT) AS minute, CAST(hour(local_ts) AS INT) AS hour, CAST(day(local_ts) AS INT) AS day, CAST(month(local_ts) AS INT) AS month, CAST(dayofweek(local_ts) AS INT) AS dow FROM z""",
)
def _(t):
    e = t.events.select("event_id", times.zoned_parts(c("ts").cast("timestamp"), "America/New_York").alias("p"))
    return e.select("event_id", "p.*")


@query(
    "d05_backoff",
    """SELECT id, least(900, greatest(15, CAST(floor(15 * pow(2, greatest(0, attempts - 1)) + floor(((id % 10) / 10.0) * greatest(1, floor(15 * pow(2, greatest(0, attempts - 1)) * 0.2)))) AS BIGINT))) AS job_seconds,
      CAST(greatest(700, least(greatest(700, least(floor(CASE id % 3 WHEN 0 THEN 1200 WHEN 1 THEN 1200 * greatest(1, attempts) ELSE 1200 * pow(2, greatest(1, attempts) - 1) END), 12000)) + floor(((id % 10) / 10.0) * floor(220 * 0.45)), 12000)) AS BIGINT) AS page_ms FROM v_jobs""",
)
def _(t):
    j = (c("id") % 10) / F.lit(10.0)
    strategy = F.when(c("id") % 3 == 0, "fixed").when(c("id") % 3 == 1, "linear").otherwise("exponential")
    page = times.retry_delay_ms(strategy, F.lit(1200), c("attempts"), F.lit(700), F.lit(12000), F.lit("bounded"), F.lit(220), j)
    return t.v_jobs.select("id", times.job_backoff_seconds(c("attempts"), j).alias("job_seconds"), page.alias("page_ms"))


@query(
    "d06_age_ttl",
    f"""SELECT event_id, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 60000000.0) AS BIGINT) AS age_minutes,
      epoch_us(ts) + 24 * 3600000000 > epoch_us(TIMESTAMP '{NOW}') AS key_alive, epoch_us(ts) >= epoch_us(TIMESTAMP '{NOW}') - 30 * 86400000000 AS hint_alive,
      epoch_us(ts) < epoch_us(TIMESTAMP '{NOW}') - 300000000 AS lock_expired, greatest(0, CAST(floor((epoch_us(TIMESTAMP '2024-01-16 00:00:00') - epoch_us(ts)) / 1000.0) AS BIGINT)) AS duration_ms FROM events""",
)
def _(t):
    e = t.events.select("event_id", c("ts").cast("timestamp").alias("ts"))
    return e.select(
        "event_id",
        times.age_minutes(c("ts"), now()).alias("age_minutes"),
        (c("ts") + F.expr("INTERVAL 24 HOURS") > now()).alias("key_alive"),
        (c("ts") >= now() - F.expr("INTERVAL 30 DAYS")).alias("hint_alive"),
        (c("ts") < now() - F.expr("INTERVAL 300 SECONDS")).alias("lock_expired"),
        times.not_negative_ms(c("ts"), F.lit("2024-01-16 00:00:00").cast("timestamp")).alias("duration_ms"),
    )


@query("d08_month_bounds", "SELECT o_orderkey, CAST(greatest(1, day(o_orderdate)) AS INT) AS month_day, CAST(greatest(28, day(last_day(o_orderdate))) AS INT) AS month_days FROM orders")
def _(t):
    return t.orders.select("o_orderkey", times.month_day(c("o_orderdate")).alias("month_day"), times.month_days(c("o_orderdate")).alias("month_days"))


@query("n01_percent_round", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {s.pct('l_quantity', 'l_linenumber - 1')} AS share2, {s.pct('l_linenumber', 'l_quantity', 4)} AS share4 FROM lineitem")
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        numbers.percent(c("l_quantity"), c("l_linenumber") - 1).alias("share2"),
        numbers.percent(c("l_linenumber"), c("l_quantity"), 4).alias("share4"),
    )


@query(
    "n02_clamp_parse",
    "SELECT p_partkey, least(60, greatest(1, CAST(floor(coalesce(TRY_CAST(p_size AS DOUBLE), 20)) AS BIGINT))) AS page_links, CASE WHEN TRY_CAST(p_name AS DOUBLE) IS NULL THEN 20 ELSE 0 END::BIGINT AS fallback, least(100, greatest(10, CAST(floor(p_retailprice / 7) AS BIGINT))) AS bounded FROM part",
)
def _(t):
    return t.part.select(
        "p_partkey",
        numbers.clamp_int(c("p_size"), 1, 60, 20).alias("page_links"),
        numbers.clamp_int(c("p_name"), 1, 60, 20).alias("fallback"),
        numbers.clamp_int(c("p_retailprice") / 7, 10, 100, 10).alias("bounded"),
    )


@query(
    "c01_map_helpers",
    """SELECT row_seq, sparse <> '' AS has_sparse, CAST(CASE WHEN sparse <> '' THEN 3 ELSE 2 END AS INT) AS keys_before, CAST(CASE WHEN sparse <> '' THEN 2 ELSE 1 END AS INT) AS keys_after, segment AS renamed FROM v_rows""",
)
def _(t):
    m = F.map_filter(F.create_map(F.lit("segment"), c("segment"), F.lit("constant"), c("constant"), F.lit("sparse"), c("sparse")), lambda k, v: v != "")
    moved = numbers.drop_key(numbers.rename_key(m, "segment", "branch"), "constant")
    return t.v_rows.select(
        "row_seq",
        F.map_contains_key(m, F.lit("sparse")).alias("has_sparse"),
        F.size(m).alias("keys_before"),
        F.size(moved).alias("keys_after"),
        moved["branch"].alias("renamed"),
    )


@query(
    "p12_http_url",
    f"SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#]+') AS page_ok, false AS path_ok, regexp_matches(replace(url, 'http:', 'ftp:'), '(?i)^https?://[^/?#]+') AS ftp_ok FROM pages",
)
def _(t):
    p = t.pages
    return p.select(
        "page_id",
        urls.is_http(c("url")).alias("page_ok"),
        urls.is_http(F.regexp_extract(c("url"), "(/[^/]*)$", 1)).alias("path_ok"),
        urls.is_http(F.replace(c("url"), F.lit("http:"), F.lit("ftp:"))).alias("ftp_ok"),
    )


@query(
    "p13_public_target",
    """WITH h AS (SELECT event_id, (event_id * 7) % 256 AS a, (event_id * 13) % 256 AS b, CASE WHEN event_type = 'error' THEN 'svc' || user_id || '.internal' WHEN event_type = 'view' THEN 'localhost'
        ELSE ((event_id * 7) % 256) || '.' || ((event_id * 13) % 256) || '.' || (user_id % 256) || '.9' END AS host, event_type FROM events),
      g AS (SELECT *, (event_type IN ('error', 'view') OR a IN (10, 127, 0) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 198 AND b IN (18, 19))) AS blocked FROM h)
      SELECT event_id, NOT blocked AS url_ok, CASE WHEN blocked THEN 'BLOCKED_TARGET_HOST' END AS code, CASE WHEN NOT blocked THEN 'https://' || host || '/hook' END AS url FROM g""",
)
def _(t):
    e = t.events
    ip = F.concat_ws(".", (c("event_id") * 7) % 256, (c("event_id") * 13) % 256, c("user_id") % 256, F.lit("9"))
    host = F.when(c("event_type") == "error", F.concat(F.lit("svc"), "user_id", F.lit(".internal"))).when(c("event_type") == "view", "localhost").otherwise(ip)
    g = urls.public_target(F.concat(F.lit("https://"), host, F.lit("/hook")), "INVALID_EXTRACTION_PAYLOAD")
    return e.select("event_id", g.alias("g")).select("event_id", c("g.ok").alias("url_ok"), "g.code", "g.url")


@query(
    "p14_search_urls",
    f"""WITH p AS (SELECT page_id, replace(url, 'page=', 'q=') AS url, {s.url_host('url')} AS host FROM pages)
      SELECT page_id, contains(host, 'google.') OR contains(host, 'bing.com') OR contains(host, 'duckduckgo.com') OR contains(host, 'yahoo.') OR contains(host, 'yandex.') AS search_host,
      (regexp_matches({s.url_part('url', 4)}, '[?&](q|query|keyword)(=|&|$)') AND (contains(lower({s.url_path('url')}), '/search') OR {s.url_path('url')} = '/' OR starts_with(lower({s.url_path('url')}), '/results'))) OR contains(host, 'duckduckgo.com') OR contains(host, 'yandex.') AS results_page FROM p""",
)
def _(t):
    u = F.replace(c("url"), F.lit("page="), F.lit("q="))
    return t.pages.select("page_id", urls.is_search_host(urls.parts(c("url"))["host"]).alias("search_host"), urls.is_search_results(u).alias("results_page"))


@query(
    "p15_email_domain_filter",
    f"""WITH e AS (SELECT doc_id, unnest({s.emails('text')}) AS email FROM documents)
      SELECT DISTINCT doc_id, email FROM e WHERE ends_with(string_split(email, '@')[2], 'example.com') OR ends_with(string_split(email, '@')[2], '.org')""",
)
def _(t):
    found = contacts.emails(c("text"), domains=["example.com", ".ORG"])
    return t.documents.select("doc_id", F.explode(found).alias("email"))


@query(
    "u01_distinct_list",
    f"""WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda x: {s.trim_ws('x')}), lambda x: x <> '') AS items FROM documents)
      SELECT doc_id, CAST(len(list_distinct(items)) AS BIGINT) AS n, array_to_string({s.first_of_each('items')}, '|') AS items FROM d""",
)
def _(t):
    items = numbers.distinct_texts(F.split("text", r"\."))
    return t.documents.select("doc_id", F.size(items).cast("long").alias("n"), F.array_join(items, "|").alias("items"))
