"""Classification expressions: request families, event taxonomy, error triage, request texts."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagegrid.functions.text import WS, clean_text, to_text, trim_ws
from pagegrid.functions.urls import encode_component

AUTH_SLO_PATHS = ["/api/auth/login", "/api/auth/refresh"]
LICENSE_SLO_PATHS = ["/api/license/status", "/api/devices/validate-devices"]


def request_family(path: Column) -> Column:
    return (
        F.when(path.startswith("/api/auth/"), "auth")
        .when(path.startswith("/api/license/"), "license")
        .when(path.startswith("/api/devices"), "devices")
        .when(path.isin("/healthz", "/readyz"), "health")
        .when(path.startswith("/api/observability/") | (path == "/metrics"), "observability")
        .otherwise("other")
    )


def status_class(code: Column) -> Column:
    return F.when(code >= 500, "5xx").when(code >= 400, "4xx").when(code >= 300, "3xx").when(code >= 200, "2xx").otherwise("1xx")


# Event type -> (event name, severity, stage).
EVENT_TAXONOMY = {
    "automation.started": ("extraction_started", "info", "start"),
    "automation.progress": ("extraction_progress", "info", "progress"),
    "automation.stop_requested": ("extraction_stop_requested", "warning", "stop_request"),
    "automation.stopped": ("extraction_stopped", "warning", "stopped"),
    "automation.completed": ("extraction_completed", "info", "completed"),
    "automation.failed": ("extraction_failed", "error", "failed"),
}
# Page action -> tool.
TOOL_BY_ACTION = {
    "EXTRACT_PAGES_EMAIL": "email",
    "EXTRACT_PAGES_TEXT": "text",
    "EXTRACT_PAGES_GOOGLE_MAPS": "maps",
    "EXTRACT_PAGES_PHONE": "phone",
    "EXTRACT_PAGES": "pages",
}


def event_taxonomy(event_type: Column) -> Column:
    """Struct (event_name, severity, stage); unknown types read as progress."""
    default = EVENT_TAXONOMY["automation.progress"]
    out = []
    for i, name in enumerate(["event_name", "severity", "stage"]):
        c = F.lit(default[i])
        for kind, values in EVENT_TAXONOMY.items():
            c = F.when(event_type == kind, values[i]).otherwise(c)
        out.append(c.alias(name))
    return F.struct(*out)


def tool_type(runner: Column, action: Column) -> Column:
    tool = F.lit("pages")
    for name, value in TOOL_BY_ACTION.items():
        tool = F.when(F.upper(trim_ws(to_text(action))) == name, value).otherwise(tool)
    return (
        F.when(runner == "listExtractor", "list")
        .when(runner == "metadataExtractor", "metadata")
        .when(runner == "pageExtractor", tool)
        .otherwise("unknown")
    )


# A word edge between ASCII word characters only; the JVM's own edge also counts accented letters.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    return pattern.replace(r"\b", _EDGE)


def _any(text: Column, tokens: list[str]) -> Column:
    found = F.lit(False)
    for t in tokens:
        found = found | text.contains(t)
    return found


# Error type -> words that decide it, tried in order.
ERROR_WORDS = [
    ("permission", ["permission"]),
    ("timeout", ["timeout", "timed out"]),
    ("selector", ["selector"]),
    ("network", ["network", "fetch", "socket", "connect"]),
    ("validation", ["invalid", "validation"]),
]


def error_type(code: Column, message: Column) -> Column:
    hay = F.lower(F.concat(to_text(code), F.lit(" "), to_text(message)))
    c = F.lit("unexpected")
    for name, words in reversed(ERROR_WORDS):
        c = F.when(_any(hay, words), name).otherwise(c)
    return c


def error_severity(kind: Column) -> Column:
    return F.when(kind.isin("permission", "unexpected"), "critical").when(kind == "validation", "warning").otherwise("error")


def error_recoverable(kind: Column) -> Column:
    return kind.isin("timeout", "network", "selector")


# Text found in an error -> advice shown for it, tried in order.
ADVICE = [
    (["Host permission denied by user"], "Access to this site was denied. Allow browser access and retry."),
    (["Permission API timeout"], "Permission prompt timed out. Click Enable All Access again and approve the browser prompt."),
    (["must be called during a user gesture"], "Permission request must be triggered by a click. Click Enable All Access again."),
    (
        ["Extension manifest must request permission to access this host"],
        "Access to this site is missing. Click Enable All Access, allow permission, then retry.",
    ),
    (
        ["Required permission was denied by the user"],
        "Access to this site was denied. Use Enable All Access and allow permission, then retry.",
    ),
    (["Missing bearer token", "Invalid or expired token"], "Login required. Open Activation, sign in, then retry."),
    (["Cloud features are not enabled for this account"], "Enable Cloud features opt-in in Cloud Control, then retry."),
    (["Webhook delivery is not enabled for this account"], "Enable Webhook delivery opt-in in Cloud Control, then retry."),
    (["Optional cloud features are disabled"], "Cloud features are disabled on the server. Local extraction still works."),
]


def error_advice(message: Column) -> Column:
    raw = trim_ws(to_text(message))
    c = raw
    for words, text in reversed(ADVICE):
        c = F.when(_any(raw, words), F.lit(text)).otherwise(c)
    return F.when(raw == "", F.lit("Unknown error")).otherwise(c)


# Word lists of the request-text flags.
VERBS = ["extract", "scrape", "collect", "gather", "run", "get", "find", "pull", "grab"]
HINTS = {
    "access": ["permission", "access", "enable all access", "allow all access"],
    "export": ["export", "download", "save as", "sheet", "xlsx", "json", "csv"],
    "maps": ["google maps", "maps", "map pack", "local pack", "near me"],
    "local_leads": [
        "home service", "home services", "contractor", "plumber", "electrician", "roofer", "hvac", "landscaper",
        "cleaning service", "repair service",
    ],
    "email": ["email", "emails", "mailbox", "contact email"],
    "phone": ["phone", "phones", "call", "contact number"],
    "text": ["text", "article", "content", "copy", "headline"],
    "metadata": ["metadata", "json-ld", "schema", "meta tag"],
    "exhaustive": [
        "until no more", "keep going", "extract all", "all in this search", "full results", "whole website",
        "entire website", "all pages",
    ],
    "data": [
        "info", "information", "data", "result", "results", "lead", "leads", "company", "companies", "business",
        "businesses", "search",
    ],
}
CONVERSATIONAL = r"(?i)\b(i\s+(want|need)|show me|give me|find me|looking for)\b"
TARGET_WORDS = r"(?i)\b([0-9]{1,5})\s*\+?\s*(?:results?|rows?|records?|items?|leads?|companies|businesses)\b"
TARGET_TOP = r"(?i)\b(?:top|first)\s+([0-9]{1,5})\b"
FIRST_URL = r"""(?i)https?://[^\s)"'<>]+"""


# Signs of a wish for new results, and where the topic of a request stands.
FRESH_WORDS = ["fresh", "latest", "today", "recent", "newly"]
FRESH_PATTERN = r"(?i)\bup[-\s]?to[-\s]?date\b"
TOPIC_PATTERN = r"(?i)\b(?:for|about|on)\s+(.+)$"
SEARCH_PATTERN = r"(?i)^.*?\bsearch\b\s*"


def goal_flags(text: Column, most: int | None = 50_000) -> dict[str, Column]:
    """Named columns describing a request text."""
    raw = clean_text(text)
    low = F.lower(raw)
    flag = {name: _any(low, words) for name, words in HINTS.items()}
    verb = low.rlike(ascii_edges(r"\b(" + "|".join(VERBS) + r")\b"))
    talk = raw.rlike(ascii_edges(CONVERSATIONAL))
    any_topic = flag["data"] | flag["maps"] | flag["local_leads"] | flag["email"] | flag["phone"] | flag["text"] | flag["metadata"]
    extract = verb | low.contains("quick extract") | ((raw != "") & ~flag["access"] & ~flag["export"] & (talk | any_topic))
    fresh = _any(low, FRESH_WORDS) | raw.rlike(ascii_edges(FRESH_PATTERN))
    by_words, by_top = F.regexp_extract(raw, ascii_edges(TARGET_WORDS), 1), F.regexp_extract(raw, ascii_edges(TARGET_TOP), 1)
    target = F.when(by_words != "", by_words).when(by_top != "", by_top).otherwise("0").cast("int")
    return {
        "explicit_url": F.regexp_extract(raw, FIRST_URL, 0),
        "wants_extract": extract,
        "wants_access": flag["access"],
        "wants_export": flag["export"],
        "wants_point_follow": low.contains("point") & low.contains("follow"),
        "wants_maps": flag["maps"],
        "wants_local_leads": flag["local_leads"],
        "wants_email": flag["email"],
        "wants_phone": flag["phone"],
        "wants_text": flag["text"],
        "wants_metadata": flag["metadata"],
        "wants_exhaustive": flag["exhaustive"],
        "wants_fresh": fresh,
        "result_target": (target if most is None else F.least(F.lit(most), target)).cast("long"),
        "export_format": F.when(_any(low, ["xlsx", "excel"]), "xlsx").when(low.contains("json"), "json").otherwise("csv"),
    }


# Leading words dropped from a request, each tried once in this order.
INSTRUCTION_PATTERNS = [
    r"(?i)^(please|can you|could you|would you)\s+",
    r"(?i)^(show|give|find|get)\s+me\b",
    r"(?i)^i\s+(want|need|would like)\s+",
    r"(?i)^looking\s+for\s+",
    r"(?i)^(info|information|data)\s+(for|of|on|about)\s+",
    r"(?i)^(" + "|".join(VERBS) + r")\b",
    r"(?i)^(all|everything|results)\b",
    r"(?i)^(from|for|about|on)\b",
]


def _strip_instruction(c: Column) -> Column:
    for p in INSTRUCTION_PATTERNS:
        c = F.trim(F.regexp_replace(c, ascii_edges(p), ""))
    return clean_text(c)


def goal_query(text: Column) -> Column:
    """What the request is about, '' when it names a URL."""
    raw = clean_text(text)
    by_for = F.regexp_extract(raw, ascii_edges(TOPIC_PATTERN), 1)
    after_search = F.regexp_replace(raw, ascii_edges(SEARCH_PATTERN), "")
    body = (
        F.when(by_for != "", clean_text(by_for))
        .when(F.lower(raw).contains("search"), _strip_instruction(after_search))
        .otherwise(_strip_instruction(raw))
    )
    return F.when(F.regexp_extract(raw, FIRST_URL, 0) != "", F.lit("")).otherwise(body)


def goal_discovery_url(query: Column, flags: dict[str, Column]) -> Column:
    enc = F.replace(encode_component(clean_text(query)), F.lit("%20"), F.lit("+"))
    local = flags["wants_maps"] | flags["wants_local_leads"]
    fresh = F.when(flags["wants_fresh"], F.lit("&tbs=qdr:d")).otherwise("")
    return (
        F.when(flags["explicit_url"] != "", flags["explicit_url"])
        .when(query == "", F.lit(""))
        .when(local, F.concat(F.lit("https://www.google.com/maps/search/"), enc))
        .otherwise(F.concat(F.lit("https://www.google.com/search?q="), enc, fresh))
    )


def goal_strategy(flags: dict[str, Column], target_url: Column, simple: bool = True) -> Column:
    u = F.lower(target_url)
    maps = flags["wants_maps"] | flags["wants_local_leads"] | u.contains("google.com/maps") | u.contains("maps.google.")
    page = flags["wants_email"] | flags["wants_phone"] | flags["wants_text"] | flags["wants_metadata"] | maps
    extract = flags["wants_extract"]
    return (
        F.when(flags["wants_access"] & ~extract & ~flags["wants_point_follow"] & ~flags["wants_export"], "access_only")
        .when(flags["wants_export"] & ~extract, "export_only")
        .when(flags["wants_point_follow"], "point_follow_guided")
        .when(extract & maps, "maps_autopilot")
        .when(extract & page, "page_autopilot")
        .when(extract & F.lit(simple), "list_autodetect_autopilot")
        .otherwise("idle")
    )
