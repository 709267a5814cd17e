"""Values for people: dates, durations, sizes, labels, shares and marks in a text."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from policylake.functions.common import strip, truthy


def combine_errors(*messages: Column) -> Column:
    """Non-empty messages joined with `` | ``; NULL without one."""
    kept = F.filter(F.array(*messages), lambda m: truthy(strip(m)))
    return F.when(F.size(kept) > 0, F.array_join(kept, " | "))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def elapsed_ms(start: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def success_rate(ok: Column, processed: Column) -> Column:
    """Per cent with two digits, 0 where nothing was processed."""
    return F.when(processed > 0, F.round(ok / processed * 100, 2)).otherwise(F.lit(0.0))


def duration(ms: Column) -> Column:
    """``Hh MMm``, ``Mm SSs`` or ``Ss``; a dash for NULL and nothing positive."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))
    return F.when(ms > 0, text).otherwise(F.lit("—"))


def byte_size(n: Column) -> Column:
    """Bytes with a unit of 1024, one digit above bytes."""
    out = F.when(n < 1024, F.format_string("%d B", n.cast("bigint")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", n / F.lit(float(1024**k))))
    return out.otherwise(F.format_string("%.1f TB", n / F.lit(float(1024**4))))


def extraction_label(method: Column) -> Column:
    return F.when(~truthy(method), F.lit("Unknown")).when(method == "trafilatura", F.lit("Trafilatura")).otherwise(F.lit("Fallback"))


def match_count(text: Column, query: Column) -> Column:
    """How often a literal occurs, regardless of case, without overlap; 0 for the empty query."""
    q = F.lower(strip(query))
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(truthy(q), ((F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)).cast("int")).otherwise(F.lit(0))


def highlight(text: Column, query: str) -> Column:
    """A text as segments (part, hit): the matches of a literal, regardless of case, and what is between them."""
    q = query.strip()
    if not q:
        return F.array(F.struct(text.alias("part"), F.lit(False).alias("hit")))
    pattern = "(?i)" + r"\Q" + q.replace("\\E", "") + r"\E"
    parts = F.split(F.regexp_replace(text, f"({pattern})", "\u0001$1\u0001"), "\u0001")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(p.alias("part"), (F.lower(p) == q.lower()).alias("hit")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def eta_ms(elapsed: Column, processed: Column, total: Column) -> Column:
    """Time left at the pace so far; NULL before the first site."""
    p = processed / total
    return F.when((total > 0) & (processed > 0), F.round(elapsed / p - elapsed))


def stage_index(stage: Column) -> Column:
    """The step of a site's stage; NULL for others."""
    out = F.when(F.lit(False), F.lit(0))
    for k, s in enumerate(("home_fetch", "policy_discovery", "third_party_extract", "third_party_policy_fetch")):
        out = out.when(stage == s, F.lit(k))
    return out


def percent(part: Column, whole: Column) -> Column:
    """Rounded per cent, halves up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(F.lit(0)).cast("int")


def rest_percent(*percents: Column) -> Column:
    """What is left of a hundred, never below 0."""
    return F.greatest(F.lit(0), 100 - sum(percents, F.lit(0)))


def bar_width(value: Column, floor: float = 1.0) -> Column:
    """Width of a bar in per cent of the longest of all rows."""
    return F.least(F.lit(100.0), value / F.greatest(F.lit(floor), F.max(value).over(Window.partitionBy())) * 100)


def mapping_mode(radar: bool, trackerdb: bool) -> str:
    return {(True, True): "mixed", (False, True): "trackerdb", (True, False): "radar", (False, False): "none"}[radar, trackerdb]


def proxy_config(address: str | None) -> dict[str, str] | None:
    """``server`` and, where the address names them, ``username`` and ``password`` of a proxy."""
    from urllib.parse import unquote, urlsplit

    if not address:
        return None
    u = urlsplit(address if "://" in address else f"http://{address}")
    if not u.hostname:
        return {"server": address}
    out = {"server": f"{u.scheme}://{u.hostname}" + (f":{u.port}" if u.port else "")}
    for key, value in (("username", u.username), ("password", u.password)):
        if value:
            out[key] = unquote(value)
    return out
