"""Text, anchors and main text of HTML, as Arrow UDFs over the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake.functions.common import strip, truthy
from policylake.functions.url import in_domains
from policylake.resources import fixed

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
#: Tags that end an open one of the same kind without an end tag of it.
_SELF_CLOSING = {"li": ("ul", "ol"), "p": ("div", "section", "article", "td"), "td": ("tr",), "tr": ("table",), "option": ("select",)}


class _Walker(HTMLParser):
    """Collects visible text nodes, anchors and the texts of notice containers in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.hidden = 0
        self.text: list[str] = []
        self.anchors: list[list] = []  # [text parts, href, number of footers it is in]
        self.open_anchors: list[tuple[int, list]] = []
        self.notices: list[tuple[int, int, list[str]]] = []  # (priority, order, text)
        self.open_notices: list[tuple[int, list]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _VOID:
            return
        if tag == "a":  # anchors do not nest
            self._close("a")
        within = _SELF_CLOSING.get(tag)
        if within and tag in self.stack and not any(t in within for t in self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]):
            self._close(tag)
        self.stack.append(tag)
        self.hidden += tag in _HIDDEN
        if tag == "a" and a.get("href") is not None:
            rec = [[], a["href"], self.stack.count("footer")]
            self.anchors.append(rec)
            self.open_anchors.append((len(self.stack), rec))
        if tag == "div":
            classes, ident = (a.get("class") or "").split(), a.get("id") or ""
            for rank, hit in enumerate(("otnotice-content" in classes, ident.startswith("otnotice-"), "otnotice" in classes)):
                if hit:
                    rec = (rank, len(self.notices), [])
                    self.notices.append(rec)
                    self.open_notices.append((len(self.stack), rec))
                    break

    def handle_startendtag(self, tag, attrs):
        if tag not in _VOID:
            self.handle_starttag(tag, attrs)
            self._close(tag)

    def _close(self, tag):
        if tag not in self.stack:
            return
        at = len(self.stack) - 1 - self.stack[::-1].index(tag)
        self.hidden -= sum(t in _HIDDEN for t in self.stack[at:])
        del self.stack[at:]
        self.open_anchors = [x for x in self.open_anchors if x[0] <= at]
        self.open_notices = [x for x in self.open_notices if x[0] <= at]

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        if self.hidden:
            return
        self.text.append(data)
        for _, rec in self.open_anchors:
            rec[0].append(data)
        for _, rec in self.open_notices:
            rec[2].append(data)


def walk(markup: str) -> _Walker:
    w = _Walker()
    w.feed(markup)
    w.close()
    return w


def visible_lines(parts: list[str]) -> str:
    """Text nodes as trimmed lines, blank ones left out."""
    return "\n".join(s for s in (x.strip() for x in "\n".join(parts).splitlines()) if s)


def _udf(kind, one):
    """An Arrow UDF of one text function; NULL and unreadable markup give NULL."""

    def run(xs: pa.Array) -> pa.Array:
        out = []
        for x in xs.to_pylist():
            try:
                out.append(None if not x else one(x))
            except (ValueError, AssertionError, RecursionError):
                out.append(None)
        return pa.array(out, kind[1])

    return F.arrow_udf(run, kind[0])


def html_to_text(markup: Column) -> Column:
    """All visible text, a line for each text node; NULL for NULL and empty markup."""
    return _udf(("string", pa.string()), lambda x: visible_lines(walk(x).text))(markup)


def anchors(markup: Column) -> Column:
    """Links with a target: array of (text, href, source, ord), footers' first (once per footer around them), then all as ``body``."""
    kind = pa.list_(pa.struct([("text", pa.string()), ("href", pa.string()), ("source", pa.string()), ("ord", pa.int32())]))

    def one(x: str):
        links = [(" ".join(" ".join(p).split()), h, n) for p, h, n in walk(x).anchors]
        rows = [(t, h, "footer") for t, h, n in links for _ in range(n)] + [(t, h, "body") for t, h, _ in links]
        return [{"text": t, "href": h, "source": s, "ord": k} for k, (t, h, s) in enumerate(rows)]

    return _udf(("array<struct<text:string,href:string,source:string,ord:int>>", kind), one)(markup)


def anchor_count(markup: Column) -> Column:
    """Number of links with a target, by pattern, without leaving the JVM; 0 for NULL."""
    return F.coalesce(F.regexp_count(markup, F.lit(r"(?is)<a\s[^>]*?\bhref\s*=")), F.lit(0))


def onetrust_notice(markup: Column, source_url: Column) -> Column:
    """The text of a notice container, cut before the cookie panel; NULL where a page has none.

    Containers are tried by kind (content, id, class) and then in page order; one counts if it has 120 characters and a
    phrase of such notices. Without one, the page's text from shortly before the notice to the panel is taken.
    """

    def cut_panel(text: str, start: int = 0) -> str:
        low = text.lower()
        at = [k for k in (low.find(t, start) for t in fixed.ONETRUST_PANEL) if k > 0]
        return text[: min(at)].rstrip() if at else text

    def hinted(text: str) -> bool:
        return any(h in text.lower() for h in fixed.ONETRUST_HINTS)

    def one(x: str) -> str | None:
        w = walk(x)
        for _, _, parts in sorted(w.notices, key=lambda n: n[:2]):
            text = visible_lines(parts)
            if len(text) >= 120 and hinted(text) and len(text := cut_panel(text)) >= 120:
                return text
        text = visible_lines(w.text)
        if not text or not hinted(text):
            return None
        low = text.lower()
        at = max(low.find("this privacy notice"), -1)
        at = low.find("privacy notice") if at < 0 else at
        start = max(0, at - 120) if at >= 0 else 0
        text = cut_panel(text, start + 1)[start:].strip()
        return text if len(text) >= 120 else None

    concerned = in_domains(source_url, fixed.ONETRUST_DOMAINS) | F.lower(markup).contains("otnotice")
    return _udf(("string", pa.string()), one)(F.when(concerned, markup))


def main_text(markup: Column, source_url: Column, extractor=None) -> Column:
    """``struct<text, method>``: notice container, then an optional extractor column, then all visible text; NULLs where nothing is left.

    ``extractor`` is a function from (markup, url) columns to a text column, for a main-content library where one is installed.
    """
    notice, rest = onetrust_notice(markup, source_url), html_to_text(markup)
    main = strip(extractor(markup, source_url)) if extractor else F.lit(None).cast("string")
    text = F.when(truthy(notice), notice).when(truthy(main), main).when(truthy(strip(rest)), rest)
    method = F.when(truthy(notice), F.lit("onetrust_container")).when(truthy(main), F.lit("trafilatura")).when(truthy(strip(rest)), F.lit("fallback"))
    return F.struct(text.alias("text"), method.alias("method"))


def fetch_text(text: Column, method: Column, markdown: Column) -> Column:
    """``struct<text, method>`` of a fetch: the extracted text, else the crawler's own rendering as ``fallback``."""
    own = truthy(strip(text))
    other = truthy(strip(markdown))
    return F.struct(F.when(own, text).when(other, markdown).alias("text"), F.when(own, method).when(other, F.lit("fallback")).alias("method"))


def has_html_marker(body: Column) -> Column:
    return F.coalesce(body.rlike(fixed.HTML_MARKER), F.lit(False))


def quote(s: str) -> str:
    """A literal for a Java pattern."""
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def non_browsable(status: Column, text: Column, markup: Column) -> Column:
    """Why a page cannot be browsed, NULL if it can: its HTTP state, an error page's words, or hardly any text and links."""
    t = F.lower(strip(F.coalesce(F.nullif(text, F.lit("")), html_to_text(F.when(F.coalesce(text, F.lit("")) == "", markup)), F.lit(""))))
    n, links = F.length(t), anchor_count(F.nullif(markup, F.lit("")))
    error = t.rlike("|".join(f"(?:{p})" for p in fixed.ERROR_PAGE_PATTERNS))
    return (
        F.when(status >= 400, F.concat(F.lit("http_status_"), status.cast("string")))
        .when(error, F.lit("error_page_text"))
        .when((n < 200) & (links == 0), F.lit("no_links_short_text"))
        .when((n < 80) & (links <= 1), F.lit("very_sparse_page"))
    )


def response_error(status: Column, content_type: Column, body: Column) -> Column:
    """What is wrong with a plain HTTP response, NULL if it is a page."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    page_type = ct.contains("text/html") | ct.contains("application/xhtml")
    return (
        F.when(status >= 400, F.concat(F.lit("http_status_"), status.cast("string")))
        .when(~truthy(body), F.lit("empty_body"))
        .when(~page_type & ~has_html_marker(body), F.concat(F.lit("non_html_content_type:"), ct))
        .when(~has_html_marker(body), F.lit("html_marker_missing"))
    )


def strip_links(line: Column) -> Column:
    """Inline link markup replaced by its text."""
    return F.regexp_replace(line, r"\[([^\]]+)\]\([^)]+\)", "$1")


