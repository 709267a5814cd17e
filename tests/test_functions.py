import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from policylake.functions import display, html, scoring, url
from policylake.functions.clean import clean_policy_text
from policylake.functions.common import norm_space, safe_dirname, truthy, word_count
from policylake.resources import fixed


def one(spark, expr, **values):
    kinds = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(expr).first()[0]


def test_truthy(spark):
    for v, want in ((None, False), ("", False), ("x", True)):
        assert one(spark, truthy(F.col("v")), v=v) is want
    assert one(spark, truthy(F.col("v"), "number"), v=0) is False
    assert one(spark, truthy(F.col("v"), "number"), v=0.5) is True


@pytest.mark.parametrize(
    ("u", "want"),
    [
        ("https://user@EX.com:8/p", "ex.com"), ("http://[2001:db8::1]/x", "2001:db8::1"), ("a_b.example/p", None), ("https://a_b.example/p?x=|", "a_b.example"), ("", None), (None, None), ("mailto:x@y.z", None),
    ],
)
def test_hostname(spark, u, want):
    assert one(spark, url.hostname(F.col("u")), u=u) == want


@pytest.mark.parametrize(
    ("h", "want"),
    [
        ("https://www.example.co.uk/x", "example.co.uk"), ("foo.github.io", "github.io"), ("a.b.test", "b.test"), ("127.0.0.1", "127.0.0.1"), ("localhost", "localhost"), ("co.uk", "co.uk"), ("Ex.COM.", "ex.com"), ("", None), (None, None), ("https:///x", None),
    ],
)
def test_etld1(spark, h, want):
    assert one(spark, url.etld1(F.col("h")), h=h) == want


def test_url_helpers(spark):
    assert one(spark, url.origin(F.col("s")), s=" Example.com/x ") == "https://example.com"
    assert one(spark, url.origin(F.col("s")), s="") is None
    assert one(spark, url.site_url(F.col("s")), s="ex.com") == "https://ex.com"
    assert one(spark, url.urljoin(F.col("a"), F.col("b")), a="https://e.com/a/b", b="../c?d") == "https://e.com/c?d"
    assert one(spark, url.to_http(F.col("s")), s="https://e.com") == "http://e.com"
    assert one(spark, url.clean_href(F.col("s")), s=" tel:1") is None
    assert one(spark, url.clean_href(F.col("s")), s=" /p ") == "/p"
    assert one(spark, url.scan_full_page(F.col("s")), s="https://x.onetrust.com/p") is True
    assert one(spark, url.scan_full_page(F.col("s")), s="https://xonetrust.com/p") is False
    assert one(spark, safe_dirname(F.col("s")), s="bücher.de/a b") == "bücher.de_a_b"


@pytest.mark.parametrize(
    ("a", "u", "same", "want"),
    [
        ("Privacy Policy", "https://example.com/privacy-policy", True, 9.8), ("Terms", "https://example.com/terms", True, 0.8), ("Privacy Policy", "https://policies.google.com/privacy", False, 8.2),
        ("Cookies", "https://example.com/cookies", True, -0.7), ("Privacy", "https://example.com/account/privacy", True, 7.8), ("Impressum", "https://example.com/datenschutz", True, 5.8),
    ],
)
def test_link_score(spark, a, u, same, want):
    assert one(spark, scoring.link_score(F.col("a"), F.col("u"), F.col("s")), a=a, u=u, s=same) == pytest.approx(want)


@pytest.mark.parametrize(
    ("t", "want"),
    [(None, -10.0), ("", -10.0), ("privacy " + "w " * 885, 3.415), ("privacy gdpr " + "w " * 404, 3.415), ("cookie " + "w " * 99, -1.25), ("privacy gdpr rgpd datenschutz données personenbez " + "w " * 3000, 13.2)],
)
def test_policy_likeliness(spark, t, want):
    assert one(spark, scoring.policy_likeliness(F.col("t")), t=t) == pytest.approx(want)


def test_accept(spark):
    for s, n, want in ((5.0, 300, True), (4.9, 300, False), (4.0, 500, True), (3.0, 800, True), (3.0, 799, False), (0.0, 9000, False)):
        assert one(spark, scoring.accept_policy(F.lit(True), F.col("s"), F.col("n")), s=s, n=n) is want


@pytest.mark.parametrize(
    ("status", "text", "markup", "want"),
    [
        (404, None, None, "http_status_404"), (200, None, "<h1>403 Forbidden</h1><p>Access Denied</p>", "error_page_text"), (200, None, "<html><body>OK</body></html>", "no_links_short_text"),
        (200, "x" * 60, '<a href="/">x</a>', "very_sparse_page"), (200, "x" * 300, "", None), (301, "x" * 300, None, None),
    ],
)
def test_non_browsable(spark, status, text, markup, want):
    df = spark.createDataFrame([(status, text, markup)], "s int, t string, h string")
    assert df.select(html.non_browsable(F.col("s"), F.col("t"), F.col("h"))).first()[0] == want


def test_response_cascade(spark):
    page = "<!doctype html><html></html>"
    for status, ct, body, want in (
        (500, "text/html", page, "http_status_500"), (200, "text/html", "", "empty_body"), (200, "application/pdf", "%PDF", "non_html_content_type:application/pdf"), (200, "text/html", "hello", "html_marker_missing"), (200, "text/plain", page, None), (200, "text/html", page, None),
    ):
        assert one(spark, html.response_error(F.col("s"), F.col("c"), F.col("b")), s=status, c=ct, b=body) == want


def test_html(spark):
    m = '<body><script>var a="<a href=x>";</script><p>One &amp;<b> two</p><footer><a href="/privacy">Privacy\n policy</a></footer><a name=x>no</a><!-- c --></body>'
    df = spark.createDataFrame([(m,), (None,), ("",), ("<p>open <b>never closed",)], "h string")
    assert [r[0] for r in df.select(html.html_to_text(F.col("h"))).collect()] == ["One &\ntwo\nPrivacy\npolicy\nno", None, None, "open\nnever closed"]
    a = df.select(html.anchors(F.col("h"))).first()[0]
    assert [(x["text"], x["href"], x["source"]) for x in a] == [("Privacy policy", "/privacy", "footer"), ("Privacy policy", "/privacy", "body")]


def test_onetrust(spark):
    notice = "This Privacy Notice says what we do. " * 5 + "Personal information we collect."
    m = f'<div id="otnotice-a" class="otnotice"><div class="otnotice-content"><h1>Notice</h1><p>{notice}</p><h2>How can you manage your preferences?</h2></div></div><div>Cookie List</div>'
    df = spark.createDataFrame([(m, "https://x.example/p"), ("<p>plain</p>", None), (None, None)], "h string, u string")
    r = [x[0] for x in df.select(html.main_text(F.col("h"), F.col("u"))).collect()]
    assert r[0]["method"] == "onetrust_container" and "Personal information" in r[0]["text"] and "manage your" not in r[0]["text"]
    assert (r[1]["text"], r[1]["method"]) == ("plain", "fallback")
    assert (r[2]["text"], r[2]["method"]) == (None, None)


def test_display(spark):
    assert display.proxy_config("http://u:p%40@h:8080") == {"server": "http://h:8080", "username": "u", "password": "p@"} and display.proxy_config("") is None
    assert one(spark, display.duration(F.col("m")), m=3_725_000) == "1h 02m"
    assert one(spark, display.duration(F.col("m")), m=65_000) == "1m 05s"
    assert one(spark, display.duration(F.col("m")), m=0) == "—"
    assert one(spark, display.byte_size(F.col("m")), m=1536) == "1.5 KB"
    assert one(spark, display.match_count(F.col("t"), F.col("q")), t="Data a.data", q=" DATA ") == 2
    assert one(spark, display.match_count(F.col("t"), F.col("q")), t="Data", q=" ") == 0
    assert [tuple(x) for x in one(spark, display.highlight(F.col("t"), "b.c"), t="ab.cB.C")] == [("a", False), ("b.c", True), ("B.C", True)]
    assert one(spark, display.combine_errors(F.col("a"), F.col("b"), F.lit(" ")), a="x", b=None) == "x"
    assert one(spark, display.escape_html(F.col("t")), t="<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;"
    assert one(spark, display.success_rate(F.col("a"), F.col("b")), a=1, b=3) == 33.33
    assert one(spark, display.percent(F.col("a"), F.col("b")), a=1, b=8) == 13
    assert one(spark, display.extraction_label(F.col("t")), t="onetrust_container") == "Fallback"
    assert one(spark, display.eta_ms(F.col("e"), F.col("p"), F.col("t")), e=1000, p=1, t=4) == 3000


@settings(max_examples=25, deadline=None, derandomize=True)
@given(st.text(alphabet=st.sampled_from("ab  \t\n　é"), max_size=40))
def test_words_like_python(spark, t):
    assert one(spark, word_count(F.col("t")), t=t) == len(t.split())
    assert one(spark, norm_space(F.col("t")), t=t) == " ".join(t.split())


def plain_clean(text):
    """The line cleaner again, in plain Python, for comparison."""
    import re

    text = re.sub(r"!\[[^\]]*\]\([^)]+\)", "", text or "")
    norm = lambda s: " ".join(s.lower().split())
    has = lambda s, ws: any(w in s for w in ws)
    raw = [x.strip() for x in text.splitlines()]
    seen = [norm(x) for x in raw]
    out, blank = [], False
    for x in raw:
        if not x:
            blank = True
            continue
        m = re.match(r"^((?:#{1,6}\s+|[-*•]\s+|\d+\.\s+)?)\[([^\]]+)\]\([^)]+\)$", x)
        if m:
            label = m[2].strip()
            ws = label.split()
            head = has(label.lower(), fixed.KEEP_KEYWORDS) or (len(label) <= 90 and ws and sum(w[0].isupper() for w in ws) / len(ws) >= 0.6)
            if not m[1] and not head:
                continue
            x = m[1] + label
        else:
            x = re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", x)
        n = norm(x)
        if not n or "](http" in x or re.match(r"https?://|www\.", x):
            continue
        p = re.sub(r"^[#*•\-\d.\s]+", "", n).strip()
        nav = has(n, fixed.FOOTER_TOKENS) or (
            not has(n, fixed.KEEP_KEYWORDS)
            and (has(n, fixed.NAV_KEYWORDS) or x.startswith(("#####", "* #####")) or "©" in x or "copyright" in n or ("yes" in n and "no" in n and len(n) <= 12) or p in fixed.SHORT_NAV_TOKENS or (seen.count(n) >= 3 and len(n) <= 80))
        )
        out.append([x, n, has(n, fixed.KEEP_KEYWORDS), nav, blank])
        blank = False
    start = next((k for k, c in enumerate(out) if "last updated" in c[1] or ("privacy" in c[1] and ("policy" in c[1] or "notice" in c[1]))), 0)
    end = next((k for k, c in enumerate(out) if k >= int(len(out) * 0.6) and (has(c[1], fixed.FOOTER_TOKENS) or "©" in c[0] or "copyright" in c[1])), len(out))
    lines = []
    for k, (x, n, keep, nav, b) in enumerate(out):
        if not keep and (nav or k >= end or (k < start and len(n) <= 30)) or not re.search(r"[^\W_]", x):
            continue
        lines += ([""] if b and lines else []) + [x]
    return "\n".join(lines).strip()


LINES = st.sampled_from(
    ["", "Home", "Privacy Policy", "Last updated: May", "We keep data.", "[Our Policy](http://x)", "- [item](http://y)", "see [this](http://z) now", "https://x.example", "© 2024 X. All rights reserved.", "© 2024", "Cart", "Yes No", "##### deep", "***", "Menu",
     "![i](u)", "[plain link](u)", "a line of some length that is kept", "Contact us", "Conditions of use", "Copyright X"]
)


def test_clean_policy_text(spark):
    import random

    rng, base = random.Random(4), [""] + [x for x in LINES.elements]
    docs = [(i, "\n".join(rng.choices(base, k=rng.randrange(0, 30)))) for i in range(120)] + [(500, None), (501, ""), (502, "a b\x1cc")]
    got = dict(clean_policy_text(spark.createDataFrame(docs, "id int, t string"), "id", "t").collect())
    assert {i: got[i] for i, _ in docs} == {i: plain_clean(t) for i, t in docs}
