"""Hosts, registrable domains, origins and links as Column expressions; the suffix list and URL joins as Arrow UDFs."""

from __future__ import annotations

import functools
import os
from urllib.parse import urljoin as _join

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.functions.common import strip, truthy
from policylake.resources import fixed

#: A public-suffix-list file; it must be on every machine.
SUFFIX_LIST = os.environ.get("PUBLIC_SUFFIX_LIST", "/usr/share/publicsuffix/public_suffix_list.dat")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"


def hostname(url: Column) -> Column:
    """Lower-cased host of a URL with a scheme, NULL where there is none; tolerant of odd characters."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"[\[\]]", "")), F.lit(""))


def host_or_empty(url: Column) -> Column:
    return F.coalesce(hostname(url), F.lit(""))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i:https?):"), F.lit(False))


def clean_href(href: Column) -> Column:
    """A link target without white space around it; NULL for empty ones and for mail, phone, script and fragment links."""
    h = strip(href)
    skip = F.lit(False)
    for p in fixed.HREF_SKIP:
        skip = skip | h.startswith(p)
    return F.when(truthy(h) & ~skip, h)


def origin(site: Column) -> Column:
    """``scheme://host`` of a site, https where it has no scheme; NULL without a host."""
    s = strip(site)
    u = F.when(s.contains("://"), s).otherwise(F.concat(F.lit("https://"), s))
    return F.when(hostname(u).isNotNull(), F.concat(F.lower(F.regexp_extract(u, "^([^:]*):", 1)), F.lit("://"), hostname(u)))


def site_url(site: Column) -> Column:
    """A trimmed input as a URL; NULL for the empty input."""
    s = strip(site)
    return F.when(truthy(s), F.when(s.contains("://"), s).otherwise(F.concat(F.lit("https://"), s)))


def to_http(url: Column) -> Column:
    return F.regexp_replace(url, "^(?i)https:", "http:")


def in_domains(url: Column, domains) -> Column:
    """Whether the host is one of the domains or below one."""
    h = host_or_empty(url)
    test = F.lit(False)
    for d in domains:
        test = test | (h == d) | h.endswith("." + d)
    return test


def scan_full_page(url: Column) -> Column:
    return in_domains(url, fixed.ONETRUST_DOMAINS)


@functools.cache
def suffix_rules(path: str) -> tuple[frozenset, frozenset, frozenset]:
    """(plain, wildcard, exception) rules of the ICANN section of a suffix list; a missing file is an error, not another result."""
    plain, wild, exc = set(), set(), set()
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip()
            if "END ICANN DOMAINS" in line:
                break
            if line and not line.startswith("//"):
                names = {line, line.encode("idna").decode() if line.isascii() is False and "*" not in line and "!" not in line else line}
                for r in names:
                    (wild if r.startswith("*.") else exc if r.startswith("!") else plain).add(r.lstrip("*!").lstrip("."))
    return frozenset(plain), frozenset(wild), frozenset(exc)


def registrable(host: str | None, rules) -> str | None:
    """The registrable domain of a host; the host itself for addresses, single labels and bare suffixes."""
    if not host:
        return None
    h = host.lower().rstrip(".")
    labels = h.split(".")
    if len(labels) < 2 or "" in labels or ":" in h or labels[-1].isdigit():
        return h or None
    if rules is None:
        return ".".join(labels[-2:])
    plain, wild, exc = rules
    n = 0
    for k in range(len(labels)):
        s = ".".join(labels[k:])
        if s in exc:
            n = len(labels) - k - 1
            break
        if s in plain or (k + 1 < len(labels) and ".".join(labels[k + 1 :]) in wild):
            n = len(labels) - k
            break
    if n == 0:
        # No rule: the suffix is unknown, so there is no registrable part above it.
        return h
    return ".".join(labels[-n - 1 :]) if n < len(labels) else h


def etld1(host_or_url: Column, path: str = SUFFIX_LIST, unknown: bool = True) -> Column:
    """Registrable domain of a host or URL; NULL for NULL, empty and URLs without a host.

    With ``unknown`` a host under no listed suffix (as the reserved names of the test data) is cut to its last two labels.
    """
    host = F.when(host_or_url.contains("://"), hostname(host_or_url)).otherwise(F.nullif(F.lower(host_or_url), F.lit("")))

    def cut(hosts: pa.Array) -> pa.Array:
        rules = suffix_rules(path)
        d = hosts.dictionary_encode()  # each distinct host of a batch once
        out = []
        for h in d.dictionary.to_pylist():
            r = registrable(h, rules)
            if unknown and r is not None and rules is not None and r == h.lower().rstrip(".") and r.count(".") > 1 and not r.rsplit(".", 1)[1].isdigit() and ":" not in r and not _is_suffix(r, rules):
                r = ".".join(r.split(".")[-2:])
            out.append(r)
        return pa.DictionaryArray.from_arrays(d.indices, pa.array(out, pa.string())).cast(pa.string())

    return F.arrow_udf(cut, "string")(host)


def _is_suffix(h: str, rules) -> bool:
    """Whether a listed rule covers the host, so that its registrable part is known."""
    plain, wild, exc = rules
    labels = h.split(".")
    return any(".".join(labels[k:]) in plain or ".".join(labels[k:]) in wild for k in range(len(labels)))


def urljoin(base: Column, href: Column) -> Column:
    """A link target made absolute (RFC 3986); NULL where either is NULL or the target cannot be read."""

    def join(bases: pa.Array, hrefs: pa.Array) -> pa.Array:
        out = []
        for b, h in zip(bases.to_pylist(), hrefs.to_pylist()):
            try:
                out.append(None if b is None or h is None else _join(b, h))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(join, "string")(base, href)


def with_etld1(df: DataFrame, url_col: str, out_col: str) -> DataFrame:
    """``df`` with the registrable domain of a URL column."""
    return df.withColumn(out_col, etld1(F.col(url_col)))
