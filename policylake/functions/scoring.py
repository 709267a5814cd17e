"""Scores and admission tests of links and policy texts, built from the fixed word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from policylake.functions.common import contains_any, norm_space, strip, truthy, word_count
from policylake.resources import fixed


def has_privacy_keyword(text: Column) -> Column:
    return contains_any(F.lower(norm_space(text)), fixed.PRIVACY_KEYWORDS)


def url_privacy_signal(url: Column) -> Column:
    return contains_any(F.lower(url), fixed.SIGNAL_URL_WORDS)


def link_score(anchor: Column, url: Column, same_site: Column) -> Column:
    """Additive score of a link; the terms are summed in a fixed order."""
    t, u = F.lower(norm_space(F.coalesce(anchor, F.lit("")))), F.lower(url)

    def add(test: Column, points: float) -> Column:
        return F.when(test, F.lit(points)).otherwise(F.lit(0.0))

    return (
        add(contains_any(u, fixed.SCORE_URL_WORDS), 5.0)
        + add(contains_any(u, ("cookie",)), -1.0)
        + add(contains_any(t, fixed.PRIVACY_KEYWORDS), 4.0)
        + add(contains_any(t, fixed.COOKIE_KEYWORDS), -0.5)
        + add(contains_any(u, fixed.PENALTY_URL_WORDS), -2.0)
        + F.when(same_site, F.lit(0.8)).otherwise(F.lit(-0.8))
    )


def admit_link(site_etld1: Column, url: Column, url_etld1: Column, anchor: Column, source: Column) -> Column:
    """Whether a link may lead to the site's policy: its own site, a policy hoster, the site's name in the URL, or enough privacy words.

    Links from footers, hubs and fallbacks need the words in the anchor or in the URL, links from the body in both.
    """
    label = F.lower(F.split_part(F.coalesce(site_etld1, F.lit("")), F.lit("."), F.lit(1)))
    named = (label != "") & F.lower(url).contains(label)
    a, u = has_privacy_keyword(anchor), url_privacy_signal(url)
    words = F.when(source.isin("footer", "hub", "fallback"), a | u).otherwise(a & u)
    return truthy(url_etld1) & (F.coalesce(url_etld1 == site_etld1, F.lit(False)) | url_etld1.isin(*fixed.POLICY_HOSTERS) | F.coalesce(named, F.lit(False)) | words)


def is_hub(anchor: Column, url: Column) -> Column:
    """Whether a link leads to a legal page that may link to the policy."""
    return contains_any(F.lower(anchor), fixed.LEGAL_HUB_KEYWORDS) | contains_any(F.lower(url), fixed.LEGAL_HUB_URL_WORDS)


def term_hits(text: Column) -> Column:
    """How many of the policy terms a text holds."""
    t = F.lower(text)
    return sum((F.coalesce(t.contains(w), F.lit(False)).cast("int") for w in fixed.POLICY_TERMS), F.lit(0))


def policy_likeliness(text: Column) -> Column:
    """Length and terms of a policy text as a score; -10 for NULL and empty."""
    t = F.lower(text)
    length = F.least(word_count(text) / F.lit(400.0), F.lit(6.0))
    terms = F.least(term_hits(text), F.lit(6)) * F.lit(1.2)
    cookie_only = F.coalesce(t.contains("cookie"), F.lit(False)) & ~contains_any(t, fixed.NOT_COOKIE_ONLY)
    return F.when(truthy(text), length + terms - F.when(cookie_only, F.lit(1.5)).otherwise(F.lit(0.0))).otherwise(F.lit(-10.0))


def accept_policy(success: Column, score: Column, text_len: Column) -> Column:
    """Whether an attempt is the policy: the higher the score, the shorter it may be."""
    s = F.when(truthy(score, "number"), score).otherwise(F.lit(-10.0))
    return truthy(success, "boolean") & (((s >= 5) & (text_len >= 300)) | ((s >= 4) & (text_len >= 500)) | ((s >= 3) & (text_len >= 800)))


def eligible_fallback(success: Column, score: Column, text_len: Column) -> Column:
    """Whether an attempt may be taken when none is accepted."""
    s = F.when(truthy(score, "number"), score).otherwise(F.lit(-10.0))
    return truthy(success, "boolean") & (s >= 3) & (text_len >= 200)


def home_is_policy(text: Column) -> Column:
    """Whether a home page itself can stand for the policy."""
    return truthy(text) & (policy_likeliness(text) >= 3.0) & (F.length(strip(text)) >= 300)


def text_len(text: Column) -> Column:
    """Characters of the trimmed text; 0 for NULL."""
    return F.length(strip(F.coalesce(text, F.lit(""))))
