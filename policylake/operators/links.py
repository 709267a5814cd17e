"""From page to policy: candidate links, their ranking, and the choice among fetched attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policylake.functions import html, scoring, url
from policylake.resources import fixed


def link_candidates(pages: DataFrame, key: str = "page_id", html_col: str = "html", base_col: str = "url", site_col: str = "site_etld1") -> DataFrame:
    """``key, site_col, url, anchor_text, score, source, candidate_etld1, is_same_site, rank``: a page's admitted links, best first.

    A URL occurs once with its best score (the first of equals); links of one score keep the page's order.
    """
    a = pages.select(key, site_col, F.col(base_col).alias("base"), F.explode(html.anchors(F.col(html_col))).alias("a"))
    a = a.select(key, site_col, "base", F.col("a.text").alias("anchor_text"), url.clean_href(F.col("a.href")).alias("href"), F.col("a.source").alias("source"), F.col("a.ord").alias("link_no"))
    a = a.where("href is not null").withColumn("url", url.urljoin(F.col("base"), F.col("href"))).where(url.is_http(F.col("url")))
    a = a.withColumn("candidate_etld1", url.etld1(F.col("url")))
    a = a.where(scoring.admit_link(F.col(site_col), F.col("url"), F.col("candidate_etld1"), F.col("anchor_text"), F.col("source")))
    same = F.coalesce(F.col("candidate_etld1") == F.col(site_col), F.lit(False))
    a = a.withColumn("is_same_site", same).withColumn("score", scoring.link_score(F.col("anchor_text"), F.col("url"), same))
    rec = F.struct("anchor_text", "score", "source", "candidate_etld1", "is_same_site")
    best = a.groupBy(key, site_col, "url").agg(F.max_by(rec, F.struct("score", -F.col("link_no"))).alias("r"), F.min("link_no").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("r.score").desc(), "first"))
    return best.select(key, site_col, "url", "r.*", rank.alias("rank"))


def fallback_paths(sites: DataFrame, base_col: str = "url", site_col: str = "site_etld1") -> DataFrame:
    """A site's usual policy addresses as candidates, in their fixed order; one row per site and path, made in place."""
    paths = F.array(*[F.lit(p) for p in fixed.FALLBACK_PATHS])
    d = sites.select("*", F.posexplode(paths).alias("path_no", "anchor_text"))
    d = d.withColumn("candidate_url", url.urljoin(F.col(base_col), F.col("anchor_text"))).withColumn("candidate_etld1", url.etld1(F.col("candidate_url")))
    same = F.coalesce(F.col("candidate_etld1") == F.col(site_col), F.lit(False))
    return d.withColumn("is_same_site", same).withColumn("score", F.lit(2.0) + F.when(same, 0.8).otherwise(-0.8)).withColumn("source", F.lit("fallback"))


def legal_hubs(candidates: DataFrame, key: str = "page_id", limit: int = 3) -> DataFrame:
    """The first ``limit`` candidates of a page that lead to a legal page."""
    hubs = candidates.where(scoring.is_hub(F.col("anchor_text"), F.col("url")))
    return hubs.withColumn("hub_no", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where(F.col("hub_no") <= limit)


def hub_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates found on a hub page, scored a little higher."""
    return candidates.withColumn("score", F.col("score") + 0.2).withColumn("source", F.lit("hub"))


def attempts(candidates: DataFrame, fetches: DataFrame, key: str) -> DataFrame:
    """Candidates (``key, phase, ord, url``, ...) with what fetching their URL gave: length and score of the text; large columns are dropped.

    Each distinct URL is fetched once, its text is scored once and joined back.
    """
    f = fetches.dropDuplicates(["url"]).select("url", F.col("success").alias("fetch_success"), "status_code", "error_message", "text_extraction_method", F.trim("text").alias("t"))
    f = f.select("*", scoring.text_len(F.col("t")).alias("text_len"), scoring.policy_likeliness(F.col("t")).alias("likeliness_score")).drop("t")
    return candidates.join(f, "url", "left").withColumn("fetch_success", F.coalesce("fetch_success", F.lit(False)))


def choose_policy(tried: DataFrame, key: str, max_candidates: int = 10) -> DataFrame:
    """One row per ``key``: the ``chosen`` attempt, and ``tried``, the attempts up to it.

    Attempts have ``phase`` (1 ranked candidates, of which the first ``max_candidates`` count, 2 usual paths, 3 hubs), ``ord`` within it and the columns of
    ``attempts``. The first accepted one in that order is chosen; without one the best that is eligible (score, then length,
    then order). Hubs count only where the page had candidates.
    """
    d = tried.where((F.col("phase") != 1) | (F.col("ord") <= max_candidates))
    d = d.withColumn("has_candidates", F.max(F.col("phase") == 1).over(Window.partitionBy(key))).where("phase <> 3 or has_candidates")
    s, n, ok = F.col("likeliness_score"), F.col("text_len"), F.col("fetch_success")
    d = d.withColumn("accept", F.coalesce(scoring.accept_policy(ok, s, n), F.lit(False))).withColumn("eligible", F.coalesce(scoring.eligible_fallback(ok, s, n), F.lit(False)))
    order = Window.partitionBy(key).orderBy("phase", "ord")
    earlier = F.max(F.col("accept").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("seq", F.row_number().over(order)).withColumn("done", F.coalesce(earlier, F.lit(0))).where("done = 0")
    rec = F.struct("url", "phase", "ord", "fetch_success", "text_len", "likeliness_score")
    return d.groupBy(key).agg(
        F.coalesce(F.expr("min_by(struct(url, phase, ord, fetch_success, text_len, likeliness_score), seq) FILTER (WHERE accept)"), F.expr("max_by(struct(url, phase, ord, fetch_success, text_len, likeliness_score), struct(likeliness_score, text_len, -seq)) FILTER (WHERE eligible)")).alias("chosen"),
        F.array_sort(F.collect_list(F.struct("seq", rec.alias("rec")))).alias("tried"),
    ).select(key, "chosen", F.transform("tried", lambda t: t["rec"]).alias("tried"))


def discovery_document(candidates: DataFrame, chosen: DataFrame, key: str = "page_id", top: int = 25) -> DataFrame:
    """``key, candidates_top, tried, chosen``: what was found on the way to a site's policy."""
    rows = candidates.where(F.col("rank") <= top).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "url", "anchor_text", "score", "source", "candidate_etld1", "is_same_site"))).alias("candidates_top"))
    return rows.join(chosen, key, "full")


def home_attempts(fetches: DataFrame, key: str) -> DataFrame:
    """The home page among numbered attempts (``attempt``, ``mode``: browser before plain HTTP): the first success, errors joined, attempts counted.

    A success counts the failures before it and itself; a failure the failures alone.
    """
    order = F.struct("attempt", F.when(F.col("mode") == "crawl4ai", 0).otherwise(1))
    g = fetches.withColumn("o", order).withColumn("hit", F.min(F.when(F.col("success"), F.col("o"))).over(Window.partitionBy(key)))
    used = g.where(F.col("hit").isNull() | (F.col("o") <= F.col("hit")))
    return used.groupBy(key).agg(
        F.expr("min_by(mode, o) FILTER (WHERE success)").alias("home_fetch_mode"),
        F.expr("min_by(status_code, o) FILTER (WHERE success)").alias("home_status_code"),
        (F.count_if(~F.col("success")) + F.max(F.col("success").cast("int"))).alias("home_fetch_attempts"),
        F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("success") & (F.trim("error_message") != ""), F.struct("o", "error_message")))), lambda x: x["error_message"]), " | "), F.lit("")).alias("error_message"),
    )
