"""A crawl run as one plan: sites and stored fetches in, site results out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policylake.functions import clean, html, scoring, url
from policylake.functions.common import strip, truthy
from policylake.operators import links, third_party
from policylake.session import cut


@dataclass
class Options:
    """What a run can be told; the names are those of the command line."""

    max_candidates: int = 10
    max_hub_pages: int = 2
    third_party_policy_fetch: bool = True
    third_party_policy_max: int = 30
    exclude_same_entity: bool = False
    run_id: str | None = None


def _same_page(c):
    """A URL for looking up its fetch: without a final slash and fragment."""
    return F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/+$", "")


def site_inputs(sites: DataFrame) -> DataFrame:
    """``rank, input, site_url, site_etld1, ord``; an empty input keeps NULL URLs."""
    d = sites.select("rank", F.col("site").alias("input"), url.site_url(F.col("site")).alias("site_url"), "ord")
    return d.withColumn("site_etld1", url.etld1(F.col("site_url")))


def _candidates(home: DataFrame, fetches: DataFrame, o: Options) -> DataFrame:
    """The addresses to try for each site, in their phases."""
    pages = home.where("fetch_ok").select("ord", "site_etld1", F.col("site_url").alias("base"), F.coalesce("cleaned_html", "raw_html").alias("page"))
    c = cut(links.link_candidates(pages, "ord", "page", "base"), "candidates")
    keep = ["site", "phase", "no", "url", "anchor_text", "score", "source", "candidate_etld1", "is_same_site"]
    first = c.select(F.col("ord").alias("site"), F.lit(1).alias("phase"), F.col("rank").alias("no"), *keep[3:])
    paths = links.fallback_paths(pages.select("ord", "site_etld1", "base"), "base").select(F.col("ord").alias("site"), F.lit(2).alias("phase"), F.col("path_no").alias("no"), F.col("candidate_url").alias("url"), *keep[4:])
    hubs = links.legal_hubs(c, "ord", o.max_hub_pages).select("ord", "site_etld1", F.col("url").alias("hub"), "hub_no").withColumn("k", _same_page(F.col("hub")))
    f = fetches.where("success").select(_same_page(F.col("url")).alias("k"), F.coalesce("cleaned_html", "raw_html").alias("page")).where("page is not null").dropDuplicates(["k"])
    h = hubs.join(f, "k").withColumn("key", F.concat_ws(" ", "ord", "hub_no"))
    hc = links.hub_candidates(links.link_candidates(h, "key", "page", "hub")).where(F.col("rank") <= o.max_candidates)
    hc = hc.select(F.split_part("key", F.lit(" "), F.lit(1)).cast("bigint").alias("site"), F.lit(3).alias("phase"), (F.split_part("key", F.lit(" "), F.lit(2)).cast("int") * 1000 + F.col("rank")).alias("no"), *keep[3:])
    return first.unionByName(paths).unionByName(hc)


def site_results(sites: DataFrame, fetches: DataFrame, radar: DataFrame | None = None, trackerdb: DataFrame | None = None, options: Options | None = None) -> DataFrame:
    """A result per site (``rank, site, ord``), from stored ``fetches`` (the columns of that table).

    Sites keep their input order in ``ord``. A site without a stored home page has ``home_fetch_failed``; an empty input has
    no status. Every stored page is used once, whichever sites lead to it.
    """
    o = options or Options()
    s = site_inputs(sites)
    f = fetches.select("url", _same_page(F.col("url")).alias("k"), "success", "status_code", "raw_html", "cleaned_html", "text", "text_extraction_method", "error_message", "network_requests")
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(F.col("success").desc_nulls_last(), "url"))).where("n = 1").drop("n")
    home = s.withColumn("k", _same_page(F.col("site_url"))).join(f.withColumnRenamed("url", "final_url"), "k", "left").drop("k").withColumn("fetch_ok", F.coalesce("success", F.lit(False)))
    home = cut(home, "home")

    # The policy of each site.
    c = _candidates(home, f, o).withColumn("k", _same_page(F.col("url")))
    got = f.select("k", F.col("success").alias("fetch_success"), F.col("status_code").alias("policy_status"), F.col("text_extraction_method").alias("method"), scoring.text_len(F.col("text")).alias("text_len"), scoring.policy_likeliness(strip(F.coalesce("text", F.lit("")))).alias("likeliness_score"), F.col("text").alias("policy_text"))
    t = c.join(got, "k").select(F.col("site").alias("ord"), "phase", "no", "url", "fetch_success", "text_len", "likeliness_score")
    chosen = links.choose_policy(t.withColumnRenamed("ord", "site").withColumnRenamed("no", "ord"), "site", o.max_candidates).select(F.col("site").alias("ord"), F.col("chosen.url").alias("policy_url"))
    d = home.join(cut(chosen, "chosen"), "ord", "left")
    as_policy = F.col("fetch_ok") & F.col("policy_url").isNull() & scoring.home_is_policy(F.col("text"))
    d = d.withColumn("policy_url", F.when(as_policy, F.col("final_url")).otherwise(F.col("policy_url"))).withColumn("k", _same_page(F.col("policy_url")))
    d = cut(d.join(got.drop("fetch_success"), "k", "left").drop("k"), "policies")
    cleaned = clean.clean_policy_text(d.where("policy_url is not null").select("ord", "policy_text"), "ord", "policy_text")
    d = d.join(cut(cleaned, "cleaned"), "ord", "left")
    policy = F.when(
        F.col("policy_url").isNotNull(),
        F.struct(F.col("policy_url").alias("url"), F.col("policy_status").alias("status_code"), "likeliness_score", F.length("cleaned").cast("bigint").alias("text_len"), F.col("text_len").cast("bigint").alias("text_len_raw"), F.col("method").alias("extraction_method")),
    )
    reason = F.when(F.col("fetch_ok"), html.non_browsable(F.col("status_code"), F.col("text"), F.col("cleaned_html")))
    status, code = third_party.final_status(F.col("policy_url"), F.col("non_browsable_reason"))
    state = F.when(~truthy(strip(F.col("input"))), F.lit(None)).when(~F.col("fetch_ok"), F.lit("home_fetch_failed")).otherwise(status)
    d = d.withColumn("non_browsable_reason", reason).withColumn("first_party_policy", policy).withColumn("status", state)

    # Third parties.
    tp = third_party_records(home, f, radar, trackerdb, o)
    d = d.join(tp, "ord", "left")
    error = F.when(~truthy(strip(F.col("input"))), F.lit("empty_input")).when(~F.col("fetch_ok"), F.coalesce("error_message", F.lit("home_fetch_failed")))
    return d.select(
        "rank", "input", "site_url", "final_url", "site_etld1", "status", F.col("status_code").alias("home_status_code"), "status_code", error.alias("error_message"), "first_party_policy", "non_browsable_reason",
        F.coalesce("third_parties", F.array()).alias("third_parties"), F.coalesce("third_party_policy_fetches", F.array()).alias("third_party_policy_fetches"),
        F.when(F.col("status") == "home_fetch_failed", F.col("status")).when(F.col("status") != "ok", code).alias("error_code"), F.lit(o.run_id).cast("string").alias("run_id"), "ord",
    )


def third_party_records(home: DataFrame, f: DataFrame, radar: DataFrame | None, trackerdb: DataFrame | None, o: Options) -> DataFrame:
    """``ord, third_parties, third_party_policy_fetches`` of every site with third parties."""
    ev = third_party.network_events(home.where("fetch_ok").select("ord", "site_etld1", "network_requests"))
    hosts = ev.select("ord", "site_etld1", url.hostname(F.col("request_url")).alias("host")).where("host is not null").distinct()
    names = hosts.select("host").distinct().withColumn("third_party_etld1", url.etld1(F.col("host")))
    pairs = hosts.join(names, "host").where("third_party_etld1 is not null and not (third_party_etld1 <=> site_etld1)").select("ord", "site_etld1", "third_party_etld1").distinct()
    m = third_party.map_third_parties(pairs, radar, trackerdb)
    if o.exclude_same_entity and radar is not None and trackerdb is not None:
        own = third_party.site_entity(home.select("site_etld1").distinct(), radar, trackerdb).select("site_etld1", "site_entity")
        m = third_party.drop_same_entity(m.join(own, "site_etld1", "left")).drop("site_entity")
    m = cut(m, "third-parties")
    if o.third_party_policy_fetch:
        want = third_party.policies_to_fetch(m, "ord", o.third_party_policy_max).select("ord", "third_party_etld1", "policy_url", "fetch_no").withColumn("k", _same_page(F.col("policy_url")))
        got = want.join(f.select("k", "success", "status_code", "text_extraction_method", "error_message", "text"), "k", "left")
        texts = clean.clean_policy_text(got.select("k", "text").where("text is not null").dropDuplicates(["k"]), "k", "text")
        got = got.join(texts, "k", "left")
        fetch = F.struct(
            "third_party_etld1", "policy_url", F.coalesce("success", F.lit(False)).alias("fetch_success"), "status_code", F.length("cleaned").cast("bigint").alias("text_len"),
            F.when(F.col("text").isNotNull(), scoring.text_len(F.col("text"))).cast("bigint").alias("text_len_raw"), F.col("text_extraction_method").alias("extraction_method"), "error_message",
        )
        fetched = got.groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("fetch_no", fetch.alias("f")))), lambda x: x["f"]).alias("third_party_policy_fetches"))
        m = m.join(got.select("ord", "third_party_etld1", F.col("text_extraction_method").alias("policy_extraction_method")), ["ord", "third_party_etld1"], "left")
    else:
        fetched, m = None, m.withColumn("policy_extraction_method", F.lit(None).cast("string"))
    rec = F.struct("third_party_etld1", "entity", "categories", "prevalence", "policy_url", "tracker_radar_source_domain_file", "trackerdb_source_pattern_file", "trackerdb_source_org_file", "policy_extraction_method")
    out = m.groupBy("ord").agg(F.array_sort(F.collect_list(rec), lambda a, b: F.when(a["third_party_etld1"] < b["third_party_etld1"], -1).when(a["third_party_etld1"] > b["third_party_etld1"], 1).otherwise(0)).alias("third_parties"))
    return out.join(fetched, "ord", "left") if fetched is not None else out.withColumn("third_party_policy_fetches", F.array())
