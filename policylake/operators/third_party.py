"""Third parties of a site: from network events, mapped to organisations, and whose policies are fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.functions.common import first_truthy, truthy
from policylake.functions.url import etld1, hostname

KB = "etld1 string, entity string, categories array<string>, prevalence double, policy_url string"
#: A knowledge base of at most so many rows is sent to all tasks; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def network_events(df: DataFrame, requests_col: str = "network_requests") -> DataFrame:
    """A row per request or failed request with a URL; responses and events without one are left out."""
    d = df.withColumn("e", F.explode(requests_col)).drop(requests_col)
    return d.where(F.col("e.event_type").isin("request", "request_failed") & F.col("e.url").isNotNull()).select("*", F.col("e.event_type").alias("event_type"), F.col("e.url").alias("request_url")).drop("e")


def third_parties_of_site(events: DataFrame, site_col: str = "site_etld1", url_col: str = "request_url") -> DataFrame:
    """``site_col, third_party_etld1s, raw_hosts``: sorted distinct domains of others and hosts that a site contacts.

    Each distinct host is looked up in the suffix list once.
    """
    h = events.select(site_col, hostname(F.col(url_col)).alias("host")).where("host is not null").distinct()
    names = h.select("host").distinct().withColumn("e", etld1(F.col("host")))
    d = h.join(names, "host")
    other = F.when(~F.col("e").eqNullSafe(F.col(site_col)), F.col("e"))
    return d.groupBy(site_col).agg(F.array_sort(F.collect_set(other)).alias("third_party_etld1s"), F.array_sort(F.collect_set("host")).alias("raw_hosts"))


def site_third_party_pairs(events: DataFrame, site_col: str = "site_etld1", url_col: str = "request_url") -> DataFrame:
    """Distinct (site, third party) pairs."""
    h = events.select(site_col, hostname(F.col(url_col)).alias("host")).where("host is not null").distinct()
    names = h.select("host").distinct().withColumn("third_party_etld1", etld1(F.col("host")))
    return h.join(names, "host").where(f"third_party_etld1 is not null and not (third_party_etld1 <=> {site_col})").select(site_col, "third_party_etld1").distinct()


def _small(kb: DataFrame) -> DataFrame:
    """The knowledge base with a broadcast hint if it is small enough, which is counted."""
    return F.broadcast(kb) if kb.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else kb


def lookup(df: DataFrame, kb: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with the struct ``out`` of the knowledge base's row for ``key``, NULL where there is none."""
    rows = kb.select(F.col("etld1").alias("__k"), F.struct(*[c for c in kb.columns if c != "etld1"]).alias(out)).where("__k is not null").dropDuplicates(["__k"])
    return df.join(_small(rows), F.col(key) == F.col("__k"), "left").drop("__k")


def map_third_parties(df: DataFrame, radar: DataFrame | None, trackerdb: DataFrame | None, key: str = "third_party_etld1") -> DataFrame:
    """``df`` with entity, categories, prevalence, policy_url and source files of each third party.

    A row of the first base is taken whole, even where its fields are NULL; the second base counts only where the first has no row.
    """
    d = df
    none = F.lit(None)
    d = lookup(d, radar, key, "__r") if radar is not None else d.withColumn("__r", none.cast("struct<entity:string,categories:array<string>,prevalence:double,policy_url:string,source_domain_file:string>"))
    d = lookup(d, trackerdb, key, "__t") if trackerdb is not None else d.withColumn("__t", none.cast("struct<entity:string,categories:array<string>,prevalence:double,policy_url:string,source_pattern_file:string,source_org_file:string>"))
    has_r = F.col("__r").isNotNull()

    def pick(f: str) -> Column:
        return F.when(has_r, F.col(f"__r.{f}")).otherwise(F.col(f"__t.{f}"))

    fields = [pick(f).alias(f) for f in ("entity", "prevalence", "policy_url")]
    cats = F.coalesce(pick("categories"), F.array().cast("array<string>")).alias("categories")
    files = [
        F.when(has_r, F.col("__r.source_domain_file")).alias("tracker_radar_source_domain_file"),
        F.when(~has_r, F.col("__t.source_pattern_file")).alias("trackerdb_source_pattern_file"),
        F.when(~has_r, F.col("__t.source_org_file")).alias("trackerdb_source_org_file"),
    ]
    kept = [F.col(c) for c in df.columns if c not in {"entity", "prevalence", "policy_url", "categories", "tracker_radar_source_domain_file", "trackerdb_source_pattern_file", "trackerdb_source_org_file"}]
    return d.select(*kept, *fields, cats, *files)


def site_entity(sites: DataFrame, radar: DataFrame, trackerdb: DataFrame, site_col: str = "site_etld1") -> DataFrame:
    """``sites`` with ``site_entity``: the first base's entity if it names one, else the second's."""
    d = lookup(lookup(sites, radar.select("etld1", "entity"), site_col, "__r"), trackerdb.select("etld1", "entity"), site_col, "__t")
    return d.withColumn("site_entity", first_truthy(F.col("__r.entity"), F.col("__t.entity"))).drop("__r", "__t")


def drop_same_entity(df: DataFrame, site_entity_col: str = "site_entity", entity_col: str = "entity") -> DataFrame:
    """Without third parties of the site's own organisation (both named, equal as written)."""
    a, b = F.col(site_entity_col), F.col(entity_col)
    return df.where(~(truthy(a) & truthy(b) & F.coalesce(a == b, F.lit(False))))


def policies_to_fetch(df: DataFrame, site_col: str = "site_etld1", limit: int = 30) -> DataFrame:
    """The ``limit`` most prevalent third parties of each site, of which those with a policy URL; unknown prevalence last, then by name."""
    w = Window.partitionBy(site_col).orderBy(F.col("prevalence").desc_nulls_last(), "third_party_etld1")
    return df.withColumn("fetch_no", F.row_number().over(w)).where(F.col("fetch_no") <= limit).where(truthy(F.col("policy_url")))


def fetch_once(wanted: DataFrame, fetches: DataFrame, url_col: str = "policy_url") -> DataFrame:
    """Fetches joined to whoever wants them, each distinct URL fetched once."""
    urls = wanted.select(url_col).distinct()
    got = urls.join(fetches.dropDuplicates(["url"]).withColumnRenamed("url", url_col), url_col, "left")
    return wanted.join(got, url_col, "left")


def backfill_method(third_parties: DataFrame, fetches: DataFrame, key: tuple[str, ...] = ("result_id", "third_party_etld1")) -> DataFrame:
    """Third parties with ``policy_extraction_method``, taken from their fetch where it is missing."""
    f = fetches.groupBy(*key).agg(F.max("extraction_method").alias("__m"))
    return third_parties.join(f, list(key), "left").withColumn("policy_extraction_method", first_truthy(F.col("policy_extraction_method"), F.col("__m"))).drop("__m")


def final_status(policy_url: Column, non_browsable_reason: Column) -> tuple[Column, Column]:
    """(status, error_code) of a crawled site; a policy outweighs a page that cannot be browsed."""
    status = F.when(truthy(policy_url), F.lit("ok")).when(truthy(non_browsable_reason), F.lit("non_browsable")).otherwise(F.lit("policy_not_found"))
    return status, F.when(status != "ok", status)
