"""Which sites are crawled: limits, exclusion lists, website checks and membership of a list of origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.functions.html import has_html_marker
from policylake.functions.url import origin, to_http
from policylake.resources import fixed


def limit_sites(sites: DataFrame, max_sites: int | None) -> DataFrame:
    """The first sites in input order (``ord``); all for None and 0. It comes before every filter."""
    return sites.orderBy("ord").limit(max_sites) if max_sites else sites


def normalize_suffix(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"^\.+|\.+$", "")


def exclude(sites: DataFrame, site_col: str, exact: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """Sites that are neither listed (``exact.domain``) nor at or below a suffix (``suffixes.suffix``, beside the default ones).

    Suffixes are found by an equi-join on all suffixes of a site's name, not by comparing each with each.
    """
    spark = sites.sparkSession
    default = spark.createDataFrame([(s,) for s in fixed.EXCLUDED_SUFFIXES], "suffix string")
    suf = default if suffixes is None else default.union(suffixes.select("suffix"))
    suf = suf.select(normalize_suffix(F.col("suffix")).alias("suffix")).where("suffix <> ''").distinct()
    name = F.regexp_replace(F.lower(F.trim(F.col(site_col))), r"\.+$", "")
    d = sites.withColumn("__name", name)
    if exact is not None:
        d = d.join(exact.select(F.regexp_replace(F.lower(F.trim("domain")), r"\.+$", "").alias("__name")).distinct(), "__name", "left_anti")
    labels = F.split("__name", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hit = d.select("__name").distinct().select("__name", F.explode(ends).alias("suffix")).join(suf, "suffix", "left_semi").select("__name").distinct()
    # Sites without a name are kept.
    return d.join(hit, "__name", "left_anti").drop("__name")


def looks_like_website(status: Column, content_type: Column, body: Column, max_bytes: int = 65536, require_links: bool = False) -> Column:
    """Whether a stored probe is a web page: below 400, an HTML type, HTML marks in its first bytes, and links if asked for."""
    head = F.decode(F.substring(F.encode(body, "UTF-8"), 1, max_bytes), "UTF-8") if max_bytes else body
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    ok = (status < 400) & (ct.contains("text/html") | ct.contains("application/xhtml")) & has_html_marker(head)
    return F.coalesce(ok & head.rlike(r"(?i)<\s*a\b") if require_links else ok, F.lit(False))


def in_origin_list(sites: DataFrame, site_col: str, origins: DataFrame, allow_http: bool = False) -> DataFrame:
    """Sites whose origin (or, if allowed, its http form) is in ``origins.origin``; each distinct origin is looked up once."""
    d = sites.withColumn("__o", origin(F.col(site_col)))
    keys = origins.select(F.col("origin").alias("__o")).distinct()
    if allow_http:
        asked = d.select("__o").distinct().select("__o", F.explode(F.array_distinct(F.array("__o", to_http(F.col("__o"))))).alias("k"))
        keys = asked.join(keys.withColumnRenamed("__o", "k"), "k", "left_semi").select("__o").distinct()
    return d.join(keys, "__o", "left_semi").drop("__o")


def kept_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """``total, kept, kept_percent`` of a filter."""
    n = before.agg(F.count(F.lit(1)).alias("total")).crossJoin(after.agg(F.count(F.lit(1)).alias("kept")))  # one row each
    return n.withColumn("kept_percent", F.when(F.col("total") > 0, F.round(F.col("kept") * 100 / F.col("total"), 2)).otherwise(F.lit(0.0)))


def status_histogram(checks: DataFrame, status_col: str = "status") -> DataFrame:
    """Lookups by HTTP state, restricted ones (401, 403, 429) marked."""
    return checks.groupBy(F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("restricted", F.coalesce(F.col("status").isin(401, 403, 429), F.lit(False)))
