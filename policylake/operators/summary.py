"""Run summaries, explorer records and run history over site results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.functions.common import first_truthy, truthy
from policylake.functions.display import success_rate

_FILLED = r"\S"


def latest_results(results: DataFrame) -> DataFrame:
    """Each result once: of several deliveries of a ``result_id`` the one received last; rows without an id are kept."""
    w = Window.partitionBy("result_id").orderBy(F.col("ingested_at").desc_nulls_last())
    d = results.where("result_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return d.unionByName(results.where("result_id is null"))


def status_counts(results: DataFrame) -> DataFrame:
    """``status, n``; a missing status is ``unknown``."""
    return results.groupBy(first_truthy(F.col("status"), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def is_mapped(t: Column) -> Column:
    """Whether a third-party struct says anything about its organisation."""
    return (
        truthy(t["tracker_radar_source_domain_file"]) | truthy(t["entity"]) | truthy(t["policy_url"]) | truthy(t["prevalence"], "number") | truthy(t["categories"], "array")
    )


def _third_parties(results: DataFrame) -> DataFrame:
    return results.select(F.explode("third_parties").alias("t")).where("t is not null")


def third_party_totals(results: DataFrame) -> DataFrame:
    """One row: total, mapped, unmapped, no_policy_url, radar_mapped, trackerdb_mapped, mapping_unmapped."""
    t = F.col("t")
    mapped = is_mapped(t)
    radar = truthy(t["tracker_radar_source_domain_file"])
    db = ~radar & (truthy(t["trackerdb_source_pattern_file"]) | truthy(t["trackerdb_source_org_file"]))
    a = _third_parties(results).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(~mapped).alias("unmapped"), F.count_if(mapped & ~truthy(t["policy_url"])).alias("no_policy_url"),
        F.count_if(radar).alias("radar_mapped"), F.count_if(db).alias("trackerdb_mapped"),
    )
    return a.withColumn("mapping_unmapped", F.greatest(F.lit(0), F.col("total") - F.col("radar_mapped") - F.col("trackerdb_mapped")))


def category_counts(results: DataFrame) -> DataFrame:
    """``category, n`` over all third parties; a category counts as often as it is listed, as written, blank ones never."""
    return _third_parties(results).select(F.explode("t.categories").alias("category")).where(F.col("category").rlike(_FILLED)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def entity_stats(results: DataFrame) -> DataFrame:
    """``entity, n, prevalence_avg, prevalence_max``: the mean is over all occurrences, those without prevalence too; NULL where none has one."""
    d = _third_parties(results).where(F.col("t.entity").rlike(_FILLED)).select("t.entity", "t.prevalence")
    g = d.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("prevalence").alias("s"), F.max("prevalence").alias("m"))
    return g.select("entity", "n", (F.col("s") / F.col("n")).alias("prevalence_avg"), F.when(F.col("m").isNotNull(), F.greatest("m", F.lit(0.0))).alias("prevalence_max"))


def entity_categories(results: DataFrame) -> DataFrame:
    """``entity, category, n``."""
    d = _third_parties(results).where(F.col("t.entity").rlike(_FILLED)).select("t.entity", F.explode("t.categories").alias("category"))
    return d.where(F.col("category").rlike(_FILLED)).groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n"))


def top_entities(results: DataFrame, k: int = 20, categories: int = 3) -> DataFrame:
    """The ``k`` most frequent entities with their most frequent categories; ties by name."""
    top = entity_stats(results).orderBy(F.desc("n"), "entity").limit(k)
    w = Window.partitionBy("entity").orderBy(F.desc("n"), "category")
    cats = entity_categories(results).join(F.broadcast(top.select("entity")), "entity", "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= categories)
    cats = cats.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("r", "category"))).alias("c")).select("entity", F.transform("c", lambda x: x["category"]).alias("categories"))
    return top.join(cats, "entity", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def top_categories(results: DataFrame, k: int = 20) -> DataFrame:
    return category_counts(results).orderBy(F.desc("n"), "category").limit(k)


def run_summary(results: DataFrame, run_id: str, total_sites: int, mode: str | None = None) -> DataFrame:
    """The summary document of a run as one row."""
    n = results.agg(F.count(F.lit(1)).alias("processed_sites"), F.count_if(F.col("status") == "ok").alias("ok"))
    st = status_counts(results).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    tp = third_party_totals(results).select(
        F.struct("total", "mapped", "unmapped", "no_policy_url").alias("third_party"), F.struct(F.lit(mode).alias("mode"), "radar_mapped", "trackerdb_mapped", F.col("mapping_unmapped").alias("unmapped")).alias("mapping")
    )
    cats = top_categories(results).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("category").alias("name"), F.col("n").alias("count")))), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias("categories"))
    ents = top_entities(results).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("entity").alias("name"), F.col("n").alias("count"), "prevalence_avg", "prevalence_max", "categories"))),
            lambda x: F.struct(*[x[f].alias(f) for f in ("name", "count", "prevalence_avg", "prevalence_max", "categories")]),
        ).alias("entities")
    )
    d = n.crossJoin(st).crossJoin(tp).crossJoin(cats).crossJoin(ents)  # one row each
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return d.select(
        F.lit(run_id).alias("run_id"), F.lit(total_sites).cast("bigint").alias("total_sites"), "processed_sites", success_rate(F.col("ok"), F.col("processed_sites")).alias("success_rate"),
        "status_counts", "third_party", "mapping", "categories", "entities", now.alias("updated_at"),
    )


def run_state(summary: DataFrame) -> DataFrame:
    """The state document: the summary without its lists."""
    return summary.select("run_id", "mapping", "total_sites", "processed_sites", "status_counts", "third_party", "updated_at")


def explorer_records(results: DataFrame) -> DataFrame:
    """Site results as the explorer shows them: ``rank, site, status, policyUrl, extractionMethod, thirdParties``."""
    # Of several fetches of a third party the last one counts.
    f = F.filter(F.coalesce("third_party_policy_fetches", F.array()), lambda x: truthy(x["third_party_etld1"]))

    def method(t: Column) -> Column:
        own = F.filter(f, lambda x: x["third_party_etld1"] == t["third_party_etld1"])
        return first_truthy(t["policy_extraction_method"], F.try_element_at(own, F.lit(-1))["extraction_method"])

    tps = F.transform(
        F.filter(F.coalesce("third_parties", F.array()), lambda t: t.isNotNull()),
        lambda t: F.struct(
            t["third_party_etld1"].alias("name"), t["policy_url"].alias("policyUrl"), t["entity"].alias("entity"), F.coalesce(t["categories"], F.array().cast("array<string>")).alias("categories"),
            t["prevalence"].alias("prevalence"), method(t).alias("extractionMethod"),
        ),
    )
    p = F.col("first_party_policy")
    return results.select("result_id", "rank", first_truthy(F.col("site_etld1"), F.col("input")).alias("site"), "status", p["url"].alias("policyUrl"), p["extraction_method"].alias("extractionMethod"), tps.alias("thirdParties"))


def explorer_filter(records: DataFrame, status: str | None = None, min_third_parties: int = 0, query: str = "", limit: int | None = None) -> DataFrame:
    """Explorer records with a site, of one status, with enough third parties and a part of the name; all, or the first ``limit`` by rank."""
    d = records.where(truthy(F.col("site"))).where(F.size("thirdParties") >= min_third_parties)
    d = d.where(F.col("status") == status) if status else d
    d = d.where(F.lower("site").contains(query.strip().lower())) if query.strip() else d
    return d.orderBy(F.col("rank").asc_nulls_last(), "site").limit(limit) if limit else d


def reveal(records: DataFrame, progress: float, order: str = "rank") -> DataFrame:
    """The first part of the records, rounded half up. One total order: for a view of bounded size."""
    n = records.count()
    return records.orderBy(order).limit(int(n * progress + 0.5))


def consistency_pairs(records: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``site, third_party, first_words, third_words`` of sites with a policy and those of their third parties whose policy text is stored.

    ``artifacts`` has ``site, third_party`` (NULL for the site's own policy), ``content``.
    """
    from policylake.functions.common import safe_dirname, word_count

    ok = records.where((F.col("status") == "ok") & truthy(F.col("policyUrl")))
    pairs = ok.select("site", F.explode("thirdParties.name").alias("third_party"))
    texts = artifacts.where(truthy(F.col("content"))).select(F.col("site").alias("s"), F.col("third_party").alias("t"), word_count(F.col("content")).alias("w"))
    own = texts.where("t is null").select("s", F.col("w").alias("first_words"))
    third = texts.where("t is not null").select("s", "t", F.col("w").alias("third_words"))
    d = pairs.join(third, (safe_dirname(F.col("site")) == F.col("s")) & (safe_dirname(F.col("third_party")) == F.col("t"))).drop("s", "t")
    return d.join(own, safe_dirname(F.col("site")) == F.col("s"), "left").drop("s")


def run_history(summaries: DataFrame, states: DataFrame) -> DataFrame:
    """Summaries and states of run folders (``folder``, ``run_id``, ``started_at``, ``updated_at``, counts) side by side, newest first."""
    s, t = summaries.select("folder", F.struct(*summaries.columns).alias("summary")), states.select("folder", F.struct(*states.columns).alias("state"))
    d = s.join(t, "folder", "full")
    pick = {c: first_truthy(F.col(f"summary.{c}"), F.col(f"state.{c}")) for c in ("run_id", "updated_at")}
    d = d.select("folder", pick["run_id"].alias("run_id"), pick["updated_at"].alias("updated_at"), F.col("summary.started_at").alias("started_at"), "summary", "state")
    return d.orderBy(F.coalesce("updated_at", F.lit("")).desc())


def failure_count(counts: Column) -> Column:
    """Failures in a status map, exceptions not among them."""
    return sum((F.coalesce(F.try_element_at(counts, F.lit(s)), F.lit(0)) for s in ("policy_not_found", "non_browsable", "home_fetch_failed")), F.lit(0))


def run_stats(history: DataFrame) -> DataFrame:
    """Counts of each run as the run list shows them: of the summary, else of the state, else 0."""
    pick = lambda c: F.coalesce(F.col(f"summary.{c}"), F.col(f"state.{c}"), F.lit(0)).alias(c)
    return history.select("folder", "run_id", "updated_at", pick("total_sites"), pick("processed_sites"))
