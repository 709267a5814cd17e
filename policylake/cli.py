"""Command line: a run over stored fetches.

Options that steer a live browser are accepted and kept with the run, but have no effect on stored pages.
"""

from __future__ import annotations

import argparse
import uuid
import warnings

from pyspark.sql import functions as F

from policylake.functions.display import mapping_mode
from policylake.operators import prefilter, summary
from policylake.pipeline import Options, site_results
from policylake.session import cut, get_spark, table
from policylake.sinks import files as sinks
from policylake.sources import files as sources
from policylake.streaming.events import emit


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="policylake", description="Site results from stored fetches.")
    a = p.add_argument
    a("--input"), a("--tranco-top", type=int, default=100), a("--tranco-date"), a("--tranco-cache-dir", help="folder of ranked CSV snapshots")
    a("--out", required=True), a("--artifacts-dir", required=True)
    a("--fetches", required=True, help="folder with fetches.parquet")
    a("--tracker-radar-index"), a("--trackerdb-index")
    for flag in ("headed", "verbose"):
        a(f"--{flag}", action="store_true")
    a("--browser", default="chromium"), a("--user-agent"), a("--proxy"), a("--locale", default="en-GB"), a("--timezone-id", default="Europe/Paris"), a("--page-timeout-ms", type=int, default=15000)
    a("--max-sites", type=int), a("--concurrency", type=int, default=3), a("--third-party-engine", choices=("crawl4ai", "openwpm"), default="crawl4ai")
    a("--no-third-party-policy-fetch", action="store_true"), a("--third-party-policy-max", type=int, default=30), a("--exclude-same-entity", action="store_true")
    a("--crux-filter", action="store_true"), a("--crux-api-key"), a("--crux-origins", help="text file of known origins"), a("--crux-timeout-ms", type=int, default=7000), a("--crux-concurrency", type=int, default=20), a("--crux-allow-http", action="store_true")
    a("--skip-home-fetch-failed", action="store_true"), a("--run-id"), a("--emit-events", action="store_true"), a("--state-file"), a("--summary-out"), a("--explorer-out")
    a("--prefilter-websites", action="store_true"), a("--prefilter-timeout-ms", type=int, default=7000), a("--prefilter-concurrency", type=int, default=50), a("--prefilter-max-bytes", type=int, default=65536)
    a("--prefilter-allow-http", action="store_true"), a("--prefilter-require-links", action="store_true"), a("--exclude-suffix", action="append", default=[]), a("--exclude-domains-file")
    return p


#: Options of a live crawl, which stored pages do not have.
LIVE = ("headed", "browser", "user_agent", "proxy", "locale", "timezone_id", "page_timeout_ms", "concurrency", "third_party_engine", "crux_api_key", "crux_timeout_ms", "crux_concurrency", "prefilter_timeout_ms", "prefilter_concurrency", "prefilter_max_bytes", "prefilter_allow_http", "prefilter_require_links")


def no_effect(args: argparse.Namespace) -> list[str]:
    """Options that were given another value than their default and change nothing here."""
    given = [f"--{n.replace('_', '-')}" for n in LIVE if getattr(args, n) != parser().get_default(n)]
    return given + (["--crux-filter (without --crux-origins)"] if args.crux_filter and not args.crux_origins else [])


def run(argv: list[str] | None = None, spark=None) -> str:
    """Run and write what was asked for; returns the run id."""
    args = parser().parse_args(argv)
    for option in no_effect(args):
        warnings.warn(f"{option} has no effect on stored pages", stacklevel=2)
    spark = spark or get_spark()
    run_id = args.run_id or str(uuid.uuid4())
    sites = sources.site_list(spark, args.input) if args.input else sources.ranked_list(spark, f"{args.tranco_cache_dir}/{args.tranco_date or '*'}.csv", args.tranco_top)
    sites = prefilter.limit_sites(sites, args.max_sites)
    if args.crux_filter and args.crux_origins:
        sites = prefilter.in_origin_list(sites, "site", spark.read.text(args.crux_origins).select(F.trim("value").alias("origin")), args.crux_allow_http)
    if args.prefilter_websites:
        exact = sources.exclusion_list(spark, args.exclude_domains_file) if args.exclude_domains_file else None
        suffixes = spark.createDataFrame([(s,) for s in args.exclude_suffix], "suffix string") if args.exclude_suffix else None
        sites = prefilter.exclude(sites, "site", exact, suffixes)
    radar = sources.kb_json(spark, args.tracker_radar_index) if args.tracker_radar_index else None
    trackerdb = sources.kb_json(spark, args.trackerdb_index, sources.TRACKERDB) if args.trackerdb_index else None
    o = Options(third_party_policy_fetch=not args.no_third_party_policy_fetch, third_party_policy_max=args.third_party_policy_max, exclude_same_entity=args.exclude_same_entity, run_id=run_id)
    results = cut(site_results(sites, table(spark, args.fetches, "fetches"), radar, trackerdb, o), "results")
    kept = sinks.skip_failed_homes(results) if args.skip_home_fetch_failed else results
    sinks.write_lines(kept.drop("ord"), args.out)
    texts = kept.where("first_party_policy is not null").select(F.lit(run_id).alias("run_id"), F.col("site_etld1").alias("site"), F.lit(None).cast("string").alias("third_party"), F.lit("policy").alias("kind"), F.to_json("first_party_policy").alias("content"))
    sinks.write_artifacts(texts, args.artifacts_dir)
    doc = cut(summary.run_summary(kept, run_id, results.count(), mapping_mode(radar is not None, trackerdb is not None)), "summary")
    if args.summary_out:
        sinks.write_document(doc, args.summary_out)
    if args.state_file:
        sinks.write_document(summary.run_state(doc), args.state_file)
    if args.explorer_out:
        sinks.write_explorer(summary.explorer_records(kept.withColumn("result_id", F.col("ord"))).drop("result_id"), args.explorer_out)
    if args.emit_events:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
        emit(results.select(F.lit("site_finished").alias("type"), F.lit(run_id).alias("run_id"), F.col("input").alias("site"), "rank", "status", now))
        emit(doc.select(F.lit("run_completed").alias("type"), F.lit(run_id).alias("run_id"), F.col("processed_sites").alias("processed"), F.col("total_sites").alias("total"), "status_counts", now))
    return run_id


if __name__ == "__main__":
    run()
