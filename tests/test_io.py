import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from policylake import cli, pipeline
from policylake.operators import summary
from policylake.sinks import files as sinks
from policylake.sources import files as sources
from policylake.streaming import events as telemetry


def test_lists(spark, rows, tmp_path):
    (tmp_path / "s.txt").write_text("# c\n a.com \n\nb.com\r\n")
    assert rows(sources.site_list(spark, str(tmp_path / "s.txt")), "site", "rank") == [("a.com", None), ("b.com", None)]
    (tmp_path / "r.csv").write_text("1,a.com\n2,b.com\n3,c.com\n")
    ranked = sources.ranked_list(spark, str(tmp_path / "r.csv"), 2)
    assert rows(ranked, "rank", "site") == [(1, "a.com"), (2, "b.com")]
    sinks.write_ranked_text(ranked, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    assert sources.exclusion_list(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "x.txt").write_text("A.com..\n#no\n")
    assert rows(sources.exclusion_list(spark, str(tmp_path / "x.txt"))) == [("a.com",)]


def test_kb_json_and_lines(spark, rows, tmp_path):
    (tmp_path / "kb.json").write_text(json.dumps({"a.com": {"entity": "A", "categories": ["c"], "prevalence": 0.5}, "b.com": {}}))
    assert rows(sources.kb_json(spark, str(tmp_path / "kb.json")), "etld1", "entity", "prevalence") == [("a.com", "A", 0.5)]
    (tmp_path / "r.jsonl").write_text('{"rank": 1, "input": "a"}\n\nbroken\n')
    got = sources.result_lines(spark, str(tmp_path / "r.jsonl"))
    assert rows(got, "rank", "_corrupt_record") == [(1, None), (None, "broken")]


def test_sqlite(spark, rows, tmp_path):
    with sqlite3.connect(tmp_path / "crawl.sqlite") as c:
        c.execute("create table http_requests (url text)")
        c.executemany("insert into http_requests values (?)", [("https://a",), ("https://a",), ("data:x",), (None,)])
    sources.register(spark)
    assert rows(spark.read.format("sqlite_requests").load(str(tmp_path))) == [("https://a",)]
    got = spark.read.format("http_pages").option("urls", "http://127.0.0.1:9/").option("timeout_ms", 500).load().first()
    assert got["success"] is False and got["error_message"]


def test_artifacts(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run/a.txt").write_text("hello")
    assert sources.artifact_text(spark, str(tmp_path), "run/a.txt").first()["content"] == "hello"
    with pytest.raises(ValueError, match="root"):
        sources.artifact_text(spark, str(tmp_path / "run"), "../x")
    assert sources.folder_size(spark, str(tmp_path)).first()[0] == 5
    assert sinks.clear_run(str(tmp_path), ["run", "none", "../etc"]) == {"removed": ["run"], "missing": ["none"], "errors": ["../etc"]}


def test_run_folders(spark, tmp_path):
    for f, u in (("output_a", "2024-01-02T00:00:00Z"), ("output_b", "2024-01-03T00:00:00Z")):
        (tmp_path / f).mkdir()
        (tmp_path / f / "results.state.json").write_text(json.dumps({"run_id": f, "updated_at": u}))
    (tmp_path / "output_a/results.summary.json").write_text(json.dumps({"run_id": "A", "updated_at": "2024-01-04T00:00:00Z", "status_counts": {"ok": 1}}))
    h = summary.run_history(*sources.run_folders(spark, str(tmp_path))).select("folder", "run_id").collect()
    assert [tuple(r) for r in h] == [("output_a", "A"), ("output_b", "output_b")]
    stats = summary.run_stats(summary.run_history(*sources.run_folders(spark, str(tmp_path))))
    assert {tuple(r) for r in stats.select("run_id", "processed_sites").collect()} == {("A", 0), ("output_b", 0)}


def test_telemetry(spark, rows, tmp_path):
    ev = [
        {"type": "run_started", "run_id": "r", "timestamp": "2024-01-01T00:00:00Z"}, {"type": "site_stage", "run_id": "r", "site": "a", "stage": "home_fetch", "timestamp": "2024-01-01T00:00:01Z"},
        {"type": "site_finished", "run_id": "r", "site": "a", "status": "ok", "timestamp": "2024-01-01T00:00:02Z"}, {"type": "site_finished", "run_id": "r", "site": "b", "status": "", "timestamp": "2024-01-01T00:00:03Z"},
        {"type": "run_progress", "run_id": "r", "processed": 2, "total": 3, "timestamp": "2024-01-01T00:00:04Z"},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.txt").write_text("\n".join(map(json.dumps, ev)) + "\n[log] line\n")
    batch, logs = telemetry.split_lines(spark.read.text(str(tmp_path / "in")))
    assert rows(logs) == [("[log] line",)]
    want = [("r", "ok", 1), ("r", "unknown", 1)]
    assert rows(telemetry.progress(batch)) == want
    stream, _ = telemetry.split_lines(spark.readStream.text(str(tmp_path / "in")))
    assert rows(telemetry.run_to_table(telemetry.progress(stream), "complete")) == want
    s = telemetry.run_states(batch).first()
    assert (s["latest_site"], s["latest_stage"], s["processed"], s["running"]) == ("b", "home_fetch", 2, True)
    assert rows(telemetry.tail(batch, "timestamp", 1), "type") == [("run_progress",)]
    got = []
    telemetry.emit(batch.select("type").limit(1), got.append)
    assert json.loads(got[0])["type"]


TEXT = "Privacy Policy\n\nThis privacy policy explains how personal data is used. " + "We protect data and gdpr rights. " * 120


def _fetches(spark):
    rows_ = [
        ("https://a.example/", True, 200, '<p>x</p><a href="/legal">Legal</a><a href="/privacy">Privacy</a>', "x" * 300, [("request", "https://cdn.t.test/x"), ("request", "https://a.example/y")], None),
        ("https://a.example/privacy", True, 200, "<p>p</p>", TEXT, None, None),
        ("https://b.example", True, 200, "<h1>Not found</h1>", "not found", None, None),
        ("https://c.example", False, None, None, None, None, "net::ERR"),
        ("https://t.test/p", True, 200, "<p>p</p>", TEXT, None, None),
    ]
    d = spark.createDataFrame(rows_, "url string, success boolean, status_code int, cleaned_html string, text string, network_requests array<struct<event_type:string,url:string>>, error_message string")
    return d.withColumn("raw_html", F.col("cleaned_html")).withColumn("text_extraction_method", F.lit("fallback")).withColumn("fetch_id", F.monotonically_increasing_id())


def test_pipeline(spark):
    sites = spark.createDataFrame([(1, "a.example", 0), (2, "b.example", 1), (3, "c.example", 2), (4, " ", 3)], "rank int, site string, ord bigint")
    radar = spark.createDataFrame([("t.test", "T", ["ads"], 0.5, "https://t.test/p", "f")], "etld1 string, entity string, categories array<string>, prevalence double, policy_url string, source_domain_file string")
    got = {r["rank"]: r for r in pipeline.site_results(sites, _fetches(spark), radar).collect()}
    a = got[1]
    assert a["status"] == "ok" and a["error_code"] is None and a["first_party_policy"]["url"] == "https://a.example/privacy"
    assert [(t["third_party_etld1"], t["entity"]) for t in a["third_parties"]] == [("t.test", "T")]
    assert [(f["policy_url"], f["fetch_success"]) for f in a["third_party_policy_fetches"]] == [("https://t.test/p", True)]
    assert (got[2]["status"], got[2]["non_browsable_reason"]) == ("non_browsable", "error_page_text")
    assert (got[3]["status"], got[3]["error_message"]) == ("home_fetch_failed", "net::ERR")
    assert (got[4]["status"], got[4]["error_message"]) == (None, "empty_input")


def test_cli(spark, tmp_path, capsys):
    _fetches(spark).write.parquet(str(tmp_path / "fetches.parquet"))
    (tmp_path / "s.txt").write_text("a.example\nb.example\nc.example\nx.root-servers.net\n")
    t = str(tmp_path)
    run = cli.run(["--input", f"{t}/s.txt", "--out", f"{t}/out", "--artifacts-dir", f"{t}/art", "--fetches", t, "--summary-out", f"{t}/sum.json", "--state-file", f"{t}/state.json", "--explorer-out", f"{t}/e.json", "--emit-events", "--prefilter-websites", "--skip-home-fetch-failed"], spark)
    assert {r["input"] for r in spark.read.json(f"{t}/out").collect()} == {"a.example", "b.example"}
    doc = json.loads((tmp_path / "sum.json").read_text())
    assert doc["run_id"] == run and doc["status_counts"] == {"non_browsable": 1, "ok": 1} and doc["total_sites"] == 3
    assert len(json.loads((tmp_path / "e.json").read_text())) == 2
    assert '"run_completed"' in capsys.readouterr().out
