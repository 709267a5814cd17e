import json

from pyspark.sql import functions as F

from policylake.operators import kb_build, links, nested, prefilter, skew, summary, third_party
from policylake.sources import files as sources


def test_link_candidates(spark):
    pages = [
        (1, '<footer><a href="/privacy-policy">Privacy Policy</a><a href="/terms">Terms</a></footer>', "https://example.com", "example.com"),
        (2, '<footer><a href="https://policies.google.com/privacy">Privacy</a><a href="https://twitter.com/example">Twitter</a></footer>', "https://googleapis.com", "googleapis.com"),
        (3, None, "https://x.example", "x.example"), (4, "", None, None),
    ]
    c = links.link_candidates(spark.createDataFrame(pages, "page_id int, html string, url string, site_etld1 string")).collect()
    got = sorted((r["page_id"], r["rank"], r["url"], round(r["score"], 6), r["source"]) for r in c)
    assert got == [(1, 1, "https://example.com/privacy-policy", 9.8, "footer"), (1, 2, "https://example.com/terms", 0.8, "footer"), (2, 1, "https://policies.google.com/privacy", 8.2, "footer")]


def test_choose_policy(spark):
    t = [
        ("a", 1, 1, "u1", True, 250, 3.5), ("a", 1, 2, "u2", True, 900, 3.0), ("a", 2, 1, "u3", True, 900, 9.0),
        ("b", 1, 1, "u4", True, 250, 3.5), ("b", 2, 1, "u5", True, 260, 3.5), ("c", 3, 1, "u6", True, 900, 9.0), ("d", 1, 1, "u7", False, 0, -10.0),
    ]
    d = spark.createDataFrame(t, "site string, phase int, ord int, url string, fetch_success boolean, text_len int, likeliness_score double")
    got = {r["site"]: (r["chosen"] and r["chosen"]["url"], len(r["tried"])) for r in links.choose_policy(d, "site").collect()}
    assert got == {"a": ("u2", 2), "b": ("u5", 2), "d": (None, 1)}


def test_home_attempts(spark):
    d = spark.createDataFrame(
        [("a", 1, "crawl4ai", False, None, "x"), ("a", 1, "simple_http", False, None, "y"), ("a", 2, "crawl4ai", True, 200, None), ("b", 1, "crawl4ai", False, None, "z")],
        "site string, attempt int, mode string, success boolean, status_code int, error_message string",
    )
    got = {r["site"]: tuple(r)[1:] for r in links.home_attempts(d, "site").collect()}
    assert got == {"a": ("crawl4ai", 200, 3, "x | y"), "b": (None, None, 1, "z")}


def test_prefilter(spark, rows):
    s = spark.createDataFrame([("A.com.",), ("x.a.com",), ("ok.org",), ("evil-root-servers.net",), ("m.root-servers.net",), (None,), ("",)], "site string")
    got = prefilter.exclude(s, "site", spark.createDataFrame([("ok.org",)], "domain string"), spark.createDataFrame([(".A.com",)], "suffix string"))
    assert rows(got) == [("",), ("evil-root-servers.net",), (None,)] or rows(got) == sorted([("",), ("evil-root-servers.net",), (None,)], key=repr)
    o = spark.createDataFrame([("http://a.com.",), ("https://ok.org",)], "origin string")
    assert rows(prefilter.in_origin_list(s, "site", o, allow_http=True)) == [("A.com.",), ("ok.org",)]
    lim = spark.createDataFrame([("b", 1), ("a", 0)], "site string, ord int")
    assert rows(prefilter.limit_sites(lim, 1), "site") == [("a",)]
    assert prefilter.limit_sites(lim, 0).count() == 2


def test_third_parties(spark, rows):
    ev = [("e.com", [("request", "https://CDN.t.com/a"), ("response", "https://no.com"), ("request_failed", "https://e.com/x"), ("request", None), ("request", "https://127.0.0.1/"), ("request", "data:x")])]
    d = spark.createDataFrame(ev, "site_etld1 string, network_requests array<struct<event_type:string,url:string>>")
    got = third_party.third_parties_of_site(third_party.network_events(d)).first()
    assert (got[1], got[2]) == (["127.0.0.1", "t.com"], ["127.0.0.1", "cdn.t.com", "e.com"])


def test_mapping_whole_rows(spark):
    kb = "etld1 string, entity string, categories array<string>, prevalence double, policy_url string"
    radar = spark.createDataFrame([("a", None, None, None, None), ("b", "B", ["c"], 0.5, "http://b")], kb + ", source_domain_file string" if False else kb).withColumn("source_domain_file", F.lit("f"))
    tdb = spark.createDataFrame([("a", "X", ["x"], None, "http://x"), ("c", "C", [], None, None)], kb).withColumn("source_pattern_file", F.lit("p")).withColumn("source_org_file", F.lit("o"))
    t = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old"), ("d", "old")], "third_party_etld1 string, entity string")
    got = {r["third_party_etld1"]: (r["entity"], r["policy_url"], r["tracker_radar_source_domain_file"], r["trackerdb_source_pattern_file"]) for r in third_party.map_third_parties(t, radar, tdb).collect()}
    assert got == {"a": (None, None, "f", None), "b": ("B", "http://b", "f", None), "c": ("C", None, None, "p"), "d": (None, None, None, None)}
    own = third_party.site_entity(t.select(F.col("third_party_etld1").alias("site_etld1")), radar, tdb)
    assert {r[0]: r[1] for r in own.collect()} == {"a": "X", "b": "B", "c": "C", "d": None}


def test_policies_to_fetch(spark, rows):
    d = spark.createDataFrame([("s", "b", None, "u"), ("s", "a", 0.1, None), ("s", "c", 0.1, "u")], "site_etld1 string, third_party_etld1 string, prevalence double, policy_url string")
    assert rows(third_party.policies_to_fetch(d, limit=2), "third_party_etld1") == [("c",)]


def test_entity_stats(spark):
    t = "array<struct<third_party_etld1:string,entity:string,categories:array<string>,prevalence:double,policy_url:string,tracker_radar_source_domain_file:string,trackerdb_source_pattern_file:string,trackerdb_source_org_file:string,policy_extraction_method:string>>"
    tp = lambda e, p, c: ("t", e, c, p, None, None, None, None, None)
    r = spark.createDataFrame([("ok", [tp("E", 0.2, ["x", "x"]), tp("E", None, [" "]), tp(" ", 1.0, None), None]), (None, None), ("", [])], f"status string, third_parties {t}")
    assert tuple(summary.entity_stats(r).first()) == ("E", 2, 0.1, 0.2)
    assert {tuple(x) for x in summary.category_counts(r).collect()} == {("x", 2)}
    assert {tuple(x) for x in summary.status_counts(r).collect()} == {("ok", 1), ("unknown", 2)}
    assert summary.third_party_totals(r).first()["total"] == 3


def test_kb_builders(spark, tmp_path):
    (tmp_path / "entities").mkdir(), (tmp_path / "domains/US").mkdir(parents=True)
    (tmp_path / "entities/E.json").write_text(json.dumps({"name": "E", "properties": {"privacy_policy": "https://e/p"}}))
    (tmp_path / "domains/US/a.com.json").write_text(json.dumps({"domain": "A.com", "owner": {"name": "E"}, "categories": "Ads", "prevalence": {"total": 0.5}}))
    (tmp_path / "domains/b.com.json").write_text(json.dumps({"owner": "x", "entity": "F", "categories": ["c", 1], "prevalence": "0.5", "policy": "ftp://x"}))
    (tmp_path / "domains/bad.json").write_text("{")
    got = kb_build.radar_index(sources.json_tree(spark, str(tmp_path / "entities")), sources.json_tree(spark, str(tmp_path / "domains")))
    assert {tuple(map(str, r)) for r in got.collect()} == {("a.com", "E", "['Ads']", "0.5", "https://e/p", "US/a.com.json"), ("b.com", "F", "['c']", "None", "None", "b.com.json")}

    def eno(rows):
        return spark.createDataFrame(rows, "path string, text string")

    p = "name: P\ncategory: ads\norganization: org\nurl: a:b\n\n--- domains\n*.x.example.co.uk\nT.com\n--- domains\nname: P2\n--- other\nz\n"
    got = kb_build.trackerdb_index(eno([("c/ads.eno", "name: Advertising")]), eno([("o/org.eno", "name: Org\nprivacy_policy_url: https://o")]), eno([("p/a.eno", p), ("p/b.eno", "--- domains\nt.com\n")]))
    rows_ = {r["etld1"]: (r["entity"], r["categories"], r["policy_url"], r["source_pattern_file"], r["source_org_file"]) for r in got.collect()}
    assert rows_ == {"example.co.uk": ("Org", ["Advertising"], "https://o", "p/a.eno", "o/org.eno"), "t.com": ("Org", ["Advertising"], "https://o", "p/a.eno", "o/org.eno")}
    e = eno([("x", p)]).select(kb_build.parse_eno(F.col("text")).alias("e")).first()["e"]
    assert e["data"] == {"name": "P2", "category": "ads", "organization": "org", "url": "a:b"} and e["sections"] == {"domains": ["*.x.example.co.uk", "T.com"], "other": ["z"]}


NESTED = [
    (1, '{"input":"a","third_parties":[{"third_party_etld1":"x.com","categories":["c","d"]},null,{"entity":"none"},"y.com"],"first_party_policy":{"url":"u"}}'),
    (2, '[{"third_parties":"[{\\"third_party_etld1\\": \\"q.com\\"}]"}, 5, {"site":"s","policyUrl":"p","thirdParties":[{"name":"n"}]}]'),
    (3, '{"type":"site_finished","result":{"input":"a","third_parties":{"k.com":{"entity":null},"l.com":{"third_party_etld1":"L.com"}},"first_party_policy":"{\\"url\\": \\"w\\"}"}}'),
    (4, '{"third_parties":{"third_party_etld1":"single.com"},"third_party_policy_fetches":[{"third_party_etld1":"f.com","status_code":"x"}],"first_party_policy":{}}'),
    (5, '{"third_parties":[{"third_party_etld1":"cut.com"}'), (6, "crawl resumed"), (7, None), (8, ""), (9, "7"), (1, '{"third_parties":[{"third_party_etld1":"x.com"}]}'),
]


def test_nested(spark, rows):
    d = spark.createDataFrame([(*x, "clash") for x in NESTED], "line_id bigint, line string, recs string")
    assert rows(nested.p2_found(d)) == sorted(
        [
            (1, 0, "third_party", "x.com"), (1, 0, "third_party", "y.com"), (1, 0, "first_party_policy", "u"), (2, 0, "third_party", "q.com"), (2, 2, "third_party", "n"), (2, 2, "first_party_policy", "p"),
            (3, 0, "third_party", "k.com"), (3, 0, "third_party", "L.com"), (3, 0, "first_party_policy", "w"), (4, 0, "third_party", "single.com"), (4, 0, "policy_fetch", "f.com"),
        ],
        key=repr,
    )
    t = nested.flat_tables(d)
    assert rows(t["category"], "line_id", "child_no", "category") == [(1, 0, "c"), (1, 0, "d")]
    assert nested.p2_found(d.limit(0)).count() == 0


def test_rejected_lines(spark, rows):
    n = nested.LONGEST_STRING
    d = spark.sql(
        f"""SELECT * FROM VALUES (1, '{{"site_url": "u"}}'), (2, '{{"a": 1'), (3, NULL), (4, '  '), (5, '[1, 2]') AS t(line_id, line)
        UNION ALL SELECT 6, concat('{{"site_url":"u","x":"', repeat('y', {n + 1}), '"}}') UNION ALL SELECT 7, concat('{{"site_url":"u","x":"', repeat('y', {n - 1}), '"}}')"""
    )
    read = {r["line_id"] for r in nested.records(d).where("size(recs) > 0").collect()}
    assert read == {1, 7}
    assert rows(nested.rejected_lines(d), "line_id", "reason") == [(2, "not_json"), (3, "empty"), (4, "empty"), (5, "no_record"), (6, "string_too_long")]


def test_skew(spark, rows):
    data = [("hot", i % 700, f"s{i % 5}") for i in range(1400)] + [(f"k{i}", i, "s") for i in range(30)] + [(None, 9999, "s"), ("", 9998, None), ("k1", None, "s")]
    d = spark.createDataFrame(data, "key string, id bigint, site string").withColumn("n_rows", F.lit("clash"))
    got = {r["key_value"]: (r["n_rows"], r["n_ids"], r["n_sites"], r["heavy"]) for r in skew.per_key_results(d, "key", "id", heavy_share=0.1, site_col="site").collect()}
    assert got["hot"] == (1400, 700, 5, True) and got["k1"] == (2, 1, 1, False) and got["k2"] == (1, 1, 1, False) and None not in got and len(got) == 32
    assert skew.per_key_results(d.limit(0), "key", "id").count() == 0
    tp = spark.createDataFrame([(i, "T.com." if i % 2 else "t.com ", None) for i in range(60)] + [(i, f"d{i}", "E") for i in range(60, 100)] + [(1, "T.com.", None)], "obs_id bigint, third_party_etld1 string, entity string")
    assert rows(skew.p6_found(tp, 0.3)) == [("entity", "e"), ("third_party_etld1", "t.com")]
