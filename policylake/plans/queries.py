"""Queries of the core: name -> function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policylake.functions import clean, display, html, scoring, url
from policylake.functions.common import word_count
from policylake.operators import kb_build, links, nested, prefilter, skew, summary, third_party
from policylake.resources import fixed
from policylake.session import table
from policylake.streaming import events as telemetry

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


# Pieces of SQL.
HOST = r"nullif(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1)), '')"
ETLD1 = r"regexp_extract({0}, '([^.]+\.)?[^.]+$')"


def _any(col: str, words) -> str:
    """SQL: whether a text holds one of the words."""
    return "(" + " OR ".join(f"contains({col}, '{w.replace(chr(39), chr(39) * 2)}')" for w in dict.fromkeys(words)) + ")"


def _words(col: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(coalesce({col}, ''), '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+'), lambda x: x <> ''))"


_LIKE = f"""CASE WHEN text IS NULL OR text = '' THEN -10.0 ELSE least({_words("text")} / 400.0, 6.0)
 + least({" + ".join(f"contains(lower(text), '{t}')::INT" for t in fixed.POLICY_TERMS)}, 6) * 1.2
 - CASE WHEN contains(lower(text), 'cookie') AND NOT {_any("lower(text)", fixed.NOT_COOKIE_ONLY)} THEN 1.5 ELSE 0.0 END END"""
LATEST = "(SELECT * FROM results WHERE result_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
TP = f"(SELECT result_id, site_etld1, t.u AS t FROM {LATEST} AS r, (SELECT unnest(r.third_parties)) AS t(u) WHERE t.u IS NOT NULL)"


# --- problems 2 and 6 -------------------------------------------------------------------------------------------


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The children of every readable record of the nested result lines."""
    return nested.p2_found(table(spark, d, "outputsresults"))


@query(
    r"""WITH d AS (SELECT obs_id, nullif(regexp_replace(lower(trim(third_party_etld1)), '\.+$', ''), '') AS k, nullif(lower(trim(entity)), '') AS e FROM third_parties),
n AS (SELECT count(DISTINCT obs_id) AS n FROM d)
SELECT 'third_party_etld1' AS field, k AS key_value FROM d, n WHERE k IS NOT NULL GROUP BY k, n HAVING count(DISTINCT obs_id) >= 0.02 * n
UNION ALL SELECT 'entity', e FROM d, n WHERE e IS NOT NULL GROUP BY e, n HAVING count(DISTINCT obs_id) >= 0.02 * n"""
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Third-party domains and entities that hold 2% or more of all observations."""
    return skew.p6_found(table(spark, d, "third_parties"))


_KEY = r"""SELECT '{0}' AS field, {1} AS key_value, count(*)::BIGINT AS n_rows, count(DISTINCT obs_id)::BIGINT AS n_ids,
 count(DISTINCT nullif(regexp_replace(lower(trim(site_etld1)), '\.+$', ''), ''))::BIGINT AS n_sites, min(observed_at) AS first_at, max(observed_at) AS last_at
FROM third_parties WHERE {1} IS NOT NULL GROUP BY {1}"""


@query(_KEY.format("third_party_etld1", r"nullif(regexp_replace(lower(trim(third_party_etld1)), '\.+$', ''), '')") + " UNION ALL " + _KEY.format("entity", "nullif(lower(trim(entity)), '')"))
def p6_key_results(spark: SparkSession, d: str) -> DataFrame:
    """Results per third-party domain and entity, heavy keys in slices."""
    return skew.third_party_key_results(table(spark, d, "third_parties")).drop("heavy")


@query()
def p2_third_parties(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of third parties of the nested result lines."""
    return nested.flat_tables(table(spark, d, "outputsresults"))["third_party"]


@query()
def p2_categories(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of categories, linked to third party, record and line."""
    return nested.flat_tables(table(spark, d, "outputsresults"))["category"]


# --- URLs and sites -----------------------------------------------------------------------------------------------


@query(f"SELECT fetch_id, {HOST.format('url')} AS host FROM fetches")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetches").select("fetch_id", url.hostname(F.col("url")).alias("host"))


@query(
    f"SELECT DISTINCT input, CASE WHEN {HOST.format('u')} IS NOT NULL THEN lower(regexp_extract(u, '^([^:]*):', 1)) || '://' || {HOST.format('u')} END AS origin "
    "FROM (SELECT input, CASE WHEN contains(trim(input), '://') THEN trim(input) ELSE 'https://' || trim(input) END AS u FROM results)"
)
def url_origin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").select("input", url.origin(F.col("input")).alias("origin")).distinct()


@query(f"SELECT DISTINCT policy_url, {ETLD1.format(HOST.format('policy_url'))} AS etld1 FROM third_parties WHERE policy_url IS NOT NULL")
def url_etld1(spark: SparkSession, d: str) -> DataFrame:
    """Registrable domains; the test data's reserved suffixes are on no list, so the last two labels count."""
    return table(spark, d, "third_parties").select("policy_url").where("policy_url is not null").distinct().select("policy_url", url.etld1(F.col("policy_url")).alias("etld1"))


@query(r"SELECT DISTINCT regexp_replace(coalesce(third_party_etld1, ''), '[^\p{L}\p{N}_.\-]', '_', 'g') AS dirname FROM third_parties")
def safe_dirnames(spark: SparkSession, d: str) -> DataFrame:
    from policylake.functions.common import safe_dirname

    return table(spark, d, "third_parties").select(safe_dirname(F.coalesce("third_party_etld1", F.lit(""))).alias("dirname")).distinct()


@query(
    r"""SELECT result_id, ingested_at, input FROM results WHERE input IS NULL OR NOT (list_contains(['glakamishop.example', 'zinisebank5.invalid'], regexp_replace(lower(trim(input)), '\.+$', ''))
 OR regexp_matches(regexp_replace(lower(trim(input)), '\.+$', ''), '(^|\.)(test|gtld-servers\.net|root-servers\.net|iana-servers\.net)$'))"""
)
def site_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Results whose input is neither on an exact list nor at or below an excluded suffix."""
    exact = spark.createDataFrame([("glakamishop.example",), ("zinisebank5.invalid.",)], "domain string")
    suffixes = spark.createDataFrame([(".test",)], "suffix string")
    return prefilter.exclude(table(spark, d, "results").select("result_id", "ingested_at", "input"), "input", exact, suffixes)


@query(
    f"SELECT DISTINCT r.site_url FROM results AS r WHERE regexp_extract(r.site_url, '^([^:]*)://', 1) || '://' || {HOST.format('r.site_url')} IN (SELECT 'https://' || {HOST.format('url')} FROM fetches WHERE success)"
    f" OR 'http://' || {HOST.format('r.site_url')} IN (SELECT 'https://' || {HOST.format('url')} FROM fetches WHERE success)"
)
def origin_semi(spark: SparkSession, d: str) -> DataFrame:
    """Sites whose origin (or its http form) is among the origins that were fetched."""
    origins = table(spark, d, "fetches").where("success").select(F.concat(F.lit("https://"), url.hostname(F.col("url"))).alias("origin"))
    return prefilter.in_origin_list(table(spark, d, "results").select("site_url").distinct(), "site_url", origins, allow_http=True)


@query(r"""SELECT fetch_id, coalesce(status_code < 400 AND regexp_matches(raw_html, '<\s*!doctype\s+html|<\s*html\b|<\s*head\b|<\s*body\b', 'is'), false) AS website FROM fetches""")
def website_check(spark: SparkSession, d: str) -> DataFrame:
    """Which stored responses are web pages (the tables keep no content type; all of these were HTML)."""
    return table(spark, d, "fetches").select("fetch_id", prefilter.looks_like_website(F.col("status_code"), F.lit("text/html"), F.col("raw_html"), max_bytes=0).alias("website"))


@query("SELECT status_code AS status, count(*)::BIGINT AS n, coalesce(status_code IN (401, 403, 429), false) AS restricted FROM fetches GROUP BY status_code")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return prefilter.status_histogram(table(spark, d, "fetches"), "status_code")


# --- links and policies ---------------------------------------------------------------------------------------------

_SCORE = f"""CASE WHEN {_any("lower(u)", fixed.SCORE_URL_WORDS)} THEN 5.0 ELSE 0.0 END + CASE WHEN contains(lower(u), 'cookie') THEN -1.0 ELSE 0.0 END
 + CASE WHEN {_any("lower(a)", fixed.PRIVACY_KEYWORDS)} THEN 4.0 ELSE 0.0 END + CASE WHEN {_any("lower(a)", fixed.COOKIE_KEYWORDS)} THEN -0.5 ELSE 0.0 END
 + CASE WHEN {_any("lower(u)", fixed.PENALTY_URL_WORDS)} THEN -2.0 ELSE 0.0 END + 0.8"""


@query(
    f"""WITH a AS (SELECT fetch_id, url, unnest(regexp_extract_all(cleaned_html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(cleaned_html, '<a href="[^"]*">([^<]*)</a>', 1)) AS a,
 generate_subscripts(regexp_extract_all(cleaned_html, '<a href="([^"]*)">', 1), 1) AS o FROM fetches WHERE cleaned_html IS NOT NULL),
b AS (SELECT fetch_id, o, a, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^[^:]*://[^/]*') ELSE regexp_replace(url, '[^/]*$', '') END || href AS u FROM a WHERE href <> '' AND NOT starts_with(href, '#')),
c AS (SELECT fetch_id, u, max({_SCORE}) AS score, min(o) AS o FROM b GROUP BY fetch_id, u)
SELECT fetch_id, u AS url, round(score::DOUBLE, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY fetch_id ORDER BY score DESC, o) = 1"""
)
def link_best(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate link of each fetched page; all links of the test pages stay on their site."""
    f = table(spark, d, "fetches").where("cleaned_html is not null").withColumn("site", url.etld1(F.col("url")))
    return links.link_candidates(f, "fetch_id", "cleaned_html", "url", "site").where("rank = 1").select("fetch_id", "url", F.round("score", 6).alias("score"))


@query()
def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetches").where("cleaned_html is not null").withColumn("site", url.etld1(F.col("url")))
    return links.link_candidates(f, "fetch_id", "cleaned_html", "url", "site")


@query()
def legal_hubs(spark: SparkSession, d: str) -> DataFrame:
    """The first two links of each page to a legal page."""
    return links.legal_hubs(link_candidates(spark, d), "fetch_id", 2)


@query(
    f"SELECT DISTINCT site_etld1, p.p AS path, regexp_extract(site_url, '^[^:]*://[^/]*') || p.p AS candidate_url, CASE WHEN {ETLD1.format(HOST.format('site_url'))} = site_etld1 THEN 2.8 ELSE 1.2 END::DOUBLE AS score "
    f"FROM results, (SELECT unnest([{', '.join(repr(p) for p in fixed.FALLBACK_PATHS)}])) AS p(p) WHERE site_url IS NOT NULL"
)
def fallback_paths(spark: SparkSession, d: str) -> DataFrame:
    """The usual policy addresses of every site."""
    sites = table(spark, d, "results").select("site_url", "site_etld1").where("site_url is not null").distinct()
    return links.fallback_paths(sites, "site_url").select("site_etld1", F.col("anchor_text").alias("path"), "candidate_url", F.round("score", 1).alias("score")).distinct()


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of every page, a line for each text node."""
    return table(spark, d, "fetches").where("cleaned_html is not null").select("fetch_id", html.html_to_text(F.col("cleaned_html")).alias("text"))


@query()
def main_text(spark: SparkSession, d: str) -> DataFrame:
    """Main text of every page and the method that found it."""
    return table(spark, d, "fetches").where("raw_html is not null").select("fetch_id", html.main_text(F.col("raw_html"), F.col("url")).alias("m")).select("fetch_id", "m.text", "m.method")


@query(
    r"""WITH x AS (SELECT fetch_id, status_code, lower(trim(coalesce(text, ''), chr(10) || ' ')) AS t, len(regexp_extract_all(coalesce(cleaned_html, ''), '<a\s[^>]*?href\s*=')) AS a FROM fetches WHERE coalesce(text, '') <> '' OR coalesce(cleaned_html, '') = '')
SELECT fetch_id, CASE WHEN status_code >= 400 THEN 'http_status_' || status_code WHEN regexp_matches(t, '{0}') THEN 'error_page_text' WHEN length(t) < 200 AND a = 0 THEN 'no_links_short_text'
 WHEN length(t) < 80 AND a <= 1 THEN 'very_sparse_page' END AS reason FROM x""".replace("{0}", "|".join(f"(?:{p})" for p in fixed.ERROR_PAGE_PATTERNS))
)
def non_browsable(spark: SparkSession, d: str) -> DataFrame:
    """Why fetched pages cannot be browsed, of pages with text or without markup."""
    f = table(spark, d, "fetches").where("coalesce(text, '') <> '' or coalesce(cleaned_html, '') = ''")
    return f.select("fetch_id", html.non_browsable(F.col("status_code"), F.col("text"), F.col("cleaned_html")).alias("reason"))


@query(f"SELECT doc_id, round(({_LIKE})::DOUBLE, 6) AS score FROM documents")
def policy_likeliness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(scoring.policy_likeliness(F.col("text")), 6).alias("score"))


@query(f"SELECT doc_id, {_words('text')}::INT AS words, {' + '.join(f'coalesce(contains(lower(text), {t!r}), false)::INT' for t in fixed.POLICY_TERMS)} AS hits FROM documents")
def word_and_term_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", word_count(t).alias("words"), scoring.term_hits(t).alias("hits"))


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(lower(text), 'data')) - 1 END::INT AS n FROM documents")
def term_match_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", display.match_count(F.col("text"), F.lit(" Data ")).alias("n"))


def _tried(spark: SparkSession, d: str) -> DataFrame:
    """Fetches as the attempts of their site, in order of their id."""
    f = table(spark, d, "fetches").where("site_etld1 is not null")
    o = F.row_number().over(Window.partitionBy("site_etld1").orderBy("fetch_id"))
    f = f.select("site_etld1", "fetch_id", "url", F.coalesce("success", F.lit(False)).alias("fetch_success"), scoring.text_len(F.col("text")).alias("text_len"), scoring.policy_likeliness(F.trim("text")).alias("likeliness_score"), o.alias("o"))
    return f.withColumn("phase", F.when(F.col("o") <= 10, 1).otherwise(2)).withColumn("ord", F.col("o")).withColumn("url", F.concat_ws(" ", F.col("fetch_id").cast("string"), "url"))


_OK = "(s >= 5 AND n >= 300 OR s >= 4 AND n >= 500 OR s >= 3 AND n >= 800)"


@query(
    rf"""WITH x AS (SELECT site_etld1, fetch_id || ' ' || url AS url, coalesce(success, false) AS ok, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS n, {_LIKE} AS s,
 row_number() OVER (PARTITION BY site_etld1 ORDER BY fetch_id) AS o FROM fetches WHERE site_etld1 IS NOT NULL),
y AS (SELECT *, ok AND {_OK} AS acc FROM x), z AS (SELECT site_etld1, min(o) FILTER (WHERE acc) AS hit FROM y GROUP BY site_etld1)
SELECT y.site_etld1, CASE WHEN hit IS NOT NULL THEN arg_min(url, o) FILTER (WHERE acc) ELSE arg_max(url, (s, n, -o)) FILTER (WHERE ok AND s >= 3 AND n >= 200) END AS url,
 count(*) FILTER (WHERE o <= coalesce(hit, 1000000000))::INT AS n_tried FROM y JOIN z ON y.site_etld1 = z.site_etld1 GROUP BY y.site_etld1, hit"""
)
def policy_select(spark: SparkSession, d: str) -> DataFrame:
    """The policy chosen for each site among its fetches, and how many were tried."""
    return links.choose_policy(_tried(spark, d), "site_etld1").select("site_etld1", F.col("chosen.url").alias("url"), F.size("tried").alias("n_tried"))


@query()
def clean_policy_text(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned text of every fetch."""
    return clean.clean_policy_text(table(spark, d, "fetches").select("fetch_id", "text"), "fetch_id", "text")


@query(
    r"""WITH x AS (SELECT doc_id, lower(regexp_replace(regexp_replace(unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')), '^[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+|[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+$', '', 'g'),
 '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')) AS line FROM documents) SELECT doc_id, line, count(*)::BIGINT AS n FROM x WHERE line <> '' GROUP BY doc_id, line"""
)
def line_frequency(spark: SparkSession, d: str) -> DataFrame:
    return clean.line_frequency(table(spark, d, "documents"), "doc_id", "text")


# --- third parties and knowledge bases ------------------------------------------------------------------------------

_EVENTS = "(SELECT site_etld1, r.u.event_type AS e, r.u.url AS u FROM fetches AS f, (SELECT unnest(f.network_requests)) AS r(u))"


@query(
    f"SELECT DISTINCT site_etld1, {ETLD1.format('h')} AS third_party_etld1 FROM (SELECT site_etld1, {HOST.format('u')} AS h FROM {_EVENTS} WHERE e IN ('request', 'request_failed')) "
    f"WHERE h IS NOT NULL AND {ETLD1.format('h')} IS DISTINCT FROM site_etld1"
)
def third_party_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Which third parties each site contacts."""
    return third_party.site_third_party_pairs(third_party.network_events(table(spark, d, "fetches").select("site_etld1", "network_requests")))


@query(f"SELECT site_etld1, count(DISTINCT {HOST.format('u')})::INT AS n_hosts FROM {_EVENTS} WHERE e IN ('request', 'request_failed') AND {HOST.format('u')} IS NOT NULL GROUP BY site_etld1")
def third_parties_of_site(spark: SparkSession, d: str) -> DataFrame:
    ev = third_party.network_events(table(spark, d, "fetches").select("site_etld1", "network_requests"))
    return third_party.third_parties_of_site(ev).select("site_etld1", F.size("raw_hosts").alias("n_hosts"))


_MAPPED = """SELECT DISTINCT t.third_party_etld1, CASE WHEN r.etld1 IS NOT NULL THEN r.entity ELSE b.entity END AS entity, CASE WHEN r.etld1 IS NOT NULL THEN r.prevalence ELSE b.prevalence END AS prevalence,
 CASE WHEN r.etld1 IS NOT NULL THEN r.policy_url ELSE b.policy_url END AS policy_url, r.source_domain_file AS tracker_radar_source_domain_file, CASE WHEN r.etld1 IS NULL THEN b.source_pattern_file END AS trackerdb_source_pattern_file
FROM third_parties AS t LEFT JOIN kb_radar AS r ON r.etld1 = t.third_party_etld1 LEFT JOIN kb_trackerdb AS b ON b.etld1 = t.third_party_etld1"""


@query(_MAPPED)
def kb_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Third parties with their organisation: a row of the first base counts whole, the second only where there is none."""
    t = table(spark, d, "third_parties").select("third_party_etld1").distinct()
    m = third_party.map_third_parties(t, table(spark, d, "kb_radar"), table(spark, d, "kb_trackerdb"))
    return m.select("third_party_etld1", "entity", "prevalence", "policy_url", "tracker_radar_source_domain_file", "trackerdb_source_pattern_file")


@query("SELECT k.etld1, coalesce(nullif(r.entity, ''), nullif(b.entity, '')) AS site_entity FROM (SELECT etld1 FROM kb_radar UNION SELECT etld1 FROM kb_trackerdb) AS k LEFT JOIN kb_radar AS r ON r.etld1 = k.etld1 LEFT JOIN kb_trackerdb AS b ON b.etld1 = k.etld1")
def site_entity(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every known domain: here the second base fills in field by field."""
    r, b = table(spark, d, "kb_radar"), table(spark, d, "kb_trackerdb")
    return third_party.site_entity(r.select("etld1").union(b.select("etld1")).distinct(), r, b, "etld1")


@query(
    "WITH o AS (SELECT site_etld1, min(entity) AS site_entity FROM third_parties GROUP BY site_etld1) SELECT t.obs_id, t.received_at, t.entity FROM third_parties AS t JOIN o ON o.site_etld1 = t.site_etld1 "
    "WHERE NOT (coalesce(o.site_entity, '') <> '' AND coalesce(t.entity, '') <> '' AND o.site_entity = t.entity)"
)
def same_entity_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Observations without those of the site's own organisation (which here is its alphabetically first one)."""
    t = table(spark, d, "third_parties")
    own = t.groupBy("site_etld1").agg(F.min("entity").alias("site_entity"))
    return third_party.drop_same_entity(t.join(own, "site_etld1")).select("obs_id", "received_at", "entity")


@query(
    f"""WITH t AS (SELECT result_id, t.third_party_etld1 AS k, max(t.prevalence) AS p, max(t.policy_url) AS u FROM {TP} GROUP BY result_id, k)
SELECT result_id, k AS third_party_etld1, u AS policy_url FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY p DESC NULLS LAST, k NULLS FIRST) <= 5) WHERE coalesce(u, '') <> ''"""
)
def policies_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Which third-party policies would be fetched for each result, of the five most prevalent third parties."""
    r = summary.latest_results(table(spark, d, "results")).where("result_id is not null")
    t = r.select("result_id", F.explode("third_parties").alias("t")).where("t is not null").groupBy("result_id", F.col("t.third_party_etld1").alias("third_party_etld1"))
    t = t.agg(F.max("t.prevalence").alias("prevalence"), F.max("t.policy_url").alias("policy_url"))
    return third_party.policies_to_fetch(t, "result_id", 5).select("result_id", "third_party_etld1", "policy_url")


@query("SELECT t.policy_url, count(*)::BIGINT AS wanted, bool_or(f.url IS NOT NULL) AS fetched FROM third_parties AS t LEFT JOIN (SELECT DISTINCT url FROM fetches) AS f ON f.url = t.policy_url WHERE t.policy_url IS NOT NULL GROUP BY t.policy_url")
def fetch_once(spark: SparkSession, d: str) -> DataFrame:
    """Each policy address once, how often it is wanted, and whether a stored fetch answers it."""
    f = table(spark, d, "fetches").select("url", F.lit(True).alias("got"))
    t = table(spark, d, "third_parties").select("policy_url").where("policy_url is not null")
    return third_party.fetch_once(t, f).groupBy("policy_url").agg(F.count(F.lit(1)).alias("wanted"), F.coalesce(F.bool_or("got"), F.lit(False)).alias("fetched"))


@query(
    "SELECT lower(entity) AS name, arg_min(etld1, trackerdb_id) FILTER (WHERE etld1 <> '') AS etld1, arg_min(policy_url, trackerdb_id) FILTER (WHERE policy_url <> '') AS policy_url, "
    "arg_min(source_org_file, trackerdb_id) FILTER (WHERE source_org_file <> '') AS source_org_file FROM kb_trackerdb WHERE entity IS NOT NULL GROUP BY lower(entity)"
)
def kb_fold_first(spark: SparkSession, d: str) -> DataFrame:
    """Entries of one name folded: of each field the first value that is there."""
    t = table(spark, d, "kb_trackerdb").where("entity is not null").withColumn("name", F.lower("entity"))
    return kb_build.fold_first(t, "name", "trackerdb_id", ["etld1", "policy_url", "source_org_file"])


@query("SELECT entity, etld1, prevalence, policy_url FROM kb_radar WHERE entity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY source_domain_file DESC) = 1")
def kb_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """One entry per entity: the one of the last source file."""
    return kb_build.last_wins(table(spark, d, "kb_radar").where("entity is not null"), "entity", "source_domain_file").select("entity", "etld1", "prevalence", "policy_url")


# --- summaries --------------------------------------------------------------------------------------------------------


def _results(spark: SparkSession, d: str) -> DataFrame:
    return summary.latest_results(table(spark, d, "results")).where("result_id is not null")


@query(f"SELECT coalesce(nullif(status, ''), 'unknown') AS status, count(*)::BIGINT AS n FROM {LATEST} GROUP BY 1")
def summary_status(spark: SparkSession, d: str) -> DataFrame:
    return summary.status_counts(_results(spark, d))


_RADAR, _DB = "coalesce(t.tracker_radar_source_domain_file, '') <> ''", "(coalesce(t.trackerdb_source_pattern_file, '') <> '' OR coalesce(t.trackerdb_source_org_file, '') <> '')"
_MAP = f"({_RADAR} OR coalesce(t.entity, '') <> '' OR coalesce(t.policy_url, '') <> '' OR coalesce(t.prevalence, 0) <> 0 OR coalesce(len(t.categories), 0) > 0)"


@query(
    f"""SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE {_MAP})::BIGINT AS mapped, count(*) FILTER (WHERE NOT {_MAP})::BIGINT AS unmapped,
 count(*) FILTER (WHERE {_MAP} AND coalesce(t.policy_url, '') = '')::BIGINT AS no_policy_url, count(*) FILTER (WHERE {_RADAR})::BIGINT AS radar_mapped,
 count(*) FILTER (WHERE NOT {_RADAR} AND {_DB})::BIGINT AS trackerdb_mapped, greatest(0, count(*) - count(*) FILTER (WHERE {_RADAR}) - count(*) FILTER (WHERE NOT {_RADAR} AND {_DB}))::BIGINT AS mapping_unmapped FROM {TP}"""
)
def summary_third_parties(spark: SparkSession, d: str) -> DataFrame:
    return summary.third_party_totals(_results(spark, d))


@query(f"SELECT c.c AS category, count(*)::BIGINT AS n FROM {TP} AS x, (SELECT unnest(x.t.categories)) AS c(c) WHERE trim(c.c) <> '' GROUP BY c.c")
def summary_categories(spark: SparkSession, d: str) -> DataFrame:
    return summary.category_counts(_results(spark, d))


_ENT = f"SELECT t.entity AS entity, count(*)::BIGINT AS n, round(sum(t.prevalence) / count(*), 9) AS prevalence_avg, CASE WHEN max(t.prevalence) IS NOT NULL THEN greatest(max(t.prevalence), 0.0) END AS prevalence_max FROM {TP} WHERE trim(t.entity) <> '' GROUP BY t.entity"


@query(_ENT)
def summary_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities with the mean prevalence over all their occurrences."""
    return summary.entity_stats(_results(spark, d)).withColumn("prevalence_avg", F.round("prevalence_avg", 9))


@query(f"SELECT t.entity AS entity, c.c AS category, count(*)::BIGINT AS n FROM {TP} AS x, (SELECT unnest(x.t.categories)) AS c(c) WHERE trim(c.c) <> '' AND trim(t.entity) <> '' GROUP BY 1, 2")
def summary_entity_categories(spark: SparkSession, d: str) -> DataFrame:
    return summary.entity_categories(_results(spark, d))


@query(
    f"""WITH e AS ({_ENT}), top AS (SELECT * FROM e ORDER BY n DESC, entity LIMIT 20),
c AS (SELECT t.entity AS entity, c.c AS category, count(*) AS n FROM {TP} AS x, (SELECT unnest(x.t.categories)) AS c(c) WHERE trim(c.c) <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, category) AS r FROM c)
SELECT top.entity, top.n, top.prevalence_avg, top.prevalence_max, coalesce(string_agg(r.category, '|' ORDER BY r.r), '') AS categories FROM top LEFT JOIN r ON r.entity = top.entity AND r.r <= 3 GROUP BY ALL"""
)
def summary_top_entities(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent entities with their three most frequent categories."""
    return summary.top_entities(_results(spark, d)).withColumn("prevalence_avg", F.round("prevalence_avg", 9)).withColumn("categories", F.array_join("categories", "|"))


@query()
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary document of all results."""
    return summary.run_summary(_results(spark, d), "all", 0, "mixed")


@query(
    f"""SELECT r.result_id, r.rank, coalesce(nullif(r.site_etld1, ''), nullif(r.input, '')) AS site, r.status, r.first_party_policy.url AS "policyUrl", t.u.third_party_etld1 AS name, t.u.policy_url AS third_party_policy
FROM {LATEST} AS r, (SELECT unnest(r.third_parties)) AS t(u) WHERE t.u IS NOT NULL"""
)
def explorer_records(spark: SparkSession, d: str) -> DataFrame:
    """Explorer records, a row for each third party."""
    e = summary.explorer_records(_results(spark, d)).withColumn("t", F.explode("thirdParties"))
    return e.select("result_id", "rank", "site", "status", "policyUrl", F.col("t.name").alias("name"), F.col("t.policyUrl").alias("third_party_policy"))


@query(
    f"""SELECT result_id, site FROM (SELECT result_id, coalesce(nullif(site_etld1, ''), nullif(input, '')) AS site, status, len(list_filter(coalesce(third_parties, []), lambda x: x IS NOT NULL)) AS n FROM {LATEST})
WHERE coalesce(site, '') <> '' AND status = 'ok' AND n >= 3 AND contains(lower(site), 'shop')"""
)
def explorer_filter(spark: SparkSession, d: str) -> DataFrame:
    return summary.explorer_filter(summary.explorer_records(_results(spark, d)), "ok", 3, "Shop").select("result_id", "site")


@query(
    "WITH s AS (SELECT run_id AS folder, max(ended_at) AS updated_at, count(*)::BIGINT AS n FROM results WHERE status = 'ok' AND run_id IS NOT NULL GROUP BY run_id), "
    "t AS (SELECT run_id AS folder, max(ended_at) AS updated_at, count(*)::BIGINT AS n FROM results WHERE status <> 'ok' AND run_id IS NOT NULL GROUP BY run_id) "
    "SELECT coalesce(s.folder, t.folder) AS folder, coalesce(s.updated_at, t.updated_at) AS updated_at, s.n AS n_ok, t.n AS n_failed FROM s FULL JOIN t ON s.folder = t.folder"
)
def run_history(spark: SparkSession, d: str) -> DataFrame:
    """Two documents of each run side by side."""
    r = table(spark, d, "results").where("run_id is not null")
    doc = lambda x: x.groupBy(F.col("run_id").alias("folder")).agg(F.max("run_id").alias("run_id"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("updated_at"), F.count(F.lit(1)).alias("n"))
    h = summary.run_history(doc(r.where("status = 'ok'")), doc(r.where("status <> 'ok'")))
    return h.select("folder", "updated_at", F.col("summary.n").alias("n_ok"), F.col("state.n").alias("n_failed"))


@query(
    "SELECT DISTINCT total_ms, CASE WHEN total_ms > 0 THEN CASE WHEN total_ms // 1000 >= 3600 THEN format('{}h {:02d}m', total_ms // 3600000, total_ms // 60000 % 60) "
    "WHEN total_ms // 1000 >= 60 THEN format('{}m {:02d}s', total_ms // 60000, total_ms // 1000 % 60) ELSE format('{}s', total_ms // 1000) END ELSE '—' END AS shown FROM results WHERE total_ms IS NOT NULL"
)
def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "results").where("total_ms is not null").select("total_ms", display.duration(F.col("total_ms")).alias("shown")).distinct()


# --- telemetry: the driver's events table as a stream ---------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "events")
    return telemetry.file_stream(spark, d, batch.schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def stream_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Running counts of a stream, as they are at its end."""
    return telemetry.run_to_table(telemetry.event_counts(_stream(spark, d)), "complete")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Counts per hour of a stream (an extension beside the run's own events)."""
    t = telemetry.run_to_table(telemetry.tumbling(_stream(spark, d), "ts", "1 hour", "event_type"), "complete")
    return t.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id FROM events GROUP BY event_id, user_id")
def stream_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each event of a stream once."""
    return telemetry.run_to_table(telemetry.distinct_events(_stream(spark, d), "event_id", "ts").select("event_id", "user_id"), "append")


@query(
    "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 minute THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "y AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT min(ts) AS session_start, user_id, count(*)::BIGINT AS n FROM y GROUP BY user_id, s"
)
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, as a batch (an extension)."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return telemetry.sessions(e, "ts", "30 minutes", "user_id").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("SELECT user_id, arg_max(event_type, ts) AS latest, max(ts) AS at, count(*)::BIGINT AS n FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user: the state a consumer of the stream would show."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("latest"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, sum(1) OVER (ORDER BY event_id)::BIGINT AS seen FROM events WHERE event_type = 'error'")
def progress_of_errors(spark: SparkSession, d: str) -> DataFrame:
    """A running counter over the (few) error events, as a run's progress counts them."""
    e = table(spark, d, "events").where("event_type = 'error'")
    # Totals of slices first, so that the running count needs no single task over all rows.
    slices = e.withColumn("slice", F.floor(F.col("event_id") / 4096))
    before = slices.groupBy("slice").agg(F.count(F.lit(1)).alias("k"))
    before = before.select("slice", F.coalesce(F.sum("k").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    n = F.row_number().over(Window.partitionBy("slice").orderBy("event_id"))
    return slices.withColumn("n", n).join(before, "slice").select("event_id", (F.col("base") + F.col("n")).cast("bigint").alias("seen"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
