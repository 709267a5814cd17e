"""Readers of the project's inputs: site lists, knowledge bases, result lines, run folders, artifacts, browser logs."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESULT = (
    "rank int, input string, site_url string, final_url string, site_etld1 string, status string, home_status_code int, status_code int, error_message string, error string, "
    "home_fetch_mode string, home_fetch_attempts int, first_party_policy struct<url:string,status_code:int,likeliness_score:double,text_len:bigint,text_len_raw:bigint,extraction_method:string>, "
    "non_browsable_reason string, third_parties array<struct<third_party_etld1:string,entity:string,categories:array<string>,prevalence:double,policy_url:string,tracker_radar_source_domain_file:string,"
    "trackerdb_source_pattern_file:string,trackerdb_source_org_file:string,policy_extraction_method:string>>, third_party_policy_fetches array<struct<third_party_etld1:string,policy_url:string,"
    "fetch_success:boolean,status_code:int,text_len:bigint,text_len_raw:bigint,extraction_method:string,error_message:string>>, error_code string, home_fetch_ms bigint, policy_fetch_ms bigint, "
    "third_party_extract_ms bigint, third_party_policy_fetch_ms bigint, total_ms bigint, run_id string, started_at string, ended_at string"
)
RADAR = "entity string, categories array<string>, prevalence double, policy_url string, source_domain_file string"
TRACKERDB = "entity string, categories array<string>, prevalence double, policy_url string, source_pattern_file string, source_org_file string"
SUMMARY = "run_id string, total_sites bigint, processed_sites bigint, success_rate double, status_counts map<string,bigint>, started_at string, updated_at string"


def _exists(path: str) -> bool:
    """Whether a path can be there: only local ones are looked at, others are left to the reader."""
    return os.path.exists(path.removeprefix("file://")) if "://" not in path or path.startswith("file://") else True


def site_list(spark: SparkSession, path: str) -> DataFrame:
    """``rank (NULL), site, ord`` of a text file with a site in each line; blank lines and ``#`` comments left out."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("ord", "site")).select(F.lit(None).cast("int").alias("rank"), F.trim("site").alias("site"), F.col("ord").cast("bigint").alias("ord"))
    return d.where((F.col("site") != "") & ~F.col("site").startswith("#"))


def ranked_list(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    """``rank, site, ord`` of a ranked CSV snapshot (rank, domain), the first ``top`` ranks."""
    d = spark.read.csv(path, schema="rank int, site string").where("site is not null").withColumn("ord", F.col("rank").cast("bigint"))
    return d.where(F.col("rank") <= top) if top else d


def exclusion_list(spark: SparkSession, path: str) -> DataFrame:
    """``domain``: lower-cased, without final dots; a missing file is an empty list."""
    if not _exists(path):
        return spark.createDataFrame([], "domain string")
    d = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#"))
    return d.select(F.regexp_replace(F.lower("v"), r"\.+$", "").alias("domain")).distinct()


def kb_json(spark: SparkSession, path: str, fields: str = RADAR) -> DataFrame:
    """``etld1`` and fields of a knowledge base kept as one JSON object by domain; entries without any field are left out. One document is one task."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{', '.join(':'.join(x.rsplit(' ', 1)) for x in fields.split(', ')).replace(' ', '')}>>")).alias("etld1", "r"))
    names = [x.split(" ")[0] for x in fields.split(", ")]
    return d.where(F.greatest(*[F.col(f"r.{n}").isNotNull().cast("int") for n in names]) == 1).select("etld1", "r.*")


def json_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below the root) and ``v`` (variant, NULL where unreadable) of all JSON files under a folder."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    return d.select(_below(root).alias("path"), F.try_parse_json("value").alias("v"))


def eno_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and ``text`` of all ENO files under a folder."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.eno").text(root, wholetext=True)
    return d.select(_below(root).alias("path"), F.col("value").alias("text"))


def _below(root: str):
    r = os.path.abspath(root.removeprefix("file://")) if _exists(root) else root
    return F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), r"^\Q" + r.rstrip("/") + r"/\E", "")


def result_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Result lines with a fixed schema; a line that is no JSON is kept in ``_corrupt_record``, blank lines are left out."""
    d = spark.read.schema(RESULT + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return d.limit(limit) if limit else d


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row; no row where the file is missing."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if _exists(path) else spark.createDataFrame([], schema)


def run_folders(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Summaries and states of all run folders under a root, with ``folder``."""

    def read(name: str) -> DataFrame:
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder")
        d = spark.read.schema(SUMMARY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
        return d.select(folder, *[x.split(" ")[0] for x in SUMMARY.split(", ")])

    return read("*.summary.json"), read("*.state.json")


def folder_size(spark: SparkSession, root: str) -> DataFrame:
    """Bytes under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("length").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def artifact_text(spark: SparkSession, root: str, relative: str) -> DataFrame:
    """``path, content`` of one file below a root; a path that leads out of it is refused."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, relative))
    if os.path.commonpath([base, full]) != base:
        raise ValueError("the path leads out of the root")
    if not os.path.isfile(full):
        return spark.createDataFrame([], "path string, content string")
    return spark.read.text(full, wholetext=True).select(F.lit(relative).alias("path"), F.col("value").alias("content"))


class SqliteRequests(DataSource):
    """``spark.read.format("sqlite_requests").load(folder)``: distinct request URLs of a browser's SQLite log (first ``*.sqlite``, else ``*.db``).

    Option ``query`` replaces the query; its first column is the URL. Without a log there are no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_requests"

    def schema(self) -> str:
        return "url string"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.query = options["path"], options.get("query", "SELECT DISTINCT url FROM http_requests")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import glob
        import sqlite3

        p = self.path.removeprefix("file://")
        found = [p] if os.path.isfile(p) else sorted(glob.glob(f"{p}/**/*.sqlite", recursive=True)) or sorted(glob.glob(f"{p}/**/*.db", recursive=True))
        if not found:
            return
        with sqlite3.connect(f"file:{found[0]}?mode=ro", uri=True) as c:
            for row in c.execute(self.query):
                if isinstance(row[0], str) and row[0].startswith(("http://", "https://")):
                    yield (row[0],)


class HttpPages(DataSource):
    """``spark.read.format("http_pages").option("urls", "...")``: live pages by plain HTTP, https before http, up to ``max_bytes``.

    A failed fetch is a row with its error, never an exception. Stored fetches are the usual source; this one needs a network.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return "url string, success boolean, status_code int, content_type string, body string, error_message string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.timeout, self.max_bytes, self.agent = float(options.get("timeout_ms", 15000)) / 1000, int(options.get("max_bytes", 2_000_000)), options.get("user_agent", "policylake")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import urllib.request
        from urllib.error import HTTPError, URLError

        error = None
        for u in dict.fromkeys((partition.value, partition.value.replace("https://", "http://", 1))):
            try:
                with urllib.request.urlopen(urllib.request.Request(u, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:
                    body = r.read(self.max_bytes).decode("utf-8", "ignore")
                    yield (r.geturl(), True, r.status, r.headers.get("content-type", ""), body, None)
                    return
            except HTTPError as e:
                error = f"http_status_{e.code}"
            except (URLError, OSError, ValueError) as e:
                error = str(e) or type(e).__name__
        yield (partition.value, False, None, None, None, error)


def register(spark: SparkSession) -> None:
    """Make the readers known to a session."""
    spark.dataSource.register(SqliteRequests)
    spark.dataSource.register(HttpPages)
