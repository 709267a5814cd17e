"""Knowledge bases of trackers from their source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.functions.common import first_truthy, strip
from policylake.functions.url import etld1
from policylake.resources import fixed


def _text(v: Column, path: str) -> Column:
    """A JSON string at a path, NULL for other kinds."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def policy_of(v: Column, at: str = "$") -> Column:
    """The first policy key whose value is a web address."""
    return F.coalesce(*[F.when(_text(v, f"{at}.{k}").startswith("http"), _text(v, f"{at}.{k}")) for k in fixed.KB_POLICY_KEYS])


def _number(v: Column, path: str) -> Column:
    """A JSON number (or truth value) at a path, NULL for text that looks like one."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(~kind.startswith("STRING") & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get(v, path, "double"))


def prevalence_of(v: Column, at: str = "$.prevalence") -> Column:
    """A number, or the first number under one of the usual keys."""
    return F.coalesce(_number(v, at), *[_number(v, f"{at}.{k}") for k in fixed.KB_PREVALENCE_KEYS])


def categories_of(v: Column, at: str = "$.categories") -> Column:
    """A text as a list of one, the texts of a list, else an empty list."""
    empty = F.array().cast("array<string>")
    listed = F.filter(F.transform(F.try_variant_get(v, at, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))), lambda x: x.isNotNull())
    return F.coalesce(F.when(_text(v, at).isNotNull(), F.array(_text(v, at))), listed, empty)


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def radar_index(entities: DataFrame, domains: DataFrame) -> DataFrame:
    """``etld1, entity, categories, prevalence, policy_url, source_domain_file`` from JSON files (``path``, ``v`` variant).

    Of several files of one domain the last path wins. A domain without a policy takes that of its entity. Unreadable files (NULL) are skipped.
    """
    v = F.col("v")

    def filled(c: Column) -> Column:
        return F.when(strip(c) != "", c)

    ent = entities.where("v is not null").select(F.coalesce(filled(_text(v, "$.name")), _stem(F.col("path"))).alias("entity"), F.coalesce(policy_of(v), policy_of(v, "$.properties")).alias("p"), "path")
    ent = ent.where("p is not null").groupBy("entity").agg(F.max_by("p", "path").alias("entity_policy"))
    d = domains.where("v is not null").select(
        F.lower(F.coalesce(filled(_text(v, "$.domain")), _stem(F.col("path")))).alias("etld1"),
        F.coalesce(filled(first_truthy(_text(v, "$.owner.name"), _text(v, "$.owner.displayName"))), _text(v, "$.entity")).alias("entity"),
        categories_of(v).alias("categories"), prevalence_of(v).alias("prevalence"), F.coalesce(policy_of(v), policy_of(v, "$.owner")).alias("own_policy"), F.col("path").alias("source_domain_file"),
    )
    last = d.groupBy("etld1").agg(F.max_by(F.struct(*[c for c in d.columns if c != "etld1"]), "source_domain_file").alias("r")).select("etld1", "r.*")
    return last.join(ent, "entity", "left").select("etld1", "entity", "categories", "prevalence", F.coalesce("own_policy", "entity_policy").alias("policy_url"), "source_domain_file")


def parse_eno(text: Column) -> Column:
    """``struct<data: map, sections: map of lists>`` of a text: ``key: value`` lines, and the lines between ``--- name`` marks.

    A fold over the lines; opening the open section closes it, another mark switches. Of repeated keys the last counts.
    """
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), strip), lambda x: x != "")
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<struct<sec:string,line:string>>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        name = strip(F.substring(x, 4, 10**6))
        mark = x.startswith("---")
        cur = F.when(mark, F.when(acc["cur"] == name, F.lit("")).otherwise(name)).otherwise(acc["cur"])
        rows = F.when(mark, acc["rows"]).otherwise(F.concat(acc["rows"], F.array(F.struct(acc["cur"].alias("sec"), x.alias("line")))))
        return F.struct(cur.alias("cur"), rows.alias("rows"))

    rows = F.aggregate(lines, start, step, lambda acc: acc["rows"])
    pairs = F.filter(rows, lambda r: (r["sec"] == "") & r["line"].contains(":"))
    keys = F.transform(pairs, lambda r: strip(F.split_part(r["line"], F.lit(":"), F.lit(1))))
    vals = F.transform(pairs, lambda r: strip(F.regexp_replace(r["line"], "^[^:]*:", "")))
    distinct = F.array_distinct(keys)
    # The last of repeated keys: its place in the reversed list.
    data = F.map_from_arrays(distinct, F.transform(distinct, lambda k: F.element_at(F.reverse(vals), F.array_position(F.reverse(keys), k).cast("int"))))
    secs = F.array_distinct(F.transform(F.filter(rows, lambda r: r["sec"] != ""), lambda r: r["sec"]))
    sections = F.map_from_arrays(secs, F.transform(secs, lambda s: F.transform(F.filter(rows, lambda r: r["sec"] == s), lambda r: r["line"])))
    return F.struct(data.alias("data"), sections.alias("sections"))


def trackerdb_index(categories: DataFrame, organizations: DataFrame, patterns: DataFrame) -> DataFrame:
    """``etld1, entity, categories, prevalence, policy_url, source_pattern_file, source_org_file`` from ENO files (``path``, ``text``).

    Files of one domain are folded in path order: the first value of each field, all categories once.
    """

    def read(d: DataFrame) -> DataFrame:
        return d.select("path", _stem(F.col("path")).alias("slug"), parse_eno(F.col("text")).alias("e"))

    def get(key: str) -> Column:
        return F.nullif(F.try_element_at(F.col("e.data"), F.lit(key)), F.lit(""))

    c = read(categories).groupBy("slug").agg(F.max_by(F.coalesce(get("name"), F.col("slug")), "path").alias("cat_name")).withColumnRenamed("slug", "cat_slug")
    o = read(organizations).select("slug", F.struct(F.coalesce(get("name"), F.col("slug")).alias("name"), F.coalesce(get("privacy_policy_url"), get("privacyPolicyUrl")).alias("url"), F.col("path").alias("file")).alias("o"), "path")
    o = o.groupBy("slug").agg(F.max_by("o", "path").alias("org")).withColumnRenamed("slug", "org_slug")
    p = read(patterns).select("path", "slug", get("organization").alias("org_slug"), get("category").alias("cat_slug"), get("name").alias("name"), F.posexplode(F.try_element_at(F.col("e.sections"), F.lit("domains"))).alias("no", "domain"))
    p = p.withColumn("domain", F.regexp_replace(F.lower(strip(F.col("domain"))), r"^\*\.", "")).where("domain <> ''").withColumn("etld1", F.coalesce(etld1(F.col("domain")), F.col("domain")))
    p = p.join(c, "cat_slug", "left").join(o, "org_slug", "left")
    p = p.select("etld1", F.struct("path", "no").alias("ord"), F.coalesce("org.name", "name", "slug").alias("entity"), F.coalesce("cat_name", "cat_slug").alias("category"), F.col("org.url").alias("policy_url"), F.col("path").alias("pattern_file"), F.col("org.file").alias("org_file"))

    def first(f: str) -> Column:
        return F.expr(f"min_by({f}, ord) FILTER (WHERE {f} <> '')")

    cats = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("ord", "category")))), lambda x: x["category"]))
    return p.groupBy("etld1").agg(
        first("entity").alias("entity"), cats.alias("categories"), F.lit(None).cast("double").alias("prevalence"), first("policy_url").alias("policy_url"),
        first("pattern_file").alias("source_pattern_file"), first("org_file").alias("source_org_file"),
    )


def fold_first(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: of each field the first value, in ``order``, that is neither NULL nor empty."""
    return df.groupBy(key).agg(*[F.expr(f"min_by(`{f}`, `{order}`) FILTER (WHERE cast(`{f}` as string) <> '')").alias(f) for f in fields])


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One whole row per key: the last in ``order``."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
