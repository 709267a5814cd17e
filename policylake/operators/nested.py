"""Problem 2: deeply nested result lines as related flat tables.

A line is checked to be a whole document and split into records kept as maps from key to raw JSON text, so that any
set of keys and any nesting is read without a fixed schema; each target table then reads the parts it needs. Nested ``transform`` calls attach the keys of the ancestors and the
places in the lists, ``flatten`` joins the lists of the records of a line, and one ``inline`` per target table
emits its rows. Everything is a projection: no shuffle, no Python, no state beyond one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a record, or a part of it, is kept.
ENVELOPES = ("result", "record", "data", "payload", "item")
THIRD_PARTIES = ("third_parties", "thirdParties")
POLICY_FETCHES = ("third_party_policy_fetches", "thirdPartyPolicyFetches")
FIRST_POLICY = ("first_party_policy", "firstPartyPolicy")
FIRST_POLICY_URL = ("policyUrl", "policy_url")
CHILD_KEY = ("third_party_etld1", "thirdPartyEtld1", "name")
URL_KEY = ("url", "policyUrl", "policy_url")
MAP = "map<string,string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _first(m: Column, keys: tuple[str, ...]) -> Column:
    """The first non-null value under one of the keys."""
    return F.coalesce(*[m[k] for k in keys])


def _is_array(c: Column) -> Column:
    return F.ltrim(c).startswith("[")


def _is_object(c: Column) -> Column:
    return F.ltrim(c).startswith("{")


def _json_map(c: Column) -> Column:
    return F.from_json(c, MAP, {"allowNonNumericNumbers": "true"})


def _objects(c: Column) -> Column:
    """The elements of a JSON array text (raw JSON each), or the one object, else an empty array."""
    none = F.array().cast("array<string>")
    listed = F.from_json(c, "array<string>", {"allowNonNumericNumbers": "true"})
    return F.coalesce(F.when(_is_array(c), listed).when(_is_object(c), F.array(c)), none)


def records(df: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """``id_col, recs``: the readable records of each line, as an array of (record_no, map).

    ``record_no`` is the place in the line's list, from 0; places of elements that are no records are left out
    but counted. A record inside an envelope (``{"type": ..., "result": {...}}``) is taken out of it. A line that
    is no JSON document, or null or empty, has an empty array, and so has one with a string of more than LONGEST_STRING
    characters; ``rejected_lines`` lists them with the reason. A repeated line id gives a row for each.
    """
    line = F.col(f"`{line_col}`")
    # The parser keeps what it read of a broken document; only whole documents count.
    whole = F.when(F.try_parse_json(line).isNotNull(), line)
    d = df.select(F.col(f"`{id_col}`").alias(id_col), _objects(whole).alias("elements"))
    opened = F.transform("elements", lambda e, i: F.struct(i.alias("record_no"), F.when(_is_object(e), _json_map(e)).alias("m")))

    def inner(r: Column) -> Column:
        body = _first(r["m"], ENVELOPES)
        is_envelope = _is_object(body) & ~F.exists(F.map_keys(r["m"]), lambda k: k.isin("input", "site", "site_url", "site_etld1"))
        return F.struct(r["record_no"].alias("record_no"), F.when(F.coalesce(is_envelope, F.lit(False)), _json_map(body)).otherwise(r["m"]).alias("m"))

    d = d.select(id_col, F.filter(opened, lambda r: r["m"].isNotNull()).alias("recs"))
    return d.select(id_col, F.transform("recs", inner).alias("recs")).select(id_col, F.filter("recs", lambda r: r["m"].isNotNull()).alias("recs"))


#: The longest string that the parser reads; a document with a longer one is refused as a whole.
LONGEST_STRING = 20_000_000


def rejected_lines(df: DataFrame, id_col: str = "line_id", line_col: str = "line") -> DataFrame:
    """``id_col, n_chars, reason`` of the lines from which ``records`` reads nothing: every line is there or here.

    ``reason`` is ``empty`` (null or blank), ``string_too_long`` (may be a document, with a string of more than
    LONGEST_STRING characters, which the parser refuses), ``not_json``, or ``no_record`` (a document without a record).
    """
    line = F.col(f"`{line_col}`")
    n = records(df.select(F.struct(F.col(f"`{id_col}`"), F.length(line).alias("n"), line.alias("line")).alias("at"), line.alias("line")), "at", "line")
    d = n.where(F.size("recs") == 0).select(F.col(f"at.{id_col}").alias(id_col), F.col("at.n").alias("n_chars"), F.col("at.line").alias("line"))
    reason = (
        F.when(F.coalesce(F.trim("line"), F.lit("")) == "", "empty")
        .when(F.try_parse_json("line").isNotNull(), "no_record")
        .when((F.col("n_chars") > LONGEST_STRING) & F.ltrim("line").rlike(r"^[\[{]"), "string_too_long")
        .otherwise("not_json")
    )
    return d.select(id_col, "n_chars", reason.alias("reason"))


def _children(m: Column, names: tuple[str, ...]) -> Column:
    """The child objects under one of the names, as (child_no, key, map), whatever form they are kept in.

    A list, a JSON text of a list, a single object, or an object from key to child; a child without the key of its
    own in the last form has the key of its entry.
    """
    def parts(raw: Column) -> Column:
        as_map = F.when(_is_object(raw), _json_map(raw))

        def split_up(mp: Column) -> Column:
            single = F.arrays_overlap(F.map_keys(mp), F.array(*[F.lit(k) for k in CHILD_KEY]))
            keyed = F.transform(
                F.map_entries(mp), lambda e, i: F.struct(i.alias("child_no"), e["key"].alias("own"), F.when(_is_object(e["value"]), _json_map(e["value"])).alias("m"))
            )
            # Strings in a list are the keys themselves.
            listed = F.transform(
                _objects(raw),
                lambda e, i: F.struct(i.alias("child_no"), F.when(~_is_object(e) & ~_is_array(e), e).alias("own"), F.when(_is_object(e), _json_map(e)).alias("m")),
            )
            return F.when(mp.isNotNull() & ~single, keyed).otherwise(listed)

        return _let(as_map, split_up)

    each = F.transform(
        _let(_first(m, names), parts),
        lambda c: F.struct(c["child_no"].alias("child_no"), F.coalesce(F.nullif(_first(c["m"], CHILD_KEY), F.lit("")), c["own"]).alias("child_key"), c["m"].alias("m")),
    )
    return F.filter(each, lambda c: F.coalesce(c["child_key"] != "", F.lit(False)))


def _inline(recs: DataFrame, id_col: str, rows) -> DataFrame:
    """One ``inline`` of the flattened per-record arrays that ``rows(record)`` yields."""
    return recs.select(id_col, F.inline(F.flatten(F.transform("recs", rows))))


def third_party_table(recs: DataFrame, id_col: str = "line_id") -> DataFrame:
    """One row per third party with a key: parent (id, record_no), child_no, third_party_etld1 as written, and its fields."""

    def rows(r: Column) -> Column:
        return F.transform(
            _children(r["m"], THIRD_PARTIES),
            lambda c: F.struct(
                r["record_no"].alias("record_no"),
                c["child_no"].alias("child_no"),
                c["child_key"].alias("third_party_etld1"),
                c["m"]["entity"].alias("entity"),
                F.coalesce(F.from_json(c["m"]["categories"], "array<string>"), F.array().cast("array<string>")).alias("categories"),
                c["m"]["prevalence"].try_cast("double").alias("prevalence"),
                _first(c["m"], ("policy_url", "policyUrl")).alias("policy_url"),
                c["m"]["tracker_radar_source_domain_file"].alias("tracker_radar_source_domain_file"),
                c["m"]["trackerdb_source_pattern_file"].alias("trackerdb_source_pattern_file"),
                c["m"]["trackerdb_source_org_file"].alias("trackerdb_source_org_file"),
                _first(c["m"], ("policy_extraction_method", "extractionMethod")).alias("policy_extraction_method"),
            ),
        )

    return _inline(recs, id_col, rows)


def policy_fetch_table(recs: DataFrame, id_col: str = "line_id") -> DataFrame:
    """One row per third-party policy fetch with a key."""

    def rows(r: Column) -> Column:
        return F.transform(
            _children(r["m"], POLICY_FETCHES),
            lambda c: F.struct(
                r["record_no"].alias("record_no"),
                c["child_no"].alias("child_no"),
                c["child_key"].alias("third_party_etld1"),
                _first(c["m"], ("policy_url", "policyUrl")).alias("policy_url"),
                c["m"]["fetch_success"].try_cast("boolean").alias("fetch_success"),
                c["m"]["status_code"].try_cast("int").alias("status_code"),
                c["m"]["text_len"].try_cast("bigint").alias("text_len"),
                c["m"]["text_len_raw"].try_cast("bigint").alias("text_len_raw"),
                _first(c["m"], ("extraction_method", "extractionMethod")).alias("extraction_method"),
                c["m"]["error_message"].alias("error_message"),
            ),
        )

    return _inline(recs, id_col, rows)


def first_party_table(recs: DataFrame, id_col: str = "line_id") -> DataFrame:
    """One row per record with a first-party policy URL, kept as an object, as its JSON text, or as a bare URL."""

    def rows(r: Column) -> Column:
        raw = _first(r["m"], FIRST_POLICY)
        bare = F.when(~_is_object(raw) & ~_is_array(raw), raw)
        return _let(F.when(_is_object(raw), _json_map(raw)), lambda p: row(r, p, bare))

    def row(r: Column, p: Column, bare: Column) -> Column:
        url = F.coalesce(F.nullif(_first(p, URL_KEY), F.lit("")), bare, _first(r["m"], FIRST_POLICY_URL))
        fields = F.struct(
            r["record_no"].alias("record_no"),
            url.alias("url"),
            p["status_code"].try_cast("int").alias("status_code"),
            p["likeliness_score"].try_cast("double").alias("likeliness_score"),
            p["text_len"].try_cast("bigint").alias("text_len"),
            p["text_len_raw"].try_cast("bigint").alias("text_len_raw"),
            F.coalesce(p["extraction_method"], r["m"]["extractionMethod"]).alias("extraction_method"),
        )
        return F.filter(F.array(fields), lambda x: F.coalesce(x["url"] != "", F.lit(False)))

    return _inline(recs, id_col, rows)


def record_table(recs: DataFrame, id_col: str = "line_id") -> DataFrame:
    """One row per record: the parent table, with the fields that are no lists."""

    def row(r: Column) -> Column:
        m = r["m"]
        return F.struct(
            r["record_no"].alias("record_no"),
            m["rank"].try_cast("int").alias("rank"),
            F.coalesce(m["input"], m["site"]).alias("input"),
            m["site_url"].alias("site_url"),
            m["final_url"].alias("final_url"),
            F.coalesce(m["site_etld1"], m["site"]).alias("site_etld1"),
            m["status"].alias("status"),
            m["error_code"].alias("error_code"),
            m["error_message"].alias("error_message"),
            m["non_browsable_reason"].alias("non_browsable_reason"),
            m["home_status_code"].try_cast("int").alias("home_status_code"),
            m["total_ms"].try_cast("bigint").alias("total_ms"),
            m["run_id"].alias("run_id"),
            m["started_at"].alias("started_at"),
            m["ended_at"].alias("ended_at"),
        )

    return recs.select(id_col, F.inline(F.transform("recs", row)))


def category_table(recs: DataFrame, id_col: str = "line_id") -> DataFrame:
    """One row per category of a third party: the grandchild table, linked by (id, record_no, child_no)."""

    def rows(r: Column) -> Column:
        return F.flatten(
            F.transform(
                _children(r["m"], THIRD_PARTIES),
                lambda c: F.transform(
                    F.coalesce(F.from_json(c["m"]["categories"], "array<string>"), F.array().cast("array<string>")),
                    lambda k, i: F.struct(r["record_no"].alias("record_no"), c["child_no"].alias("child_no"), i.alias("category_no"), k.alias("category")),
                ),
            )
        )

    return _inline(recs, id_col, rows)


def flat_tables(df: DataFrame, id_col: str = "line_id", line_col: str = "line") -> dict[str, DataFrame]:
    """All flat tables by name: record, third_party, category, policy_fetch, first_party_policy."""
    recs = records(df, id_col, line_col)
    return {
        "record": record_table(recs, id_col),
        "third_party": third_party_table(recs, id_col),
        "category": category_table(recs, id_col),
        "policy_fetch": policy_fetch_table(recs, id_col),
        "first_party_policy": first_party_table(recs, id_col),
    }


def p2_found(lines: DataFrame) -> DataFrame:
    """line_id, record_no, child_kind, child_key: a distinct row per child with a key."""
    t = flat_tables(lines)
    kinds = (("third_party", "third_party_etld1"), ("policy_fetch", "third_party_etld1"), ("first_party_policy", "url"))
    parts = [t[k].select("line_id", "record_no", F.lit(k).alias("child_kind"), F.col(c).alias("child_key")) for k, c in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
