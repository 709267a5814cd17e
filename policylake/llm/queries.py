"""Queries of this subpackage: name -> function of (spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from policylake.llm import boilerplate, cooccur, entity_match, leakage, mixing, near_dup, residue, textform
from policylake.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nearly equal policy texts, and of addresses of one page."""
    return near_dup.p1_found(table(spark, d, "fetches"), table(spark, d, "third_parties"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of third-party domains that meet far more often than chance allows."""
    return cooccur.p3_found(table(spark, d, "results"))


P3_SQL = """
WITH r AS (SELECT DISTINCT result_id, third_parties AS tp FROM results WHERE result_id IS NOT NULL),
n AS (SELECT count(DISTINCT result_id) AS n FROM r),
x AS (SELECT DISTINCT result_id, nullif(regexp_replace(lower(trim(t.u.third_party_etld1)), '\\.+$', ''), '') AS k FROM r, (SELECT unnest(r.tp)) AS t(u)),
y AS (SELECT * FROM x WHERE k IS NOT NULL),
c AS (SELECT k, count(*) AS n FROM y GROUP BY k)
SELECT a.k AS etld1_a, b.k AS etld1_b
FROM y AS a JOIN y AS b ON a.result_id = b.result_id AND a.k < b.k JOIN c AS ca ON ca.k = a.k JOIN c AS cb ON cb.k = b.k, n
GROUP BY a.k, b.k, n.n, ca.n, cb.n
HAVING count(*) >= 5 AND count(*) >= n.n / 500.0 AND count(*) * n.n >= 3 * ca.n * cb.n
"""


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts and error messages that hold template residue, filler or an error page in place of content."""
    return residue.p4_found(table(spark, d, "fetches"), table(spark, d, "results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of fetched pages that are no part of the policy."""
    fetches = table(spark, d, "fetches")
    return boilerplate.p5_found(fetches, residue.residue_pages(fetches))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries of both knowledge bases that belong to one organisation."""
    return entity_match.p7_found(table(spark, d, "kb_radar"), table(spark, d, "kb_trackerdb"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, wholly or partly."""
    return leakage.p8_found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed corpus: every copy of a chosen document, with target and actual share of its source."""
    return mixing.p9_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts look the same but are stored differently."""
    return textform.same_look_pairs(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p3_found, p4_found, p5_found, p7_found, p8_found, p9_mix, p10_found)}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL}
