"""Problem 6: results per key where a few keys hold most of the rows.

Heavy keys are found with frequent-items sketches: one for each of SKETCH_PARTS parts of the rows, then their items added
up, so that no task merges the sketches of all tasks. The sketch's bound makes a key with the share looked for a candidate in at
least one part, whatever the number of keys. Rows of heavy keys are told apart with a broadcast of the key list, whose size is
bounded by SKETCH_PARTS / share, and are aggregated in two steps over ``salts`` slices; slices are cut by a hash of the record
id, so even distinct counts add up. The remaining keys take the ordinary shuffle, and both results are united. No row is
dropped and no task holds a heavy key's rows. Which way a key takes changes no figure: all of them are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of the rows that have a sketch of their own.
SKETCH_PARTS = 16


def tidy_domain(c: Column) -> Column:
    """Trimmed, lower-cased, without final dots; NULL where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"\.+$", ""), F.lit(""))


def tidy_name(c: Column) -> Column:
    """Trimmed and lower-cased; NULL where nothing is left."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def heavy_keys(keys: DataFrame, key_col: str, share: float, parts: int = SKETCH_PARTS) -> DataFrame:
    """Keys that hold at least ``share`` of the rows of ``keys``, from sketches; at most ``2 * parts / share`` rows.

    A key with ``share`` of all rows has at least that share of one part, and the sketch of a part overestimates by at most its rows /
    counters, with ten counters for each key that can be heavy: none is missed, and what is reported has about nine tenths of the share in a part.
    Null keys count as rows and are no keys.
    """
    most = max(1, math.ceil(1 / share))
    k, counters = min(10_000, 2 * most), min(1_000_000, max(1000, 10 * most))
    part = F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part")
    top = keys.select(key_col, part).groupBy("part").agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(`{key_col}`, {k}, {counters})").alias("top"))
    items = top.select("total", F.explode("top").alias("e")).select("total", F.col("e.item").alias(key_col), F.col("e.count").alias("c"))
    return items.where(F.col(key_col).isNotNull() & (F.col("c") >= F.lit(0.9 * share) * F.col("total"))).select(key_col).distinct()


def per_key_results(df: DataFrame, key_col: str, id_col: str, *, heavy_share: float = 0.005, salts: int = 64, site_col: str | None = None, time_col: str | None = None) -> DataFrame:
    """Results per key without long tasks: ``key_value, heavy, n_rows, n_ids`` and, if asked for, ``n_sites, first_at, last_at``.

    ``n_ids`` counts distinct ids, ``n_sites`` distinct values of ``site_col``. Rows with a null key are in no
    result. An empty table gives an empty result. ``heavy`` says which way a key's rows took.
    """
    cols = [F.col(f"`{key_col}`").alias("k"), F.col(f"`{id_col}`").alias("i")]
    cols += [F.col(f"`{site_col}`").alias("s")] if site_col else []
    cols += [F.col(f"`{time_col}`").alias("t")] if time_col else []
    d = df.select(*cols)
    heavy = heavy_keys(d.select("k"), "k", heavy_share)
    d = d.where("k is not null").join(F.broadcast(heavy.withColumn("h", F.lit(True))), "k", "left")
    times = [F.min("t").alias("first_at"), F.max("t").alias("last_at")] if time_col else []
    again = [F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")] if time_col else []

    # Ordinary keys.
    light = d.where("h is null").groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("i").alias("n_ids"), *times)
    # Heavy keys: slices by id, then their sums.
    salt = F.pmod(F.xxhash64("i"), F.lit(salts)).alias("salt")
    part = d.where("h").groupBy("k", salt).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("i").alias("n_ids"), *times)
    full = part.groupBy("k").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_ids").alias("n_ids"), *again)
    out = light.withColumn("heavy", F.lit(False)).unionByName(full.withColumn("heavy", F.lit(True)))
    if site_col:
        ls = d.where("h is null").groupBy("k").agg(F.count_distinct("s").alias("n_sites"))
        hs = d.where("h").groupBy("k", F.pmod(F.xxhash64("s"), F.lit(salts)).alias("salt")).agg(F.count_distinct("s").alias("n"))
        hs = hs.groupBy("k").agg(F.sum("n").alias("n_sites"))
        out = out.join(ls.unionByName(hs), "k")
    names = ["n_rows", "n_ids", *(["n_sites"] if site_col else []), *(["first_at", "last_at"] if time_col else [])]
    return out.select(F.col("k").alias("key_value"), "heavy", *names)


def third_party_key_results(third_parties: DataFrame) -> DataFrame:
    """Results per third_party_etld1 and per entity: ``field`` and the columns of per_key_results."""
    d = third_parties.select(
        "obs_id", tidy_domain(F.col("third_party_etld1")).alias("third_party_etld1"), tidy_name(F.col("entity")).alias("entity"), tidy_domain(F.col("site_etld1")).alias("site_etld1"), "observed_at"
    )
    parts = [per_key_results(d, f, "obs_id", site_col="site_etld1", time_col="observed_at").select(F.lit(f).alias("field"), "*") for f in ("third_party_etld1", "entity")]
    return parts[0].unionByName(parts[1])


def p6_found(third_parties: DataFrame, share: float = 0.02) -> DataFrame:
    """field, key_value: keys that hold at least ``share`` of all distinct observations."""
    d = third_parties.select("obs_id", tidy_domain(F.col("third_party_etld1")).alias("third_party_etld1"), tidy_name(F.col("entity")).alias("entity"))
    parts = [per_key_results(d, f, "obs_id", heavy_share=share / 4).select(F.lit(f).alias("field"), "key_value", "n_ids") for f in ("third_party_etld1", "entity")]
    total = d.agg(F.count_distinct("obs_id").alias("total"))
    # One row: its size does not depend on the data.
    return parts[0].unionByName(parts[1]).crossJoin(F.broadcast(total)).where(F.col("n_ids") >= F.lit(share) * F.col("total")).select("field", "key_value")
