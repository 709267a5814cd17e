"""Problem 3: items that appear together, by a blocked Gram matrix.

Baskets are the rows of a binary sparse matrix X, cut into blocks of items (columns) and blocks of records (rows). The
Gram matrix X'X is the sum over record blocks of the transpose-products of item blocks, X_I' X_J for I <= J. Items are numbered by
falling frequency, so the first blocks are dense and the others sparse: a task keeps, for each pair of item blocks, the records of its
block as bit matrices and multiplies them when they are full; a pair of blocks that is nearly empty is multiplied as lists
of (row, column). Partial sums of a block pair are added up inside a task, flushed when they are many, and added up across tasks by one
aggregation on (i, j). Counts are then divided by the counts expected from the marginals.

A pair can reach ``min_share`` of the records only if both items do, so rarer items are left out before the
product without losing a pair. Item numbers are joined to the baskets; no list of items goes to the driver or to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.session import cut

#: Items of a block, records of a block, and entries of partial sums a task keeps before it passes them on.
ITEM_BLOCK, RECORD_BLOCK, FLUSH = 512, 8192, 4_000_000
#: A block of records with a larger share of ones than this is multiplied as a dense matrix.
DENSE = 1 / 64


def tidy_domain(c: Column) -> Column:
    """Trimmed, lower-cased, without final dots; NULL where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"\.+$", ""), F.lit(""))


def baskets(df: DataFrame, id_col: str, items: Column) -> DataFrame:
    """``id, items``: the distinct non-null items of each distinct id, repeated rows of an id merged; may be empty.

    Rows without an id are left out. The merge keeps sets, so a record delivered many times stays small.
    """
    d = df.select(F.col(f"`{id_col}`").alias("id"), F.array_distinct(F.coalesce(items, F.array())).alias("items")).where("id is not null")
    return d.select("id", F.explode_outer("items").alias("item")).groupBy("id").agg(F.collect_set("item").alias("items"))


def block_product(rows_i: np.ndarray, cols_i: np.ndarray, rows_j: np.ndarray, cols_j: np.ndarray, n_rows: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """X_I' X_J of one block of records: codes column_i * ITEM_BLOCK + column_j with a count above 0, and the counts.

    ``rows``, ``cols`` are the places of the ones, by rising row. With ``same`` (I = J) only i < j is returned.
    """
    if len(cols_i) > DENSE * n_rows * ITEM_BLOCK and len(cols_j) > DENSE * n_rows * ITEM_BLOCK:
        x, y = np.zeros((n_rows, ITEM_BLOCK), np.float32), np.zeros((n_rows, ITEM_BLOCK), np.float32)
        x[rows_i, cols_i] = 1
        y[rows_j, cols_j] = 1
        g = x.T @ y  # exact: counts are at most RECORD_BLOCK
        if same:
            g = np.triu(g, 1)
        i, j = np.nonzero(g)
        return (i * ITEM_BLOCK + j).astype(np.int64), g[i, j].astype(np.int64)
    # Sparse times sparse: every one of X_I meets the ones of X_J in its row.
    start = np.searchsorted(rows_j, rows_i, "left")
    many = np.searchsorted(rows_j, rows_i, "right") - start
    codes = []
    ends = np.cumsum(many)
    at = 0
    while at < len(many):  # in pieces of bounded size, a very long record too
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FLUSH, "right")))
        m = many[at:to]
        left = np.repeat(np.arange(at, to), m)
        right = np.repeat(start[at:to] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        i, j = cols_i[left], cols_j[right]
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        codes.append(np.unique(i.astype(np.int64) * ITEM_BLOCK + j, return_counts=True))
        at = to
    return _add(codes)


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several sparse blocks."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
    u, inv = np.unique(codes, return_inverse=True)
    return u, np.bincount(inv, counts, len(u)).astype(np.int64)


def record_block(rows: np.ndarray, items: np.ndarray, n_rows: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(I, J, codes, counts) of every pair of item blocks that a block of records fills; ``items`` are numbers, by rising row."""
    block = items // ITEM_BLOCK
    held = {int(k): (rows[block == k], items[block == k] % ITEM_BLOCK) for k in np.unique(block)}
    for x, (ri, ci) in held.items():
        for y, (rj, cj) in held.items():
            if x <= y:
                codes, counts = block_product(ri, ci, rj, cj, n_rows, x == y)
                if len(codes):
                    yield x, y, codes, counts


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Baskets of item numbers -> partial sums (i, j, n) of the Gram matrix."""
    sums: dict[tuple[int, int], list] = {}
    waiting: list[tuple[np.ndarray, np.ndarray, int]] = []

    def emit():
        for (x, y), parts in sums.items():
            codes, counts = _add(parts)
            for s in range(0, len(codes), 1 << 16):
                c = codes[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(c // ITEM_BLOCK + x * ITEM_BLOCK), pa.array(c % ITEM_BLOCK + y * ITEM_BLOCK), pa.array(counts[s : s + (1 << 16)])], names=["i", "j", "n"])
        sums.clear()

    def multiply():
        at = np.cumsum([0] + [n for _, _, n in waiting])
        rows = np.concatenate([r + a for (r, _, _), a in zip(waiting, at)])
        items = np.concatenate([i for _, i, _ in waiting])
        n_rows = int(at[-1])
        waiting.clear()
        for x, y, codes, counts in record_block(rows, items, n_rows):
            sums.setdefault((x, y), []).append((codes, counts))
        for k, parts in sums.items():
            sums[k] = [_add(parts)]

    for b in batches:
        lists = b.column(0)
        for s in range(0, len(lists), RECORD_BLOCK):
            piece = lists.slice(s, RECORD_BLOCK)
            items = piece.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            waiting.append((np.repeat(np.arange(len(piece)), pa.compute.list_value_length(piece).to_numpy(zero_copy_only=False)), items, len(piece)))
            if sum(n for _, _, n in waiting) + RECORD_BLOCK > 2 * RECORD_BLOCK or sum(len(i) for _, i, _ in waiting) > FLUSH:
                multiply()
                if sum(len(p[0][0]) for p in sums.values()) > FLUSH:
                    yield from emit()
    if waiting:
        multiply()
    yield from emit()


def pair_lift(df: DataFrame, id_col: str, items: Column, *, min_count: int = 5, min_share: float = 1 / 500) -> DataFrame:
    """``item_a, item_b, n, n_a, n_b, n_records, lift`` for every pair in at least ``min_count`` and ``min_share`` of the records.

    ``item_a < item_b`` in byte order; ``lift`` is n N / (n_a n_b). Records are distinct ids, empty ones included.
    An empty table has no pair.
    """
    b = cut(baskets(df, id_col, items), "baskets")
    total = b.count()
    least = max(min_count, math.ceil(total * min_share - 1e-9), 1)
    counts = b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).where(F.col("n_item") >= least)
    ref = cut(numbered(counts), "items")
    inside = b.select("id", F.explode("items").alias("item")).join(ref.select("item", "k"), "item").groupBy("id").agg(F.collect_list("k").alias("ks")).where("size(ks) > 1")
    gram = inside.select("ks").mapInArrow(_gram, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ri, rj = (ref.select(F.col("k").alias(x), F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}")) for x in "ij")
    first = F.col("item_i") < F.col("item_j")
    pairs = gram.join(ri, "i").join(rj, "j").select(
        F.least("item_i", "item_j").alias("item_a"), F.greatest("item_i", "item_j").alias("item_b"), "n",
        F.when(first, F.col("n_i")).otherwise(F.col("n_j")).alias("n_a"), F.when(first, F.col("n_j")).otherwise(F.col("n_i")).alias("n_b"),
    ).withColumn("n_records", F.lit(total).cast("bigint"))
    return pairs.withColumn("lift", F.col("n") * F.col("n_records") / (F.col("n_a") * F.col("n_b")))


def numbered(counts: DataFrame) -> DataFrame:
    """``item, n_item, k``: items numbered from 0 by falling frequency, whatever their number.

    A range sort and the sizes of its parts; only the sizes, one number a part, come to the driver.
    """
    spark = counts.sparkSession
    parts = counts.repartitionByRange(F.col("n_item").desc(), F.col("item")).sortWithinPartitions(F.col("n_item").desc(), F.col("item"))
    parts = cut(parts.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)), "item-order")
    sizes = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, start))
        start += sizes[p]
    return parts.join(F.broadcast(spark.createDataFrame(offsets, "part int, first bigint")), "part").select("item", "n_item", (F.col("at") + F.col("first")).alias("k"))


def third_party_pairs(results: DataFrame) -> DataFrame:
    """Pairs of third-party domains and how far they exceed chance."""
    return pair_lift(results, "result_id", F.transform("third_parties", lambda t: tidy_domain(t["third_party_etld1"])))


def p3_found(results: DataFrame, least_lift: int = 3) -> DataFrame:
    """etld1_a, etld1_b: pairs of domains on at least three times as many sites as chance allows."""
    p = third_party_pairs(results).where(F.col("n") * F.col("n_records") >= least_lift * F.col("n_a") * F.col("n_b"))
    return p.select(F.col("item_a").alias("etld1_a"), F.col("item_b").alias("etld1_b"))
