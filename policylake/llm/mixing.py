"""Problem 9: mixing sources to target weights by Poisson replication.

Each document is repeated a number of times drawn from a Poisson distribution by inverting its distribution
function at a number hashed from the document's id and a seed. The distribution is censored at the source's cap,
and its rate is chosen so that the mean after censoring is the rate the target needs; a source that needs its
cap takes every document exactly that often. Counts depend on nothing but id, seed and rate, so a lost task
yields the same rows again.

Only the per-source sums (one row per target source) are brought together; documents are counted once and
written with their counts, then each row is exploded in place. The global shuffle places every copy by a hash, so
no source or site gathers in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.session import bounded_rows, cut

#: Where the public tokenizers' vocabulary files lie, unless a path is given.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the byte-level vocabulary cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_TARGETS = 10_000


def load_encoding(path: str):
    """The tokenizer of a .tiktoken rank file."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(path)
        for b in batches:
            n = [0 if t is None else len(enc.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, b.column(2)] if with_text else columns, names=["doc_id", "source", "n_tokens", *(["text"] if with_text else [])])

    return run


def count_tokens(documents: DataFrame, path: str = TOKENIZER, with_text: bool = False) -> DataFrame:
    """doc_id, source, n_tokens of every document, and its text if asked for; null and empty texts have 0."""
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_counter(path, with_text), "doc_id bigint, source string, n_tokens bigint" + (", text string" if with_text else ""))


def censored_mean(lam: float, cap: int) -> float:
    """Mean of min(Poisson(lam), cap)."""
    p, total, below = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        total += k * p
        below += p
        p *= lam / (k + 1)
    return total + cap * max(0.0, 1 - below)


def poisson_steps(rate: float, cap: int) -> list[float]:
    """Distribution function at 0 .. cap - 1 of the censored Poisson with mean ``rate``; a count is how many of them a uniform number reaches.

    A rate of the cap or more gives the cap always (all steps 0), a rate of 0 none (all steps 1).
    """
    if rate >= cap:
        return [0.0] * cap
    if rate <= 0:
        return [1.0] * cap
    lo, hi = 0.0, 1.0
    while censored_mean(hi, cap) < rate and hi < 600:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if censored_mean(mid, cap) < rate else (lo, mid)
    lam, p, f, out = hi, math.exp(-hi), 0.0, []
    for k in range(cap):
        f += p
        out.append(min(1.0, f))
        p *= lam / (k + 1)
    return out


def plan_rates(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> tuple[float, dict[str, float]]:
    """The total size and each source's mean repetition.

    Without ``total`` the largest size is taken at which no source needs more than its cap, so that every share
    can be reached. With a larger ``total`` a source at its cap falls short, which the report shows.
    """
    share = sum(s for _, s, _ in targets if s and s > 0)
    use = [(n, s / share, c) for n, s, c in targets if s and s > 0 and sizes.get(n, 0) > 0 and c and c > 0]
    if not use:
        return 0.0, {}
    if total is None:
        total = min(c * sizes[n] / s for n, s, c in use)
    return total, {n: min(float(c), s * total / sizes[n]) for n, s, c in use}


def mix(documents: DataFrame, targets: DataFrame, *, tokenizer: str = TOKENIZER, total_tokens: float | None = None, seed: int = 0, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mixed corpus and its report.

    ``mixed(doc_id, source, copy_no, n_tokens, place[, text])``: a row for each copy of a chosen document, in random order:
    sorted by ``place`` inside each part, parts cut by a hash of the copy. ``report(source, target_share, max_repeats,
    source_tokens, mean_repeats, mixed_tokens, n_copies, actual_share)``: one row per target source.
    Documents of no target source, without a source or without an id, and empty ones are not chosen. Rows of one doc_id
    are copied equally often, each with its own text. A source without documents gets nothing, its share goes to none.
    """
    spark = documents.sparkSession
    rows = bounded_rows(targets.select("source", "target_share", "max_repeats").where("source is not null"), MAX_TARGETS)
    if rows is None:
        raise ValueError("mix: more target sources than MAX_TARGETS")
    plan = [(r[0], float(r[1] or 0.0), int(r[2] or 0)) for r in rows]
    # The text goes along in the written table: a join by id would multiply repeated ids and move all texts once more.
    counted = cut(count_tokens(documents, tokenizer, with_text), "tokens").where("doc_id is not null and n_tokens > 0")
    names = spark.createDataFrame([(n,) for n, _, _ in plan], "source string").distinct()
    sums = counted.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("s"))
    sizes = {r["source"]: r["s"] for r in sums.collect()}  # at most one row per target source
    total, rates = plan_rates(sizes, plan, total_tokens)
    caps = {n: c for n, _, c in plan}
    steps = spark.createDataFrame([(n, poisson_steps(r, caps[n])) for n, r in rates.items()], "source string, steps array<double>")
    # 53 bits of a hash of (seed, id), as a number in [0, 1).
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") * F.lit(2.0**-53)
    chosen = counted.join(F.broadcast(steps), "source").withColumn("u", u)
    chosen = chosen.withColumn("n_copies", F.size(F.filter("steps", lambda s: s <= F.col("u")))).where("n_copies > 0").select("doc_id", "source", "n_tokens", "n_copies", *(["text"] if with_text else []))
    done = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("mixed_tokens"), F.sum("n_copies").alias("n_copies"))
    base = spark.createDataFrame([(n, s, c, sizes.get(n, 0), rates.get(n, 0.0)) for n, s, c in plan], "source string, target_share double, max_repeats int, source_tokens bigint, mean_repeats double")
    report = base.join(done, "source", "left").fillna(0, ["mixed_tokens", "n_copies"])
    whole = report.agg(F.sum("mixed_tokens").alias("w"))
    report = report.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("w") > 0, F.col("mixed_tokens") / F.col("w")).otherwise(F.lit(0.0))).drop("w")
    copies = chosen.select("*", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no")).drop("n_copies")
    copies = copies.withColumn("place", F.xxhash64(F.lit(seed), F.lit("place"), "doc_id", "copy_no"))
    mixed = copies.repartition("place").sortWithinPartitions("place")
    return mixed.select("doc_id", "source", "copy_no", "n_tokens", "place", *(["text"] if with_text else [])), report


def p9_mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Every copy of the mix with its text, and the share its source was to have and really has."""
    mixed, report = mix(documents, targets, with_text=True)
    return mixed.join(F.broadcast(report.select("source", "target_share", "actual_share")), "source")
