"""Problem 1: records that are the same but for small edits, by min-max hashing.

For each permutation both the smallest and the largest value over a record's shingles are kept, so a
signature of 2 k values costs k hash evaluations per shingle; minima and maxima agree with the same
probability, the Jaccard similarity, and their estimate has a lower variance than 2 k minima
(Ji et al., "Min-Max Hash for Jaccard Similarity", ICDM 2013). The values are banded; records that
share a band are candidates, and each candidate pair is then checked on the shingles themselves.

Scale: records of one shingle set are one class with one representative, so copies never meet each
other. One shuffle brings band keys together (8 + 8 bytes a band and record); the self-join of the
bands streams, nothing is collected into a group. Only representatives of candidate pairs fetch their
shingles. A pair of similarity s is a candidate with probability 1 - (1 - s^rows)^bands: with 96 bands of 5, as
used for policy texts, 0.953 at 0.5, 0.993 at 0.55, 0.9996 at 0.6, above 0.9999999 from 0.7 on; with the defaults of
32 bands of 8, made for a threshold of 0.8, 0.997 at 0.8 and 0.99998 at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.llm.words import WordHashes, mix, shingles, words
from policylake.session import cut

SIGNATURE = "id string, h1 bigint, h2 bigint, sh array<int>, bands array<bigint>"


def minmax_signature(sh: np.ndarray, perms: int, seed: int = 1) -> np.ndarray:
    """Minima, then maxima, of ``perms`` permutations of 32-bit fingerprints (at least one)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(1, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, perms, dtype=np.uint64)
    return _minmax(sh, a, b)


def _minmax(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lo = np.full(len(a), 2**64 - 1, np.uint64)
    hi = np.zeros(len(a), np.uint64)
    for i in range(0, len(sh), 4096):  # a very long text is hashed in pieces
        v = np.multiply.outer(a, sh[i : i + 4096].astype(np.uint64)) + b[:, None]
        np.minimum(lo, v.min(1), out=lo)
        np.maximum(hi, v.max(1), out=hi)
    return np.concatenate([lo, hi]) >> np.uint64(32)


def _signer(n: int, min_words: int, bands: int, rows: int, seed: int, whole_words: bool):
    """The mapInArrow function from (id, text) to SIGNATURE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(seed))
        perms = (bands * rows + 1) // 2
        a = rng.integers(1, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**63, perms, dtype=np.uint64)
        index = np.arange(bands, dtype=np.uint64) + np.uint64(1)
        hashes = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                out = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ws = t.split(" ") if whole_words else words(t)
                    if len(ws) < min_words:
                        continue
                    sh = shingles(hashes.array(ws), n)
                    if not len(sh):
                        continue
                    v = _minmax(sh, a, b)[: bands * rows].reshape(rows, bands)
                    key = index
                    for r in v:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r)
                    x = sh.astype(np.uint64)
                    h = mix(x * np.uint64(0xD6E8FEB86659FD93) + np.uint64(11)).sum(), (mix(x ^ np.uint64(0xA5A5A5A5)) * np.uint64(3)).sum()
                    out.append((i, *np.array(h, np.uint64).astype(np.int64).tolist(), sh.astype(np.int32), key.astype(np.int64)))
                if out:
                    c = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(c[0], pa.string()),
                            pa.array(c[1], pa.int64()),
                            pa.array(c[2], pa.int64()),
                            pa.ListArray.from_arrays(np.cumsum([0, *map(len, c[3])], dtype=np.int32), pa.array(np.concatenate(c[3]))),
                            pa.ListArray.from_arrays(np.cumsum([0, *map(len, c[4])], dtype=np.int32), pa.array(np.concatenate(c[4]))),
                        ],
                        names=["id", "h1", "h2", "sh", "bands"],
                    )

    return run


def near_duplicate_links(
    df: DataFrame,
    id_col: str,
    text_col: str,
    *,
    n: int = 5,
    threshold: float = 0.8,
    min_words: int = 1,
    bands: int = 32,
    rows: int = 8,
    seed: int = 1,
    whole_words: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Links between texts of similarity ``threshold`` or more, and the class of every record.

    Returns ``links(rep_a, rep_b, similarity)`` between representatives of different shingle sets, each
    pair once, and ``members(id, rep)`` with a row for each record that has a shingle; ids are strings and
    a class is represented by its smallest id (compared as strings). The similarity is the share of common
    distinct runs of ``n`` words. Records with a null id or text, with fewer than ``min_words`` words, or
    without a run of ``n`` words are in neither. Equal ids count as separate rows of one record. With
    ``whole_words`` the text is taken as words separated by single spaces, without lower-casing.
    """
    src = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    base = cut(src.mapInArrow(_signer(n, min_words, bands, rows, seed, whole_words), SIGNATURE), "minmax")
    reps = base.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = base.select("id", "h1", "h2").join(reps, ["h1", "h2"]).select("id", "rep").distinct()
    # One record of each class carries its bands; all records of a class have the same ones.
    of_rep = base.select("h1", "h2", "bands").dropDuplicates(["h1", "h2"])
    band = of_rep.select("h1", "h2", F.explode("bands").alias("band"))
    a = band.select("band", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    b = band.select("band", F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    pairs = a.join(b, "band").where("a1 < b1 or (a1 = b1 and a2 < b2)").select("a1", "a2", "b1", "b2").distinct()
    pairs = cut(pairs, "minmax-pairs")
    wanted = pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(pairs.select("b1", "b2")).distinct()
    sets = base.select("h1", "h2", "sh").join(wanted, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).join(reps, ["h1", "h2"])
    common = F.size(F.array_intersect("sa", "sb"))
    links = (
        pairs.join(sets.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("sh").alias("sa"), F.col("rep").alias("ra")), ["a1", "a2"])
        .join(sets.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("sh").alias("sb"), F.col("rep").alias("rb")), ["b1", "b2"])
        .select("ra", "rb", common.alias("x"), (F.size("sa") + F.size("sb")).alias("y"))
        .where(F.col("x") >= F.lit(threshold) * (F.col("y") - F.col("x")))
        .select(F.least("ra", "rb").alias("rep_a"), F.greatest("ra", "rb").alias("rep_b"), (F.col("x") / (F.col("y") - F.col("x"))).alias("similarity"))
    )
    return links, members


def near_duplicate_pairs(links: DataFrame, members: DataFrame, numeric: bool = False) -> DataFrame:
    """All pairs (key_a, key_b) of records that are linked or in one class; smaller key first, as numbers if ``numeric``.

    Its size is that of the result; use ``links`` and ``members`` where copies need not be listed.
    """
    ma, mb = (members.select(F.col("rep").alias(f"rep_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    both = links.select("rep_a", "rep_b").join(ma, "rep_a").join(mb, "rep_b").select("id_a", "id_b")
    within = members.groupBy("rep").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    ma, mb = (members.join(within, "rep", "left_semi").select("rep", F.col("id").alias(f"id_{x}")) for x in "ab")
    same = ma.join(mb, "rep").where("id_a < id_b").select("id_a", "id_b")
    pairs = both.unionByName(same)
    first = F.col("id_a").cast("bigint") < F.col("id_b").cast("bigint") if numeric else F.col("id_a") < F.col("id_b")
    return pairs.select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("key_a"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("key_b"))


def near_duplicate_classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: ``id, group_id`` (smallest representative it is connected to) and ``n_links`` of its class.

    Connected components by repeated minimum over neighbours with pointer jumping; every round is a written
    table; the rounds end when no label changes, and their number grows with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")), "cc-edges")
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(members.select(F.col("rep").alias("a")).distinct().withColumn("g", F.col("a")), "cc")
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("g").alias("gb")), "b").groupBy("a").agg(F.min("gb").alias("m"))
        step = labels.join(near, "a", "left").select("a", "g", F.least("g", F.coalesce("m", "g")).alias("n"))
        jump = step.select(F.col("a").alias("n"), F.col("n").alias("nn"))
        step = cut(step.join(jump, "n", "left").select("a", "g", F.least("n", F.coalesce("nn", "n")).alias("n")), "cc")
        if step.where("n <> g").isEmpty():
            break
        labels = step.select("a", F.col("n").alias("g"))
    count = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    return (
        members.join(labels, members["rep"] == labels["a"])
        .join(count, "a", "left")
        .select("id", F.col("g").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


# Query parameters that name where a visitor came from, not a page.
TRACKING = ("ref", "fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "yclid", "igshid")
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def url_words(url, www: bool = False) -> Column:
    """A URL column as space-separated words that are the same for every way of writing one page's address.

    Scheme, letter case of the host, default port, user part, fragment, repeated and final slashes, percent
    signs before unreserved characters, tracking parameters and the order of parameters are no difference;
    everything else is. A leading ``www.`` of the host is a difference with ``www``, and none without it.
    NULL where there is no host.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^(?i:https?):/*|^//", "")
    host = F.regexp_extract(u, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(host, "^.*@", "")), r":(80|443)?$|\.+$", "")
    host = F.regexp_replace(host, r"\.+$", "")
    if not www:
        host = F.regexp_replace(host, r"^www\.(?=.)", "")
    path = F.regexp_extract(u, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(u, r"\?(.*)$", 1)

    pieces = F.filter(F.split(path, "/"), lambda x: x != "")
    pieces = F.transform(pieces, lambda x, i: F.concat(F.lit("/"), i.cast("string"), F.lit("="), _unescape(x)))
    params = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.split_part(x, F.lit("="), F.lit(1))).isin(*TRACKING) & ~F.lower(x).startswith("utm_"))
    params = F.array_sort(F.transform(params, lambda x: F.concat(F.lit("?"), _unescape(x))))
    allw = F.concat(F.array(F.concat(F.lit("//"), host)), pieces, params)
    return F.when(host != "", F.array_join(F.transform(allw, lambda x: F.replace(x, F.lit(" "), F.lit("%20"))), " "))


def _unescape(col) -> Column:
    """Percent-escapes of unreserved characters undone, the others in upper case."""
    parts = F.split(col, "%")

    def piece(p, i):
        code = F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
        ok = (i > 0) & p.rlike("^[0-9A-Fa-f]{2}")
        ch = F.char(code)
        plain = ok & F.lit(UNRESERVED).contains(ch) & (ch != "")
        escaped = F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2)), F.substring(p, F.lit(3), F.length(p)))
        return F.when(plain, F.concat(ch, F.substring(p, F.lit(3), F.length(p)))).when(ok, escaped).when(i > 0, F.concat(F.lit("%"), p)).otherwise(p)

    return F.array_join(F.transform(parts, piece), "")


def same_page_urls(df: DataFrame, url_col: str, www: bool = False) -> DataFrame:
    """Pairs (key_a < key_b in byte order) of different strings in ``url_col`` that lead to one page.

    The same min-max operator over the words of the address (one-word runs, whole similarity): addresses of
    one page have one signature, so a single band of all values finds them; equal word sets are one class.
    Without ``www`` a host and its ``www.`` name are one host.
    """
    urls = df.select(F.col(f"`{url_col}`").alias("u")).where("u is not null and u <> ''").distinct()
    links, members = near_duplicate_links(urls.select("u", url_words(F.col("u"), www).alias("w")), "u", "w", n=1, threshold=1.0, bands=1, rows=16, whole_words=True)
    return near_duplicate_pairs(links, members)


def p1_found(fetches: DataFrame, third_parties: DataFrame) -> DataFrame:
    """kind, key_a, key_b: pairs of nearly equal policy texts and of addresses of one page."""
    links, members = near_duplicate_links(fetches, "fetch_id", "text", n=3, threshold=0.5, min_words=80, bands=96, rows=5)
    texts = near_duplicate_pairs(links, members, numeric=True).select(F.lit("text").alias("kind"), "key_a", "key_b")
    urls = same_page_urls(third_parties, "policy_url").select(F.lit("policy_url").alias("kind"), "key_a", "key_b")
    return texts.unionByName(urls).distinct()
