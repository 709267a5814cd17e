"""Problem 8: passages of evaluation items inside documents, by greedy string tiling.

Texts are brought to the consistent form of problem 10, case-folded and cut into words. A run of ``min_run``
words always holds a whole block of ``min_run // 2 + 1`` words that starts at a multiple of that length, so a
document looks up only these blocks among all word runs of the items (the seeds). For each (document, item)
that shares a seed, maximal matches are found with Karp-Rabin fingerprints of ``min_run`` words, and the longest
non-overlapping ones are marked first, again and again (Wise, "YAP3", 1996), so that reordered pieces of a
passage count too.

The items are a stated query set. Up to MAX_ITEMS they are sent to every task; above that they are joined by
seed, and no list is sent. Documents are read once, without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm.textform import canonical
from policylake.llm.words import WORD
from policylake.session import bounded_rows

MAX_ITEMS = 20_000
LEAK = "doc_id bigint, item_id bigint, n_tiles int, longest_run int, covered_words int, coverage double"


def passage_words(text: str) -> list[str]:
    """Words for comparison: regardless of case, punctuation, spacing, line breaks and character differences."""
    return WORD.findall(canonical(text).casefold())


def greedy_tiles(doc: list[str], item: list[str], min_run: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (start in doc, start in item, length >= min_run), longest first."""
    free_d, free_i = [True] * len(doc), [True] * len(item)
    tiles: list[tuple[int, int, int]] = []
    prints: dict[int, list[int]] = defaultdict(list)
    for j, h in _fingerprints(item, min_run):
        prints[h].append(j)
    seeds = [(i, j) for i, h in _fingerprints(doc, min_run) for j in prints.get(h, ())]
    while True:
        found = []
        for i, j in seeds:
            if not (free_d[i] and free_i[j]):
                continue
            if i and j and free_d[i - 1] and free_i[j - 1] and doc[i - 1] == item[j - 1]:
                continue  # not the start of a maximal match
            k = 0
            while i + k < len(doc) and j + k < len(item) and free_d[i + k] and free_i[j + k] and doc[i + k] == item[j + k]:
                k += 1
            if k >= min_run:
                found.append((-k, i, j))
        if not found:
            return tiles
        found.sort()
        for k, i, j in found:
            k = -k
            if all(free_d[i : i + k]) and all(free_i[j : j + k]):
                free_d[i : i + k] = [False] * k
                free_i[j : j + k] = [False] * k
                tiles.append((i, j, k))
        seeds = [(i, j) for i, j in seeds if free_d[i] and free_i[j]]
        # A match cut by a marked one may start inside it: every free seed is tried again.


_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _fingerprints(ws: list[str], n: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin fingerprints of all runs of ``n`` words; equal ones are compared word by word later."""
    hs = [hash(w) % _MOD for w in ws]
    if len(hs) < n:
        return
    top, h = pow(_BASE, n - 1, _MOD), 0
    for x in hs[:n]:
        h = (h * _BASE + x) % _MOD
    yield 0, h
    for i in range(n, len(hs)):
        h = ((h - hs[i - n] * top) * _BASE + hs[i]) % _MOD
        yield i - n + 1, h


def _scan(items, min_run: int, min_coverage: float):
    """The mapInArrow function from (doc_id, text) to LEAK, with the items at hand."""
    block = min_run // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By place, not by id: an item may have several passages.
        texts = [(i, passage_words(p)) for i, p in items.value]
        seeds: dict[tuple, set] = defaultdict(set)
        for n, (_, ws) in enumerate(texts):
            for k in range(len(ws) - block + 1):
                seeds[tuple(ws[k : k + block])].add(n)
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = passage_words(t)
                hit: set = set()
                for k in range(0, len(ws) - block + 1, block):
                    s = seeds.get(tuple(ws[k : k + block]))
                    if s:
                        hit |= s
                out += [x for n in sorted(hit) if (x := _leak(d, ws, *texts[n], min_run, min_coverage))]
            if out:
                yield _batch(out)

    return run


def _leak(d: int, ws: list[str], i: int, item: list[str], min_run: int, min_coverage: float):
    tiles = greedy_tiles(ws, item, min_run)
    covered = sum(k for _, _, k in tiles)
    if tiles and covered >= min_coverage * len(item):
        return d, i, len(tiles), max(k for _, _, k in tiles), covered, covered / len(item)
    return None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in LEAK.split(", ")])


def leaks(documents: DataFrame, items: DataFrame, *, min_run: int = 13, min_coverage: float = 0.0, max_items: int = MAX_ITEMS) -> DataFrame:
    """Documents and the items whose passage they hold, wholly or partly.

    One row per (doc_id, item_id) with at least one tile of ``min_run`` words and tiles over at least
    ``min_coverage`` of the passage: number of tiles, longest run, words covered and their share. Null or empty
    texts, passages shorter than ``min_run`` words and null ids match nothing. Repeated rows are reported once;
    of several passages of one item each is searched, and the one with the largest share covered is reported.
    """
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null and text <> ''")
    src = items.select("item_id", "passage").where("item_id is not null and passage is not null").distinct()
    rows = bounded_rows(src, max_items)
    if rows is not None:
        sent = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
        return _best(docs.mapInArrow(_scan(sent, min_run, min_coverage), LEAK))
    return _best(_joined(docs, src, min_run, min_coverage))


def _best(found: DataFrame) -> DataFrame:
    """One row per document and item: of several passages the one with the largest share covered."""
    best = F.max(F.struct("coverage", "covered_words", "longest_run", "n_tiles")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[f"best.{c}" for c in ("n_tiles", "longest_run", "covered_words", "coverage")])


def _joined(docs: DataFrame, items: DataFrame, min_run: int, min_coverage: float) -> DataFrame:
    """The same result for any number of items: seeds are joined, then only the pairs found are tiled."""
    block = min_run // 2 + 1

    def seeds_of(stride: int):
        def run(batches):
            for b in batches:
                ids, keys = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ws = passage_words(t)
                    ks = {" ".join(ws[k : k + block]) for k in range(0, len(ws) - block + 1, stride)}
                    ids += [i] * len(ks)
                    keys += ks
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["id", "seed"])

        return run

    def key(c):
        return [F.xxhash64(c).alias("s1"), F.xxhash64(F.lit(3), c).alias("s2")]

    sd = docs.mapInArrow(seeds_of(block), "id bigint, seed string").select(F.col("id").alias("doc_id"), *key("seed"))
    si = items.mapInArrow(seeds_of(1), "id bigint, seed string").select(F.col("id").alias("item_id"), *key("seed"))
    pairs = sd.join(si, ["s1", "s2"]).select("doc_id", "item_id").distinct()

    def tile(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(4)))
            out = [x for d, i, t, p in rows if (x := _leak(d, passage_words(t), i, passage_words(p), min_run, min_coverage))]
            if out:
                yield _batch(out)

    both = pairs.join(docs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "passage")
    return both.mapInArrow(tile, LEAK)


def p8_found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id, item_id: documents that hold a run of 13 or more words of an item's passage."""
    return leaks(documents, eval_items).select("doc_id", "item_id")
