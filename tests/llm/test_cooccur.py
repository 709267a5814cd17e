from collections import Counter
from itertools import combinations
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from policylake.llm import cooccur as C


@pytest.mark.parametrize(("n_items", "block", "records", "flush", "dense"), [(12, 512, 8192, 10**6, 1 / 64), (40, 8, 16, 10**6, 0.0), (40, 8, 16, 50, 2.0), (40, 8, 7, 50, 0.2)])
def test_blocked_gram(monkeypatch, n_items, block, records, flush, dense):
    for k, v in (("ITEM_BLOCK", block), ("RECORD_BLOCK", records), ("FLUSH", flush), ("DENSE", dense)):
        monkeypatch.setattr(C, k, v)
    rng = random.Random(1)
    rows = [rng.sample(range(n_items), rng.randrange(0, min(n_items, 12))) for _ in range(200)] + [list(range(n_items))]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + 30], pa.list_(pa.int64()))], names=["ks"]) for i in range(0, len(rows), 30)]
    got = Counter()
    for b in C._gram(iter(batches)):
        for i, j, n in zip(*(b.column(k).to_pylist() for k in range(3))):
            got[i, j] += n
    assert got == Counter(p for r in rows for p in combinations(sorted(r), 2))


def test_pair_lift(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 5))] + (["x", "y"] if i % 9 == 0 else [])) for i in range(300)]
    rows += [(5, rows[5][1]), (None, ["a", "b"]), (301, None), (302, []), (303, [None, "a", "a"])]
    d = spark.createDataFrame(rows, "id bigint, items array<string>").withColumn("item", F.lit("clash"))
    want = {}
    sets = {}
    for i, xs in rows:
        if i is not None:
            sets.setdefault(i, set()).update(x for x in xs or [] if x)
    n = Counter(x for s in sets.values() for x in s)
    pairs = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    want = {(a, b): (k, n[a], n[b], len(sets)) for (a, b), k in pairs.items() if k >= 10}
    got = {(r["item_a"], r["item_b"]): (r["n"], r["n_a"], r["n_b"], r["n_records"]) for r in C.pair_lift(d, "id", F.col("items"), min_count=10, min_share=0.001).collect()}
    assert got == want
    assert C.pair_lift(d.limit(0), "id", F.col("items")).count() == 0
    r = C.pair_lift(d, "id", F.col("items"), min_count=10).where("item_a = 'x'").first()
    assert r["lift"] == pytest.approx(r["n"] * r["n_records"] / (r["n_a"] * r["n_b"]))
