import random

from policylake.llm import leakage as L


def test_greedy_tiles():
    item = [f"w{i}" for i in range(40)]
    doc = ["a"] + item[20:40] + ["b"] + item[0:15] + ["c"] + item[5:12]
    assert sorted(L.greedy_tiles(doc, item, 13)) == [(1, 20, 20), (22, 0, 15)]
    assert L.greedy_tiles(item[:12], item, 13) == []
    assert L.greedy_tiles(["x"] * 30, ["x"] * 14, 13) == [(0, 0, 14)]


def test_against_brute_force(spark, rows):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(40)) for _ in range(rng.randrange(5, 60)))) for i in range(12)] + [(99, None), (98, "")]
    docs = []
    for d in range(150):
        ws = [f"z{rng.randrange(500)}" for _ in range(60)]
        for _ in range(2):
            p = (rng.choice(items)[1] or "").split()
            if p:
                k, n = rng.randrange(len(p)), rng.randrange(5, 30)
                ws[rng.randrange(60) : 0] = p[k : k + n]
        docs.append((d, ", ".join(ws).upper().replace("A", "Ａ")))
    docs += [(900, None), (901, ""), (None, docs[0][1]), (3, docs[3][1])]

    def hit(t, p):
        a, b = L.passage_words(t), L.passage_words(p)
        runs = {tuple(b[k : k + 13]) for k in range(len(b) - 12)}
        return any(tuple(a[k : k + 13]) in runs for k in range(len(a) - 12))

    want = sorted({(d, i) for d, t in docs if t and d is not None for i, p in items if p and hit(t, p)})
    dd = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    ii = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, passage string, doc_id string")
    assert want and rows(L.p8_found(dd, ii)) == sorted(want, key=repr)
    assert rows(L.leaks(dd, ii, max_items=2), "doc_id", "item_id") == sorted(want, key=repr)
    assert L.p8_found(dd.limit(0), ii).count() == 0 == L.p8_found(dd, ii.limit(0)).count()
    full = L.leaks(dd, ii, min_coverage=0.5).collect()
    assert all(r["coverage"] >= 0.5 and r["longest_run"] >= 13 for r in full)


def test_several_passages_of_one_item(spark, rows):
    a, b = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 20), ("b", 30)))
    ii = spark.createDataFrame([(1, a), (1, b), (2, b)], "item_id bigint, passage string")
    dd = spark.createDataFrame([(10, a), (11, b), (12, f"{a} {b}")], "doc_id bigint, text string")
    want = [(10, 1), (11, 1), (11, 2), (12, 1), (12, 2)]
    assert rows(L.p8_found(dd, ii)) == want
    assert rows(L.leaks(dd, ii, max_items=1), "doc_id", "item_id") == want
