import os

import pytest

from policylake.llm import mixing as M

HERE = os.path.exists(M.TOKENIZER)


@pytest.mark.parametrize(("rate", "cap"), [(0.2, 1), (0.9, 1), (1.5, 2), (2.7, 4), (5.99, 6), (0.001, 3), (3.0, 3), (9.0, 3), (0.0, 2)])
def test_steps_have_the_mean(rate, cap):
    f = M.poisson_steps(rate, cap)
    assert len(f) == cap and sum(1 - x for x in f) == pytest.approx(min(rate, cap), abs=1e-6)


def test_rates():
    total, r = M.plan_rates({"a": 100, "b": 10, "c": 5}, [("a", 0.5, 1), ("b", 0.5, 4), ("x", 0.0, 3)])
    assert total == 80 and r == {"a": 0.4, "b": 4.0}
    assert M.plan_rates({}, [("a", 1.0, 1)]) == (0.0, {})
    _, r = M.plan_rates({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 4)], 160)
    assert r == {"a": 0.8, "b": 4.0}


@pytest.mark.skipif(not HERE, reason="no tokenizer files")
def test_mix(spark):
    docs = [(i, f"text number {i} of source a", "a") for i in range(3000)] + [(10_000 + i, f"b text {i} " * 3, "b") for i in range(300)] + [(-1, None, "a"), (-2, "", "b"), (-3, "x", None), (-4, "x", "other"), (None, "x", "a"), (5, "again", "a")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, source string, n_tokens int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.2, 5)], "source string, target_share double, max_repeats int")
    mixed, report = M.mix(d, t, with_text=True)
    got = mixed.collect()
    rep = {r["source"]: r for r in report.collect()}
    counts = {}
    for r in got:
        counts[r["source"], r["doc_id"]] = max(counts.get((r["source"], r["doc_id"]), 0), r["copy_no"])
    assert {s for s, _ in counts} == {"a", "b"} and max(n for (s, _), n in counts.items() if s == "b") <= 3 and max(n for (s, _), n in counts.items() if s == "a") == 1
    assert rep["a"]["actual_share"] == pytest.approx(0.625, abs=0.03) and rep["none"]["actual_share"] == 0.0
    assert sum(r["n_tokens"] for r in got if r["source"] == "b") == rep["b"]["mixed_tokens"]
    assert sorted(map(tuple, M.mix(d, t, with_text=True)[0].collect())) == sorted(map(tuple, got))
    assert M.mix(d.limit(0), t)[0].count() == 0
    # Repeated ids: each row is copied equally often with its own text, and the report counts what is there.
    r = spark.createDataFrame([(7, f"text {i % 3}", "a") for i in range(200)], "doc_id bigint, text string, source string")
    mixed, report = M.mix(r, t.where("source = 'a'"), with_text=True)
    assert mixed.count() == 200 == report.first()["n_copies"] and mixed.groupBy("text").count().count() == 3
    enc = M.load_encoding(M.TOKENIZER)
    assert enc.decode(enc.encode_ordinary("Grüße 123!")) == "Grüße 123!"
