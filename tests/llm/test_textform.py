import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from policylake.llm import textform as T

SAME = [
    ("Ｔｏｄａｙ", "Today"), ("oﬃce ﬂow", "office flow"), ("déjà", "déjà"), ("co​ok­ie﻿", "cookie"), ("a b c d", "a b c d"), ("ѕсоре", "scope"), ("Τοtal", "Total"),
    ("E‑mail", "E-mail"), ("が", "が"), ("ё", "ё"), ("ｶﾞ", "ガ"), ("а​́", "á"),
]
OTHER = [("déjà", "deja"), ("Cookie", "cookie"), ("a b", "a  b"), ("a\nb", "a b"), ("rn", "m"), ("O", "0"), ("²", "2"), ("cookie", "cookies"), ("’", "'")]


def test_pairs():
    for a, b in SAME:
        assert T.canonical(a) == T.canonical(b), (a, b)
    for a, b in OTHER:
        assert T.canonical(a) != T.canonical(b), (a, b)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(max_size=60))
def test_idempotent_and_composed(t):
    c = T.canonical(t)
    assert T.canonical(c) == c
    assert T.canonical(unicodedata.normalize("NFD", t)) == T.canonical(unicodedata.normalize("NFC", t))


def test_table(spark, rows):
    docs = [(1, "Today"), (2, "Ｔoday"), (3, "Today"), (4, "today"), (5, None), (6, ""), (7, "​"), (8, "‍"), (None, "Тoday"), (9, "x" * 100_000 + "é"), (10, "x" * 100_000 + "é"), (2, "Ｔoday")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("c1", F.lit("clash"))
    assert rows(T.same_look_pairs(d, "doc_id", "text")) == [(1, 2), (2, 3), (7, 8), (9, 10)]
    assert T.same_look_pairs(d.limit(0), "doc_id", "text").count() == 0
    got = T.with_canonical(d, "text", "c1").select("c1").collect()
    assert [r[0] for r in got][:6] == ["Today", "Today", "Today", "today", None, ""]
