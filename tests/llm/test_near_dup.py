import random

import numpy as np
from pyspark.sql import functions as F

from policylake.llm import near_dup as N
from policylake.llm.words import WordHashes, shingles, words


def jaccard(a, b, n):
    a, b = ({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (words(a), words(b)))
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(seed, edits, groups=24, noise=60):
    rng = random.Random(seed)
    voc = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(groups):
        base = rng.choices(voc, k=rng.randrange(120, 260))
        for _ in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(rng.randrange(0, edits)):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(0, 2)] = [rng.choice(voc)]
            texts.append(" ".join(t))
    texts += [" ".join(rng.choices(voc, k=150)) for _ in range(noise)]
    return list(enumerate(texts + [texts[0].upper() + "!", texts[0]]))


def test_signature_estimates_jaccard():
    h = WordHashes()
    rng = random.Random(2)
    a = rng.choices([f"x{i}" for i in range(3000)], k=1000)
    b = a[:800] + rng.choices([f"y{i}" for i in range(3000)], k=200)
    with np.errstate(over="ignore"):
        sa, sb = (shingles(h.array(w), 3) for w in (a, b))
        true = len(np.intersect1d(sa, sb)) / len(np.union1d(sa, sb))
        est = (N.minmax_signature(sa, 600) == N.minmax_signature(sb, 600)).mean()
    assert abs(true - est) < 0.05


def test_pairs_against_brute_force(spark, rows):
    for n, threshold, kw in ((3, 0.5, {"bands": 96, "rows": 5}), (5, 0.8, {})):
        docs = corpus(n, 14 if n == 3 else 4)
        d = spark.createDataFrame(docs, "id bigint, text string").withColumn("sh", F.lit("clash"))
        links, members = N.near_duplicate_links(d, "id", "text", n=n, threshold=threshold, min_words=80, **kw)
        got = set(rows(N.near_duplicate_pairs(links, members, numeric=True)))
        want = {(str(i), str(j)) for i, a in docs for j, b in docs if i < j and jaccard(a, b, n) >= threshold}
        assert got <= want and len(got) >= 0.98 * len(want) > 20
        groups = {r["id"]: r["group_id"] for r in N.near_duplicate_classes(links, members).collect()}
        assert all(groups[a] == groups[b] for a, b in got) and len(groups) == len(docs)


def test_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f")], "id bigint, text string")
    links, members = N.near_duplicate_links(d, "id", "text")
    assert links.count() == 0 and {tuple(r) for r in N.near_duplicate_pairs(links, members).collect()} == {("4", "5")}
    links, members = N.near_duplicate_links(d.limit(0), "id", "text")
    assert links.count() == 0 == members.count()


URLS = {
    "https://h.example/legal/privacy": ["HTTP://h.example/legal/privacy", "https://H.EXAMPLE:443/legal//privacy/", "https://h.example/legal/%70rivacy#top", "https://h.example/legal/privacy?utm_source=x&ref=y", "http://h.example:80/legal/privacy?"],
    "https://www.h.example/legal/privacy": [], "https://h.example/legal/Privacy": [], "https://h.example/legal/privacy?lang=en": ["https://h.example/legal/privacy?lang=en&ref=a"], "https://h.example/legal/privacy/jobs": [],
    "https://h.example/privacy/legal": [], "https://h.example/a%2Fb": ["https://h.example/a%2fb"], "https://h.example/a/b": [], "https://h.example/p?a=1&b=2": ["https://h.example/p?b=2&a=1"], "https://h.example:8443/p": [],
}


def test_urls(spark, rows):
    all_ = [(u,) for k, v in URLS.items() for u in (k, *v)] + [(None,), ("",), ("https://h.example/a/b",)]
    got = set(rows(N.same_page_urls(spark.createDataFrame(all_, "u string"), "u", www=True)))
    want = {tuple(sorted((a, b))) for k, v in URLS.items() for a in (k, *v) for b in (k, *v) if a < b}
    assert got == want


def test_www_is_no_other_host(spark, rows):
    same = ["https://h.example/privacy", "https://www.h.example/privacy/", "http://WWW.h.example.:80/privacy", "//user@www.h.example/privacy"]
    other = ["https://www.h.example/", "https://www2.h.example/privacy", "https://a.www.h.example/privacy", "https://www.www.h.example/privacy", "https://wwwh.example/privacy", "https://www./privacy"]
    t = spark.createDataFrame([(u,) for u in same + other], "policy_url string")
    f = spark.createDataFrame([], "fetch_id bigint, text string")
    assert set(rows(N.p1_found(f, t))) == {("policy_url", a, b) for a in same for b in same if a < b}
