"""Ranked search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from corpusloom.llm import ranked_search


def terms_of(t):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k=10):
    """Rows (item, rank, score) and, by item row, the set of documents at each score."""
    counts = [(i, Counter(w), len(w)) for i, t in docs for w in [terms_of(t)] if w]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in counts:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i))
        out += [(item, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def tables(seed=13):
    r = random.Random(seed)
    common, rare = ["the", "of", "Ünï", "x1"], [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(n))
    docs = [(i, text(r.randrange(0, 90))) for i in range(400)]
    docs += [(1000 + i, docs[i % 5][1].upper()) for i in range(60)] + [(None, docs[3][1]), (None, None), (7, None), (8, ""), (9, "--"), (3, docs[3][1]), (11, "the " * 30_000)]
    items = [(i, text(r.randrange(1, 25))) for i in range(30)] + [(None, "the w1"), (1, "The-W5_w5"), (2, None), (3, ""), (4, "..."), (5, "absent unseen"), (6, "the"), (6, "the")]
    return docs, items


@pytest.mark.parametrize(("size", "bundle", "block", "k"), [(4096, 256, 500_000, 10), (16, 256, 500_000, 3), (50, 4, 500_000, 10), (16, 7, 60, 3)])
def test_best_documents(spark, monkeypatch, size, bundle, block, k):
    """Whole results however documents and items are blocked, and where accumulators are left behind."""
    for f, n in ((ranked_search.postings, size), (ranked_search.bundled, bundle)):
        monkeypatch.setattr(f, "__defaults__", (n,))
    docs, items = tables()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int").repartition(2)
    got = ranked_search.ranked(d, q, k=k, block=block).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, k)


def test_long_blocks_are_cut_by_terms(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "WORDS", 100)
    docs, items = tables(5)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in ranked_search.ranked(d, q).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (blank, q), (d, q.where("item_id = 2 AND text IS NULL"))):
        assert ranked_search.ranked(a, b).count() == 0


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ranked_search.ORACLE["op13_ranked_search"]).fetchall()
    got = sorted(tuple(r) for r in ranked_search.op13_ranked_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(want) and len(got) > 100
