"""Components of the n-gram Jaccard join against brute force over all pairs that share an n-gram."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from corpusloom.llm import ngram_join
from corpusloom.llm.common import components


def brute(rows, n=3, percent=90):
    sets = {}
    for i, t in rows:
        ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[j : j + n]) for j in range(max(len(ws) - n, 0) + 1)} if ws else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for i, s in sets.items():
        overlap = defaultdict(int)
        for g in s:
            for j in holders[g]:
                overlap[j] += j < i
        for j, o in overlap.items():
            if o and 100 * o >= percent * (len(s) + len(sets[j]) - o):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def variants(seed):
    """Families of edited copies of different lengths, a large one among them, and shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=40)
    rows, i = [], 0
    for size, length in [(60, 120), (25, 12), (12, 300), (9, 40), (6, 3), (40, 60)]:
        base = r.choices(vocabulary, k=length)
        for _ in range(size):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, length // 20])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            words = words[: len(words) - r.choice([0, 0, 1, 2])] or words
            rows.append((i := i + 3, " ".join(words).upper() if r.random() < 0.2 else "\n".join(words)))
    rows += [(1000 + j, " ".join(passage + r.choices(vocabulary, k=r.randrange(0, 60)))) for j in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "one"), (2005, "one two"), (2006, "a a a a a a"), (2007, "A a a a")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 1500), (2, 7)])
def test_components_match_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = variants(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()}
    assert got == brute(rows)


def near_copies(n, seed=3):
    r = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    for i in range(n):
        words = list(base)
        for _ in range(2):
            words[r.randrange(120)] = f"x{r.randrange(10**6)}"
        yield i, " ".join(words)


def test_dense_families_meet_in_proportion(spark, monkeypatch):
    """Near copies of one text in many blocks: sets are compared in proportion to their number, not to its square."""
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    copies = {}
    for n in (100, 400):
        met = []
        for name in ("_meetings", "_heads"):
            monkeypatch.setattr(ngram_join, name, lambda rows, f=getattr(ngram_join, name): met.append((df := f(rows)).count()) or df)
        rows = list(near_copies(n))
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
        monkeypatch.undo()
        monkeypatch.setattr(ngram_join, "BLOCK", 10)
        assert set(got.values()) == {0}
        copies[n] = sum(met)
    assert copies[400] <= 8 * copies[100] and copies[400] < 4 * 400, copies


def test_hot_tokens_match_brute_force(spark, monkeypatch):
    """Tokens of three sets or more are hot, families of more than seven sets are cut, and rows come in many batches."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "HOT", 3)
    rows = variants(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute(rows)


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words agree under every polynomial modulo 2**64 with an odd base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x y {a} z"), (2, f"x y {b} z"), (3, f"X y {a} Z")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    h = ngram_join.word_hashes([a.encode(), b.encode(), a.encode()])
    assert (h[:, 0] != h[:, 1]).all() and (h[:, 0] == h[:, 2]).all()


def test_null_and_equal_ids(spark):
    """Equal ids with different texts are judged apart; null ids link, but name no component."""
    words = [f"w{i}" for i in range(100)]
    near = " ".join([*words, "more"])
    other = " ".join(f"v{i}" for i in range(50))
    lone = " ".join(f"u{i}" for i in range(50))
    rows = [(None, " ".join(words)), (9, near), (5, " ".join(words) + " end"), (5, other), (7, other), (None, lone), (None, lone), (None, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    got = sorted((tuple(r) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert got == sorted([(None, 98, 5), (9, 99, 5), (5, 99, 5), (5, 48, 5), (7, 48, 5), (None, 48, None), (None, 48, None), (None, 0, None)], key=str)


def test_documents_match_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.ngram_components(df).collect()) == [(2, 2, 2), (5, 2, 2), (5, 2, 2)]
    assert ngram_join.ngram_components(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    r = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(100, 400)]
    star = [(1000, i) for i in range(1001, 1200)]
    loose = [tuple(map(int, x)) for x in r.integers(2000, 2400, (150, 2))]
    edges = chain + star + loose + chain[:5]
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["component"] for r in components(df).collect()} == want
