"""Periodic runs against brute force over all starts and periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from corpusloom.llm import periodic_runs


def words_of(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def brute_runs(w):
    found = {}
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_left(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    r = random.Random(12)
    out = [None, "", " \t\n", "a", "a " * 6, "a b " * 4, "a b " * 3 + "a", "a a a a a b a a a a a a", "é\x0bé\x0cé\ré é\té", "x x " * 9, "a " * 700, "p q r " * 99 + "s " + "p q r " * 99]
    for i in range(150):
        w = [r.choice("ab" if i % 3 else "abcdefgh") for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            p = [r.choice("abc") for _ in range(r.randrange(1, 9))]
            k = r.randrange(0, len(w) + 1)
            w[k:k] = (p * r.randrange(3, 8))[: r.randrange(2, 50)]
        out.append(" ".join(w))
    inner = ["x"] * 8
    out.append(" ".join((["a", "b"] * 5 + inner + ["c"]) * 6))  # runs inside the periods of a run
    return out


@pytest.mark.parametrize("size", [periodic_runs.SLICE, 50])
def test_runs_and_collapsed_texts(spark, monkeypatch, size):
    monkeypatch.setattr(periodic_runs, "SLICE", size)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(7, "a " * 9, 1, "x"), (7, "a " * 9, 1, "x"), (None, "b " * 9, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.collapse_runs(df).collect()), key=str)
    want = sorted(((i, runs := brute_runs(w := words_of(t)), brute_left(w, runs)) for i, t, *_ in rows), key=str)
    assert sum(len(x[1]) for x in want) > 100
    assert got == want
    assert periodic_runs.collapse_runs(df.limit(0)).count() == 0


def test_names_of_many_texts_differ():
    """Texts side by side give what each gives alone."""
    r = random.Random(3)
    docs = [[r.randrange(2) for _ in range(r.randrange(0, 40))] for _ in range(300)]
    sizes = [len(d) for d in docs]
    start, end, period = periodic_runs.Factors(np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), sizes)).runs()
    low = np.cumsum([0, *sizes])
    want = [(low[i] + s, low[i] + s + n, q) for i, d in enumerate(docs) for s, n, q in brute_runs(d)]
    assert list(zip(start, end, period, strict=True)) == want


def test_long_text(spark):
    """A text of several MB, one run of it across more than half."""
    r = random.Random(5)
    w = [f"w{r.randrange(5000)}" for _ in range(150_000)] + [f"p{i}" for i in range(90_001)] * 4 + ["end"]
    got = periodic_runs.collapse_runs(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")).first()
    assert [tuple(x) for x in got["runs"]] == [(150_000, 360_004, 90_001)]
    assert got["collapsed"] == " ".join(w[: 150_000 + 90_001] + ["end"])


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        w = words_of(t)
        h = zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute_runs(w)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(found), *four, sha("".join("%d,%d,%d\n" % x for x in found)), sha(brute_left(w, found))))
    got = sorted(tuple(r) for r in periodic_runs.op12_periodic_runs(spark, sf_dir).collect())
    assert sum(x[1] > 0 for x in want) > 5
    assert got == sorted(want)


def test_query_on_edge_rows(spark, tmp_path):
    """Null and empty texts and null ids are given unchanged to the search, whatever their checksum."""
    rows = [(i, None if i % 2 else "", 1) for i in range(40)] + [(None, "a " * 8, 1), (None, None, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == 42 and sum(r["n_runs"] for r in got) == 1
    assert {r["collapsed_sha256"] for r in got if r["doc_id"] is not None} == {hashlib.sha256(b"").hexdigest()}
