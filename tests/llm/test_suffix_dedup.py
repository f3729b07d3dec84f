"""Removed bytes against brute force over all strings of the length, and the sort against Python's."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import suffix_dedup as sd


def brute(rows):
    n, seen = sd.LENGTH, Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(hash(b[i : i + n]) for i in range(len(b) - n + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        spans, at = [], -1
        for p in range(len(b) - n + 1):
            if seen[hash(b[p : p + n])] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + n
                else:
                    spans.append([p, p + n])
        kept = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)]))
        out.append((i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def planted(seed):
    r = random.Random(seed)
    prose = lambda k: "".join(r.choices("abcdefé ghij\n", k=k))
    passages = [prose(k) for k in (150, 199, 200, 201, 260, 400, 900)]
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "x" * 700), (4, "ab" * 300), (5, "short")]
    for i in range(6, 120):
        t = prose(r.randrange(0, 600))
        for _ in range(r.choice([0, 0, 1, 2])):
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - 180)) if r.random() < 0.4 else 0
            t += p[a:] + prose(r.randrange(0, 300))
        rows.append((i, t))
    rows += [(200 + j, rows[10 + j][1]) for j in range(20)] + [(10, rows[10][1])]
    for j in range(25):  # near copies: many different surroundings of the same anchors
        t = list(passages[6])
        for _ in range(r.randrange(0, 4)):
            t[r.randrange(len(t))] = "#"
        rows.append((300 + j, "".join(t)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "crowd", "chunk", "bits"), [(1, 40_000, 2 << 20, 64), (2, 5, 2 << 20, 64), (3, 40_000, 900, 64), (4, 40_000, 2 << 20, 5), (5, 5, 900, 3)])
def test_planted_repeats(spark, seed, crowd, chunk, bits):
    """Crowded anchors, texts cut in chunks, and hashes of so few bits that most of them collide."""
    rows = planted(seed)
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_spans int").repartition(3)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sd.remove_repeats(df, crowd=crowd, chunk=chunk, bits=bits).collect())
    assert got == brute(rows)


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = sorted(tuple(r) for r in sd.op2_suffix_dedup(spark, sf_dir).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_columns_named_like_own_ones_and_nulls(spark):
    rows = [(1, "a" * 250, "k", 1, b"b"), (None, None, None, None, None), (1, "a" * 250, "k", 1, b"b"), (2, "b" * 199, "k", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, __key int, __body binary")
    got = sorted(tuple(r) for r in sd.remove_repeats(df).select("n_bytes", "n_removed", "n_spans", "kept", "__key", "__body").collect())
    assert got == [(0, 0, 0, b"", None, None), (199, 0, 0, b"b" * 199, 1, None), (250, 250, 1, b"", 1, b"b"), (250, 250, 1, b"", 1, b"b")]


def test_misled_sort_falls_back_to_bytes():
    r = np.random.default_rng(2)
    data = r.integers(97, 99, (300, 12)).astype(np.uint8)
    s = sd.Suffixes(data, np.full(300, 12), np.zeros(300, int), bits=2)
    a, b, n = s.neighbours()
    rows = [bytes(x) for x in data]
    assert [rows[i] for i in [*a.tolist(), b[-1]]] == sorted(rows)
    assert n.tolist() == [next((k for k, (p, q) in enumerate(zip(rows[i], rows[j])) if p != q), 12) for i, j in zip(a, b)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.remove_repeats(df).count() == 0


def test_hash_compared_sort():
    r = np.random.default_rng(1)
    rows = [r.integers(97, 99, r.integers(0, 12)).astype(np.uint8).tobytes() for _ in range(500)] + [b"aaaa"] * 20
    group = r.integers(0, 7, len(rows))
    data = np.zeros((len(rows), 12), np.uint8)
    for i, b in enumerate(rows):
        data[i, : len(b)] = np.frombuffer(b, np.uint8)
    s = sd.Suffixes(data, np.array([len(b) for b in rows]), group)
    order = s.sort()
    assert [(group[i], rows[i]) for i in order] == sorted((g, b) for g, b in zip(group, rows))
    a, b = r.integers(0, len(rows), (2, 300))
    lcp = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert s.verified(a, b).tolist() == [lcp(rows[i], rows[j]) for i, j in zip(a, b)]


@pytest.mark.parametrize("values", [2**63, 40, 3, 1])
@pytest.mark.parametrize("w", [1, 2, 7, 153])
def test_places_of_least_values_change_only_where_they_are_told(values, w):
    rng = np.random.default_rng(values % 1000 + w)
    for n in (w, w + 1, w + 40, 2000):
        x = rng.integers(0, values, n, np.uint64)
        first, place = sd._least_in_window(x, w)
        want = [i + int(x[i : i + w].argmin()) for i in range(n - w + 1)]
        assert np.repeat(place, np.diff(first, append=len(want))).tolist() == want
