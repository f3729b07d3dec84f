"""Packing: every id lies in one piece, sequences are full or powers of two, ids are the library's."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_tokenizer())


def test_differencing_gives_near_equal_windows():
    r = random.Random(1)
    for n, windows in ((1, 1), (1, 3), (5, 2), (40, 7), (300, 90), (900, 300)):
        sizes = [r.randrange(1, 2048) for _ in range(n)]
        got = packing.differencing(sizes, windows)
        assert sorted(i for w in got for i in w) == list(range(n)) and len(got) <= windows
        if n > 2 * windows:
            sums = [sum(sizes[i] for i in w) for w in got]
            assert sums == sorted(sums, reverse=True) and sums[0] - sums[-1] < max(sizes)
    assert [sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)] == [16, 14]  # the textbook's case


def test_the_number_of_windows_rises_until_all_fit():
    r = random.Random(2)
    for n in (1, 2, 3, 50, 700):
        sizes = [r.randrange(1, 2048) for _ in range(n)]
        got = packing.balanced(sizes)
        assert max(sum(sizes[i] for i in w) for w in got) <= 2048
        assert len(got) <= 1.5 * -(-sum(sizes) // 2048) + 1
    assert [len(w) for w in packing.balanced([1500] * 4)] == [1] * 4
    assert packing.balanced([]) == []


@pytest.mark.parametrize("sizes", [[], [1], [2047], [3, 5], [1500] * 9, [2047] * 30, [1] * 5000, [7, 64, 2000, 2000, 1]])
def test_packed_sequences(sizes):
    got = packing.packed([packing.Piece(i, 100, n) for i, n in enumerate(sizes)])
    sums = [sum(p.length for p in w) for w in got]
    assert all(s == 2048 or s & (s - 1) == 0 for s in sums) and sum(sums) == sum(sizes) and sum(s < 2048 for s in sums) <= 11
    spans = defaultdict(list)
    for p in (p for w in got for p in w):
        spans[p.doc].append((p.start, p.start + p.length))
    for i, n in enumerate(sizes):
        x = sorted(spans[i])
        assert x[0][0] == 100 and x[-1][1] == 100 + n and all(a[1] == b[0] for a, b in zip(x, x[1:]))


def test_ids_are_the_librarys(library, monkeypatch):
    r = random.Random(7)
    signs = "ab Z 09 '\"!.,-\n\t\r\x1c\x1f\x85\xa0 ​ é́ßЖ中文日本अक्षर😀\U0001f3fd٠Ⅷ½²﻿'stdrve"
    texts = ["", " ", "  x", "'s''ll 'S", "<|endoftext|> x", "x<|endoftext", "\n\n a", "don't  stop\n \n", "a" * 5000]
    texts += ["".join(r.choice(signs) for _ in range(r.randrange(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x20000)])) for _ in range(20)) for _ in range(500)]
    want = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    for known in (packing.KNOWN, 50):
        monkeypatch.setattr(packing, "KNOWN", known)
        e = packing.Encoder(packing.default_tokenizer(), 1)
        assert [np.frombuffer(e.ids(t), "<u4").tolist() for t in texts] == want
        assert len(e) <= known and len(e.old) <= known
    assert sum(e.alike.values()) > 1000  # most texts are parted, not encoded whole


def whole(rows, want):
    """Pieces of each document, by its ids: sorted keys of the rows and their coverage are as they should be."""
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, ids in want.items():
        at = 0
        for r in sorted(spans[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes.append(at)
    assert all(s <= 2048 and s & (s - 1) == 0 for s in sizes) and set(spans) == set(want)
    return sizes


def test_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: library.encode(d["text"] or "", add_special_tokens=False).ids + [1] for d in docs}
    sizes = whole(packing.op11_packing(spark, sf_dir).collect(), want)
    assert sum(s < 2048 for s in sizes) <= 11 * 4


@pytest.mark.parametrize("windows", [1, 3, 512])
def test_edge_rows_and_groups(spark, library, windows):
    texts = [None, "", " ", "word", "x " * 30_000, "é😀\x00" * 900, "many words " * 400, "tail " * 2047, "tail " * 2048] + [f"short {i}" for i in range(300)]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, start int, ids string").repartition(3)
    got = packing.pack_documents(df, packing.default_tokenizer(), windows=windows, ids=True).collect()
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    whole(got, want)
    assert all(r["ids"] == want[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in got)
    assert packing.pack_documents(df.limit(0), packing.default_tokenizer()).count() == 0
    same = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "a b")], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(same, packing.default_tokenizer()).collect()
    assert sum(r["length"] for r in got) == 9 and sum(r["length"] for r in got if r["doc_id"] is None) == 6


def test_other_vocabularies(spark):
    """Not byte-level: each text goes to the library whole."""
    import public_tokenizers

    file = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(spark.createDataFrame([(1, "Some  WORDS, here")], "doc_id long, text string"), file, ids=True).collect()
    assert sum((r["ids"] for r in sorted(got, key=lambda r: r["start"])), []) == Tokenizer.from_file(file).encode("Some  WORDS, here", add_special_tokens=False).ids + [1]


def test_characters_are_parted_by_their_class_and_looked_at_once(monkeypatch):
    plain = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    every = "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)
    mixed = every + "".join(f"{c} {c}'s{c}1{c}" for c in every[:3000])
    assert packing.STRETCHES.findall(mixed) == plain.findall(mixed)
    encoder = packing.Encoder(packing.default_tokenizer(), 1)
    texts = ["a 𝐀b 𝟗1", "😀 it's 12…", "x² \x1c y", "", " ", "é  à\n\n b"]
    texts += ["".join(random.Random(i).choices("ab1! \n\té's_²\x1c日٣𝐀😀", k=12)) for i in range(300)]
    want = [np.array(encoder.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + encoder.end for t in texts]
    assert [encoder.ids(t) for t in texts] == want
    known = encoder.ids("known words, 12 of them")
    monkeypatch.setattr(packing.Encoder, "_same_class", lambda self, c: 1 / 0)
    assert encoder.ids("known words, 12 of them") == known
