"""Benchmark decontamination by a prefix-filtered set join of item windows and document windows.

A window is `width` consecutive words of an item (all of a shorter item). Its shingles are ordered by rarity, counted
over all documents; for exact containment the necessary prefix is its rarest shingle alone. Documents are joined on
that shingle; the window must then fit at the implied place (bounds by position and length), and every word is
compared. Benchmark items, long ones in pieces, are broadcast in blocks of about BLOCK words, so what is broadcast has a
fixed bound; each block reads the documents twice, in place; they are never shuffled, whatever their sources or copies.

Defined results: null, empty or wordless texts have no words and no hits; wordless items have no windows; equal item
ids are one item; a null item id counts as "null"; repeated documents are judged alike; no items, no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, forget, materialize, prepare, table

#: Words of the benchmark in one broadcast block.
BLOCK = 500_000
WIDTH, SHINGLE = 10, 3
#: Lower-cases A-Z and turns all other ASCII characters but letters and digits into blanks.
TO_WORDS = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c) in LOWER else ord(chr(c).lower()) if chr(c) in UPPER else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split() if text else []


@dataclass
class Windows:
    """The distinct windows of a block of items: words as numbers, and the items of each window."""

    vocabulary: dict[bytes, int]
    words: np.ndarray  # windows x width, -1 beyond a window's length
    length: np.ndarray
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[object, list[bytes]]], width: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            for i in range(max(len(ids) - width, 0) + 1 if ids else 0):
                owners.setdefault(tuple(ids[i : i + width]), set()).add("null" if item is None else str(item))
        table = np.full((len(owners), width), -1, np.int64)
        for i, w in enumerate(owners):
            table[i, : len(w)] = w
        return cls(vocabulary, table, (table >= 0).sum(1), [sorted(x) for x in owners.values()])

    def code(self, ids: np.ndarray, k: int) -> np.ndarray:
        """A number for each k consecutive words, equal only for equal words; -1 where one is unknown."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(k):
            part = ids[i : i + n]
            out = out * (len(self.vocabulary) + 1) + part
            bad |= part < 0
        out[bad] = -1
        return out

    def shingles(self, k: int) -> np.ndarray:
        """Codes of the k-word shingles of each window, -1 where there is none."""
        n = self.words.shape[1]
        return np.stack([np.where((part := self.words[:, i : i + k]).min(1) < 0, -1, self._codes(part)) for i in range(n - k + 1)], 1) if len(self.words) else np.empty((0, n - k + 1), np.int64)

    def _codes(self, part: np.ndarray) -> np.ndarray:
        out = np.zeros(len(part), np.int64)
        for i in range(part.shape[1]):
            out = out * (len(self.vocabulary) + 1) + part[:, i]
        return out


@dataclass
class Prefixes:
    """For shingles of k words: the necessary prefix of each window as sorted codes, with its offset."""

    k: int
    codes: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def _ids(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))


def _sizes(windows: Windows) -> dict[int, np.ndarray]:
    """Windows by the words of their shingles: SHINGLE, or fewer for shorter windows."""
    k = np.minimum(windows.length, SHINGLE)
    return {int(x): np.flatnonzero(k == x) for x in np.unique(k)}


def _document_counts(docs: DataFrame, windows, text: str) -> dict[tuple[int, int], int]:
    """Documents that hold each shingle of the block, by (words, code); at most one row a shingle is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # this operator remembers nothing between tasks
        w = windows.value
        wanted = {k: np.unique(w.shingles(k)[at]) for k, at in _sizes(w).items()}
        total = {k: np.zeros(len(c), np.int64) for k, c in wanted.items()}
        for b in batches:
            for t in b.column(text).to_pylist():
                ids = _ids(words_of(t), w.vocabulary)
                for k, codes in wanted.items():
                    found = w.code(ids, k)
                    found = found[found >= 0]
                    at = np.searchsorted(codes, found)
                    at = np.unique(at[(at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == found)])
                    total[k][at] += 1
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(wanted[k][at]), pa.array(n[at])], names=["k", "code", "n"])

    rows = docs.select(text).mapInArrow(run, "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n"))
    return {(r["k"], r["code"]): r["n"] for r in rows.collect()}


def _prefixes(windows: Windows, counts: dict[tuple[int, int], int]) -> list[Prefixes]:
    out = []
    for k, at in _sizes(windows).items():
        codes = windows.shingles(k)[at]
        known = np.unique(codes)
        n = np.array([counts.get((k, int(c)), 0) for c in known])
        rarity = n[np.searchsorted(known, codes)].astype(float)
        rarity[codes < 0] = np.inf
        place = rarity.argmin(1)  # the rarest shingle, the first among equals
        chosen = codes[np.arange(len(at)), place]
        seen = n[np.searchsorted(known, chosen)] > 0  # a shingle that no document holds excludes its window
        chosen, place, at = chosen[seen], place[seen], at[seen]
        order = np.argsort(chosen, kind="stable")
        out.append(Prefixes(k, chosen[order], at[order], place[order]))
    return out


def _hits(ids: np.ndarray, windows: Windows, prefixes: list[Prefixes]) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every window's occurrences in a text of words `ids`."""
    starts, found = [], []
    for p in prefixes:
        codes = windows.code(ids, p.k)
        low, high = np.searchsorted(p.codes, codes, "left"), np.searchsorted(p.codes, codes, "right")
        at = np.flatnonzero((high > low) & (codes >= 0))
        if not len(at):
            continue
        n = (high - low)[at]
        entry = np.repeat(low[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        window, start = p.window[entry], np.repeat(at, n) - p.offset[entry]
        length = windows.length[window]
        fits = (start >= 0) & (start + length <= len(ids))
        window, start, length = window[fits], start[fits], length[fits]
        for j in range(windows.words.shape[1]):
            if len(window):
                same = (j >= length) | (ids[np.minimum(start + j, len(ids) - 1)] == windows.words[window, j])
                window, start, length = window[same], start[same], length[same]
        starts.append(start)
        found.append(window)
    return (np.concatenate(starts), np.concatenate(found)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _pieces(items: DataFrame, width: int, block: int) -> DataFrame:
    """(item_id, text, n): words of items, joined by blanks; of long items stretches of `block` words that share windows' ends."""
    schema = T.StructType([*items.select("item_id").schema.fields, *T.StructType.fromDDL("text string, n long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, text, n = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                words = words_of(t)
                for at in range(0, max(len(words) - width + 1, 1) if words else 0, block):
                    piece = words[at : at + block + width - 1]
                    owner.append(i)
                    text.append(b" ".join(piece).decode("utf-8", "surrogatepass"))
                    n.append(len(piece))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(owner, pa.int64())), pa.array(text, pa.string()), pa.array(n, pa.int64())], names=["item_id", "text", "n"])

    return items.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated, items (array<string>) and hit_words (array of
    start/end word numbers, end exclusive) to docs; columns of these names are replaced."""
    spark = docs.sparkSession
    items = materialize(_pieces(benchmark.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")), width, block).distinct(), "benchmark-pieces")
    size = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block))
    added = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "items": pa.list_(pa.string()), "hit_words": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    kinds = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_words array<struct<start: bigint, end: bigint>>"
    out = docs.drop(*[c for c in added if c != text])
    for i in range(blocks):
        part = [(r["item_id"], r["text"].encode("utf-8", "surrogatepass").split()) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()]
        windows = spark.sparkContext.broadcast(Windows.of(part, width))
        prefixes = spark.sparkContext.broadcast(_prefixes(windows.value, _document_counts(docs, windows, text)))
        have = i > 0
        schema = out.schema if have else T.StructType([*out.schema.fields, *T.StructType.fromDDL(kinds).fields])

        def run(batches: Iterator[pa.RecordBatch], windows=windows, prefixes=prefixes, have=have) -> Iterator[pa.RecordBatch]:
            forget()
            w, p = windows.value, prefixes.value
            for b in batches:
                rows: dict[str, list] = {k: [] for k in added}
                texts = b.column(text).to_pylist()
                known = [(b.column("items").to_pylist(), b.column("hit_words").to_pylist())] if have else [([[]] * len(texts), [[]] * len(texts))]
                for t, before, spans in zip(texts, *known[0], strict=True):
                    ids = _ids(words_of(t), w.vocabulary)
                    start, window = _hits(ids, w, p)
                    names = {x for k in np.unique(window).tolist() for x in w.items[k]}.union(before)
                    edge = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + w.length[window], -1)
                    for s in spans:
                        edge[s["start"]] += 1
                        edge[s["end"]] -= 1
                    hit = np.concatenate([[0], (np.cumsum(edge)[:-1] > 0).astype(np.int8), [0]])
                    turn = np.diff(hit)
                    rows["n_words"].append(len(ids))
                    rows["n_hit"].append(int(hit.sum()))
                    rows["n_items"].append(len(names))
                    rows["items_sha256"].append(hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
                    rows["contaminated"].append(bool(hit.any()))
                    rows["items"].append(sorted(names))
                    rows["hit_words"].append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)])
                old = {n: c for n, c in zip(b.schema.names, b.columns, strict=True) if n not in added or n == text and not have}
                yield pa.RecordBatch.from_arrays([*old.values(), *(pa.array(rows[k], t) for k, t in added.items())], names=[*old, *added])

        out = out.mapInArrow(run, schema)
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
