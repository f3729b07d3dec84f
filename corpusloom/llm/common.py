"""Pieces that the training-data operators share: tables, scratch space, words, hashes and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.scratch import scratch_path

#: Rows of an Arrow batch that goes to a Python worker; keeps a batch of long texts small.
BATCH_ROWS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of the session, unless the user has set the bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends here and no step runs twice."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from the columns."""
    known, mark = {c.lower() for c in columns}, "__"
    while any(mark + n in known for n in names):
        mark += "_"
    return [mark + n for n in names]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


#: What this Python worker remembers from task to task, of one owner at a time.
_kept: dict[tuple, object] = {}


def remembered(owner: tuple, make: Callable[[], object]) -> object:
    """What the worker keeps for the owner, made where it is missing.

    A worker serves all operators of a session, such as a pipeline's stages. What other owners left is let go first, so it
    needs the memory of one operator and not the sum of all.
    """
    if owner not in _kept:
        forget()
        _kept[owner] = make()
    return _kept[owner]


def forget() -> None:
    """Lets go what the worker remembers, and gives the memory back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can't
            ctypes.CDLL(None).malloc_trim(0)


#: Key of the words' digests, and different words that a worker remembers.
KEY, WORDS = b"corpusloom words", 1 << 18


class _Places(dict):
    """Numbers words as they come; the digest of word i stands at place i of `raw`."""

    def __init__(self):
        super().__init__()
        self.raw = bytearray()

    def __missing__(self, word: bytes) -> int:
        self.raw += hashlib.blake2b(word, digest_size=16, key=KEY).digest()
        n = self[word] = len(self)
        return n


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes (two rows) of the words: halves of a keyed digest, equal on every machine."""
    if len(places := remembered(("words",), _Places)) > WORDS:
        forget()
        places = remembered(("words",), _Places)
    at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    return np.ascontiguousarray(np.frombuffer(places.raw, np.uint64).reshape(-1, 2)[at].T)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, along the last axis; fewer words give one hash of them all, none give none."""
    n = h.shape[-1]
    if n == 0:
        return h
    k = min(k, n)
    out = np.full((*h.shape[:-1], n - k + 1), np.uint64(k), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[..., i : n - k + 1 + i])
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, smallest node) that join the same nodes as the links (a, b) do."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _local_forest(batches):
    seen = [b for b in batches if len(b)]
    if seen:
        pdf = pd.concat(seen)
        yield pd.DataFrame(forest(pdf["u"].to_numpy(), pdf["v"].to_numpy()), columns=["u", "v"], dtype="int64")


def _thin(batches, keep: int = 200_000):
    """Replaces each run of at most `keep` links by a forest of them."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= keep:
            yield from _local_forest(held)
            held, n = [], 0
    yield from _local_forest(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph with links edges(u, v): component is the smallest node reachable.

    Rounds of hooking each node to its smallest neighbour, two pointer jumps and contraction; every
    grouping pre-aggregates, so a hub costs no more than its links. Lineage is cut by written tables.
    Nodes without links have no row. Empty input gives no rows.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = materialize(e.mapInPandas(_thin, "u long, v long"), "edges")
    maps = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"))
        p = materialize(p, "hooks")
        for _ in range(2):
            q = p.select(F.col("u").alias("k"), F.col("p").alias("pp"))
            p = p.join(q, p.p == q.k).select("u", F.col("pp").alias("p"))
        p = materialize(p, "parents")
        maps.append(p)
        a = p.select(F.col("u").alias("u0"), F.col("p").alias("pu"))
        b = p.select(F.col("u").alias("v0"), F.col("p").alias("pv"))
        e = (
            e.join(a, e.u == a.u0).join(b, F.col("v") == F.col("v0")).where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        )
        e = materialize(e, "edges")
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[0].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for m in maps[1:]:
        m = m.select(F.col("u").alias("k"), F.col("p").alias("pp"))
        out = out.join(m, out.component == m.k, "left").select("node", F.coalesce("pp", "component").alias("component"))
    return out


def least_names(linked: DataFrame, names: DataFrame, salts: int = 16) -> DataFrame:
    """(node, best): the least name in each node's component, of linked(node, component) and names(rep, name), nulls aside.

    A component's name goes to salted copies, so that a large one doesn't meet its members in one place.
    """
    best = linked.join(names.select("rep", "name"), F.col("node") == F.col("rep")).groupBy(F.col("component").alias("c")).agg(F.min("name").alias("best"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    at = linked.withColumn("at", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    return at.join(best, (at.component == best.c) & (F.col("at") == best.salt)).select("node", "best")


class BitFilter:
    """A set of 64-bit values as at most 2**most bits: answers "no" surely and "yes" probably.

    Its size has a fixed bound, so it may be broadcast whatever the input; a full filter only lets more rows through
    to the exact join that follows.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @classmethod
    def build(cls, values: DataFrame, count: int, most: int = 26) -> BitFilter:
        """values: one long column; count: about how many."""
        bits = min(most, max(16, (16 * max(count, 1)).bit_length()))
        x = F.col(values.columns[0])
        place = x.bitwiseAND(F.lit((1 << bits) - 1))
        words = values.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, CAST({values.columns[0]} & 63 AS INT))").alias("b"))
        out = np.zeros(1 << (bits - 6), np.uint64)
        got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2**(most - 6) rows
        out[got.column("w").to_numpy()] = got.column("b").to_numpy().view(np.uint64)
        return cls(out)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = values.astype(np.uint64) & self.mask
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def column(self, spark: SparkSession, value: Column) -> Column:
        """Whether a long column may be a member, as a vectorized expression."""
        held = spark.sparkContext.broadcast(self)

        @F.pandas_udf(T.BooleanType())
        def member(x: pd.Series) -> pd.Series:
            return pd.Series(held.value.has(x.to_numpy()))

        return member(value)
