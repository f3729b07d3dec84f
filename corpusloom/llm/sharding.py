"""Sharding by histogram sort: splitters are refined by exact byte counts, then rows are exchanged once.

Rows are ordered by (hash of the text, doc_id). Each round counts, in all partitions, the exact bytes and rows
below candidate boundaries and narrows the interval of every splitter that isn't within tolerance of its goal.
Candidates lie between groups of equal texts, so such a group stays in one shard; only a group that is itself
larger than the tolerance is cut, at a doc_id. The counts also say at which slot each stretch of rows starts,
so slots need no window over a whole shard.

Defined results: a null text counts as empty (size 16, checksum 0); a null doc_id sorts first; repeated rows each
get a slot of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, table

#: Candidates a splitter in each round, and the first grid's candidates a shard.
PROBES = 16
LOWEST = -(1 << 63)
Key = tuple[int, int]


def _packed(h: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Signed pairs as 16 bytes whose order is that of the pairs (one byte more, as numpy strips zeros)."""
    out = np.empty((len(h), 17), np.uint8)
    flip = np.uint64(1 << 63)
    out[:, :8] = (np.asarray(h, np.int64).view(np.uint64) ^ flip).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:16] = (np.asarray(i, np.int64).view(np.uint64) ^ flip).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 16] = 1
    return out.view("S17").ravel()


def _pack(keys: list[Key]) -> np.ndarray:
    return _packed(np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64))


def _stretches(rows: DataFrame, keys: list[Key]) -> pd.DataFrame:
    """Exact bytes b, rows n and the least and greatest key of each stretch from one of the sorted keys to the next."""
    packed = _pack(keys)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["at"] = np.searchsorted(packed, _packed(b["h"].to_numpy(), b["k"].to_numpy()), "right") - 1
            yield b

    found = (
        rows.select("h", "k", "size").mapInPandas(count, "h long, k long, size long, at long")
        .groupBy("at").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min(F.struct("h", "k")).alias("low"), F.max(F.struct("h", "k")).alias("high"))
        .select("at", "b", "n", "low.*", F.col("high.h").alias("h2"), F.col("high.k").alias("k2"))
    )
    out = pd.DataFrame(found.collect(), columns=["at", "b", "n", "h", "k", "h2", "k2"])  # at most one row a candidate
    return out.astype({c: "int64" for c in out}).set_index("at").reindex(range(len(keys)), fill_value=0)


def _inside(low: Key, high: Key, n: int) -> set[Key]:
    """Up to n keys that cut a stretch whose least and greatest keys are given: between groups, or inside its only one."""
    if low[0] < high[0]:
        return {(low[0] + -(-(high[0] - low[0]) * j // n), LOWEST) for j in range(1, n + 1)}
    return {(low[0], low[1] + -(-(high[1] - low[1]) * j // n)) for j in range(1, n + 1)} if low[1] < high[1] else set()


def find_splitters(rows: DataFrame, shards: int, tolerance: float = 0.01) -> tuple[list[Key], list[int], list[int]]:
    """Candidates, the rows below each, and the places among them of shards - 1 cuts of rows(h, k, size).

    Each cut is within tolerance of a shard's size from its goal, or the nearest that any key gives. The number of
    candidates depends on the number of shards alone; rounds end when every cut is met or can't be cut finer.
    """
    span = 1 << 64
    keys: list[Key] = [(LOWEST + span * j // (PROBES * shards), LOWEST) for j in range(PROBES * shards)]
    while True:
        found = _stretches(rows, keys)
        below = np.concatenate([[0], np.cumsum(found["b"].to_numpy())])
        total = int(below[-1])
        goals = [total * (j + 1) / shards for j in range(shards - 1)]
        more: set[Key] = set()
        for goal in goals:
            j = max(int(np.searchsorted(below, goal, "right")) - 1, 0)
            if j < len(keys) and min(goal - below[j], below[j + 1] - goal) > tolerance * total / shards / 2:
                x = found.iloc[j]
                more |= _inside((int(x.h), int(x.k)), (int(x.h2), int(x.k2)), PROBES)
        more -= set(keys)
        if not more:
            break
        keys = sorted({*keys, *more})
    starts = [0, *np.cumsum(found["n"].to_numpy()).tolist()]
    cuts = [int(np.argmin(np.abs(below - g))) for g in goals] if total else [len(keys)] * (shards - 1)
    return keys, starts, cuts


def shard_by_bytes(docs: DataFrame, shards: int, size: Column, group: Column, key: str = "doc_id", tolerance: float = 0.01) -> DataFrame:
    """Adds size, shard and slot (gapless from 0 in each shard) to docs, with shards of near equal size.

    group: rows with equal values stay together as far as the tolerance lets them. Columns of docs by the
    added names are replaced. The wide rows move once, into ranges that each hold a bounded part of a shard.
    """
    docs = docs.drop("shard", "slot")
    h, k, s, r, d, b = fresh(docs.columns, "h", "k", "s", "r", "d", "b")
    marked = docs.withColumns({h: F.xxhash64(F.coalesce(group, F.lit(""))), k: F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)), "size": size})
    rows = materialize(marked.select(F.col(h).alias("h"), F.col(k).alias("k"), "size"), "shard-keys")
    keys, starts, cuts = find_splitters(rows, shards, tolerance)
    packed = _pack(keys)
    shard_of = np.searchsorted(np.array(cuts), np.arange(len(keys)), "right")
    first = np.array([0, *(starts[c] for c in cuts)])
    base = np.array(starts[:-1]) - first[shard_of]

    @F.pandas_udf(T.IntegerType())
    def stretch(h: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(packed, _packed(h.to_numpy(), k.to_numpy()), "right").astype(np.int32) - 1)

    out = marked.withColumn(s, stretch(h, k)).withColumn(r, F.row_number().over(Window.partitionBy(s).orderBy(h, k)))
    places = docs.sparkSession.createDataFrame(pd.DataFrame({s: np.arange(len(keys), dtype=np.int32), d: shard_of.astype(np.int32), b: base.astype(np.int64)}))
    out = out.join(F.broadcast(places), s)  # one row a stretch; their number depends on that of shards alone
    return out.withColumns({"shard": F.col(d), "slot": F.col(b) + F.col(r) - 1}).drop(s, r, h, k, d, b)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.encode("text", "utf-8"), F.encode(F.lit(""), "utf-8"))).alias("text_crc32"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__t"))
    out = shard_by_bytes(narrow, 40, F.col("size"), F.col("__t").cast("string"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
