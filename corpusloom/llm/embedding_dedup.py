"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

Equal vectors of a label are one class. A class is rotated a few times by random signs and Hadamard transforms; the
code of a table is the signed axis nearest to the rotated vector (several axes for more classes). A class goes to its
own bucket and probes the buckets of its next-nearest axes. Pairs that meet are verified by cosine in double
precision. A pair counts in the first table and bucket where it meets, so tasks return link counts and a forest of the
links, never the pairs. Buckets beyond BLOCK rows are cut in blocks and all pairs of blocks are compared.

Expected recall of pairs at the threshold is above 0.999 (tests measure it against brute force); more classes raise
the axes a code and the tables together, so a bucket's expected size stays bounded.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with
nothing; vectors of other lengths are never compared; repeated rows link with one another; equal ids with different
vectors are judged apart; a null id is judged like any other, but a component is named by its smallest id that isn't null
(null if it has none) and kept is false for a null id; an empty table gives none; extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, forest, least_names, materialize, prepare, table

#: Rows of a bucket that are compared in one task; classes of one label that share a code of one axis, about.
BLOCK, SHARE = 2048, 4096
#: Tables with one axis a code (doubled for each further axis), buckets that a class probes besides its own, rotations.
TABLES, PROBES, TURNS = 6, 2, 3
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the length is a power of two."""
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), -1)
        h *= 2
    return x


def codes(x: np.ndarray, tables: int, axes: int, probes: int = PROBES) -> np.ndarray:
    """Codes (rows x tables x (1 + probes)) of unit vectors: the own bucket first, then the nearest others."""
    n, dim = x.shape
    size = 1 << max(dim - 1, 1).bit_length()
    x = np.pad(x, ((0, 0), (0, size - dim)))
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        choice, loss = [], []
        for k in range(axes):
            signs = np.random.default_rng([SEED, t, k, size]).choice([-1.0, 1.0], (TURNS, size))
            y = x
            for s in signs:
                y = hadamard(y * s)
            far = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : 1 + probes]
            value = np.take_along_axis(y, far, 1)
            choice.append(2 * far + (value > 0))
            loss.append(np.abs(value[:, :1]) - np.abs(value))
        own = np.zeros(n, np.int64)
        for c in choice:
            own = own * 2 * size + c[:, 0]
        # one axis moves to its next choices, the cheapest moves first
        moves, costs = [], []
        for k, (c, cost) in enumerate(zip(choice, loss, strict=True)):
            for j in range(1, c.shape[1]):
                moves.append(own + (c[:, j] - c[:, 0]) * (2 * size) ** (axes - 1 - k))
                costs.append(cost[:, j])
        out[:, t, 0] = own
        order = np.argsort(np.stack(costs, 1), axis=1, kind="stable")[:, :probes]
        out[:, t, 1 : 1 + order.shape[1]] = np.take_along_axis(np.stack(moves, 1), order, 1)
        out[:, t, 1 + order.shape[1] :] = own[:, None]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def bucket_links(ids: np.ndarray, sizes: np.ndarray, x: np.ndarray, keys: np.ndarray, block: np.ndarray, place: tuple[int, int], pair: tuple[int, int], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links added to each, forest) of the pairs in one bucket that meet there first.

    keys: the codes of each row; place: the bucket's table and code; pair: which blocks are compared.
    """
    t, code = place
    x = _unit(x)
    own = keys[:, t, 0] == code
    added = np.zeros(len(ids), np.int64)
    us, vs = [], []
    for i in range(0, len(ids), 512):
        r, c = np.nonzero(x[i : i + 512] @ x.T >= least)
        r = r + i
        good = (ids[r] < ids[c]) & (own[r] | own[c])
        if pair[0] != pair[1]:
            good &= block[r] != block[c]
        r, c = r[good], c[good]
        first = np.ones(len(r), bool)
        for u in range(t + 1):
            a, b = keys[r, u, 0], keys[c, u, 0]
            at_b, at_a = (keys[r, u] == b[:, None]).any(1), (keys[c, u] == a[:, None]).any(1)  # meets in c's, in r's bucket
            if u < t:
                first &= ~(at_a | at_b)
            else:
                first &= np.where(at_a & at_b, np.minimum(a, b), np.where(at_b, b, a)) == code
        r, c = r[first], c[first]
        np.add.at(added, r, sizes[c])
        np.add.at(added, c, sizes[r])
        us.append(ids[r])
        vs.append(ids[c])
    links = np.array(forest(np.concatenate(us), np.concatenate(vs)), np.int64).reshape(-1, 2) if us else np.empty((0, 2), np.int64)
    return ids[added > 0], added[added > 0], links


def similar_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of vectors."""
    v = F.col(vector)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("x"))
    good = F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("x", lambda a: a != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = rows.where("good").groupBy("label", "x").agg(F.min("id").alias("name"), F.count("*").alias("size")).withColumn("rep", F.monotonically_increasing_id())
    classes = materialize(classes, "vector-classes")  # numbers are fixed by writing them
    axes = 1
    widest = classes.agg(F.max(F.size("x"))).first()[0] or 2
    while classes.count() / (2 * widest) ** axes > SHARE:
        axes += 1
    tables = TABLES << (axes - 1)

    def hashed(batches):
        for b in batches:
            sizes = np.array([len(x) for x in b.column("x")])
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                got = codes(_unit(_matrix(part.column("x"))), tables, axes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(got.reshape(len(got), -1)), pa.list_(pa.int64()))], names=[*part.schema.names, "codes"])

    bare = classes.select("label", "x", "rep", "size")
    schema = T.StructType([*bare.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])
    coded = materialize(bare.mapInArrow(hashed, schema), "vector-codes")
    step = 1 + PROBES
    spots = F.posexplode(F.expr("array_distinct(transform(codes, (c, i) -> struct(CAST(i DIV {0} AS INT) AS t, c AS code)))".format(step)))
    placed = coded.select("*", spots).select("label", F.size("x").alias("dim"), "rep", "size", "x", "codes", "col.t", "col.code")
    place = ["label", "dim", "t", "code"]
    large = coded.select("label", F.size("x").alias("dim"), spots).select("label", "dim", "col.t", "col.code").groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = placed.join(large, place).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})

    def links(group: pa.Table) -> pa.Table:
        first = {c: group.column(c)[0].as_py() for c in ("t", "code", "a", "b")}
        keys = np.stack(group.column("codes").to_numpy()).reshape(group.num_rows, -1, step)
        ids = group.column("rep").to_numpy()
        at, added, edges = bucket_links(ids, group.column("size").to_numpy(), _matrix(group.column("x")), keys, group.column("block").to_numpy(), (first["t"], first["code"]), (first["a"], first["b"]), least)
        none = pa.nulls(len(at), pa.int64())
        return pa.table({"u": pa.concat_arrays([pa.array(at), pa.array(edges[:, 0])]), "v": pa.concat_arrays([none, pa.array(edges[:, 1])]), "added": pa.concat_arrays([pa.array(added), pa.nulls(len(edges), pa.int64())])})

    found = materialize(placed.groupBy(*place, "a", "b").applyInArrow(links, "u long, v long, added long"), "vector-links")
    counts = found.where("v IS NULL").groupBy("u").agg(F.sum("added").alias("added"))
    joined = materialize(components(found.where("v IS NOT NULL").select("u", "v")), "vector-components")
    named = least_names(joined, classes)
    known = classes.join(counts, classes.rep == counts.u, "left").join(named, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("node").isNull(), F.col("name")).otherwise(F.col("best"))
    known = known.select(F.col("label").alias("l2"), F.col("x").alias("x2"), (F.col("size") - 1 + F.coalesce("added", F.lit(0))).alias("n"), component.alias("component"))
    out = rows.join(known, F.col("good") & (rows.label == F.col("l2")) & (rows.x == F.col("x2")), "left")
    component = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(prepare(spark), sf_dir, "embeddings"))


ORACLE = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(list_filter(embedding, lambda a: a <> 0)) > 0 AS good
  FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE a.good AND b.good AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS c FROM v UNION SELECT l.u, r.c FROM r JOIN l ON l.v = r.u)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN (SELECT u, min(c) AS component_id FROM r GROUP BY u) m ON m.u = v.vec_id
LEFT JOIN (SELECT u, count(*) AS n FROM l GROUP BY u) d ON d.u = v.vec_id"""
}
