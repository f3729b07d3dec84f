"""Ranked lexical search by pipelined term partitioning.

Terms of the items are dealt to owners by rarity. Documents lie in blocks; a block's postings go to the owner of their
term, which weighs them. Items travel in bundles: a bundle's accumulators over one block of documents (sparse: item,
document, score) visit one owner after another, the rarest terms' first, by cogroup, and each owner adds its integer
contributions. After each owner an accumulator is left behind if even the greatest contributions of the owners still to
come can't bring it to the score that k documents of its block have already; so none of the k best is lost, and ties are
kept. The last owner's k best of each block meet in the final selection.

Defined results: a null text has no terms; documents without terms count for nothing; repeated documents and null ids
are ranked like other rows (equal scores by ascending id, null first); each row of items is an item of its own, a
null id included; an item without terms, an empty table of either kind give no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.lookups import top

from .common import LOWER, UPPER, materialize, prepare, table

#: What separates terms, as a map of bytes: letters to lower case, digits and other alphabets stay, the rest is space.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents of a block and about as many terms, items of a bundle, and terms of items that are broadcast at once.
DOCUMENTS, WORDS, ITEMS, BLOCK = 4096, 1 << 22, 256, 500_000
#: Owners: terms in at most one of so many documents, rarest first; the last owner has the rest.
SHARES = (256, 16, 4, 1)
LIST = T.ArrayType(T.LongType(), False)
SHORT = T.ArrayType(T.IntegerType(), False)


def _place() -> int:
    """A number under which a task counts what it makes."""
    return TaskContext.get().partitionId() << 32


def bundled(items: DataFrame, item: str, text: str, size: int = ITEMS) -> DataFrame:
    """(bundle, slot, item, terms): items with terms, at most `size` to a bundle, their distinct terms in lower case."""
    kept = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("item", kept.schema["item"].dataType), T.StructField("terms", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            terms = [sorted({*(t or b"").translate(TERMS).split()}) for t in b.column(1).cast(pa.binary()).to_pylist()]
            some = [i for i, t in enumerate(terms) if t]
            at = range(n, n := n + len(some))
            yield pa.RecordBatch.from_arrays([pa.array([_place() + j // size for j in at], pa.int64()), pa.array([j % size for j in at], pa.int32()), b.column(0).take(pa.array(some, pa.int64())), pa.array([terms[i] for i in some], pa.list_(pa.binary()))], names=schema.names)

    return kept.mapInArrow(run, schema)


def postings(docs: DataFrame, terms: list[bytes], key: str, text: str, size: int = DOCUMENTS) -> DataFrame:
    """A row for each block of documents: ids and lengths (in terms) of its documents; which terms (by number) it holds,
    in how many documents and at most how often in one; and, term by term, the places and occurrences of those documents."""
    kept = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    kind = kept.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", LIST), *(T.StructField(c, SHORT) for c in ("terms", "held", "most", "places", "times"))])

    def pack(number: int, ids: list[pa.Array], sizes: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(found)), [len(x) for x in found])
        pairs, times = np.unique(np.concatenate(found) * len(found) + place, return_counts=True)
        term, place = np.divmod(pairs, len(found))
        some, first, held = np.unique(term, return_index=True, return_counts=True)
        most = np.maximum.reduceat(times, first) if len(first) else times
        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (some, held, most, place, times)]
        ids = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(ids))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), ids, pa.array([sizes], pa.list_(pa.int64())), *lists], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, number, total = known.value.get, _place(), 0
        ids, sizes, found = [], [], []
        for b in batches:
            for i, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                if len(sizes) == size or total >= WORDS:
                    yield pack(number, ids, sizes, found)
                    number, total, ids, sizes, found = number + 1, 0, [], [], []
                words = (t or b"").translate(TERMS).split()
                at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                ids.append(b.column(0).slice(i, 1))
                sizes.append(len(words))
                found.append(at[at >= 0])
                total += len(words)
        if sizes:
            yield pack(number, ids, sizes, found)

    return kept.mapInArrow(run, schema)


class Plan:
    """What owners and bundles know of the items of one broadcast: each bundle's pairs of term and slot, by term; weight,
    greatest contribution and owner of each term; documents with terms, and their terms."""

    def __init__(self, items: DataFrame):
        rows = items.select("bundle", "slot", "terms").collect()  # at most BLOCK terms, or one bundle's
        self.terms = sorted({bytes(t) for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((r["bundle"], number[bytes(t)], r["slot"]) for r in rows for t in r["terms"])
        bundle, term, slot = np.array(pairs, np.int64).reshape(-1, 3).T
        self.parts = {int(g): (term[bundle == g], slot[bundle == g]) for g in np.unique(bundle)}

    def weigh(self, found: DataFrame) -> Plan:
        """found: postings."""
        zero = F.lit(0).cast("long")
        size = found.select(F.size(F.filter("sizes", lambda x: x > 0)).cast("long").alias("n"), F.aggregate("sizes", zero, lambda a, x: a + x).alias("total"))
        self.n, self.total = (x or 0 for x in size.agg(F.sum("n"), F.sum("total")).first())
        counts = found.select(F.inline(F.arrays_zip("terms", "held", "most"))).groupBy("terms").agg(F.sum("held").alias("df"), F.max("most").alias("tf"))
        weight = F.floor(1000 * F.log((2 * F.lit(self.n) + 2) / (2 * F.col("df") + 1)))
        greatest = weight * F.expr("1000000000L * tf div (1000L * tf + 80)")  # no document's m is below 10
        owner = sum((F.when(F.col("df") * s > self.n, 1).otherwise(0) for s in SHARES[:-1]), F.lit(0))
        known = counts.select("terms", weight.alias("weight"), greatest.alias("greatest"), owner.alias("owner")).toPandas()  # a row a term
        at = known["terms"].to_numpy(np.int64)
        for c, missing in (("weight", 0), ("greatest", 0), ("owner", -1)):
            values = np.full(len(self.terms), missing, np.int64)
            values[at] = known[c]
            setattr(self, c, values)
        return self


def weighed(found: DataFrame, plan, stage: int) -> DataFrame:
    """(block, bundle, terms, held, places, adds): an owner's postings with their contributions, for each bundle with the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        wanted = {g: np.unique(term) for g, (term, _) in p.parts.items()}
        for b in batches:
            for i in range(b.num_rows):
                sizes, terms, held, places, times = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "terms", "held", "places", "times"))
                own = p.owner[terms] == stage
                each = np.repeat(own, held)
                terms, held, places, times = terms[own], held[own], places[each], times[each].astype(np.int64)
                m = 10 + (90 * sizes * p.n) // max(p.total, 1)
                adds = np.repeat(p.weight[terms], held) * ((1_000_000_000 * times) // (1000 * times + 8 * m[places]))
                for g, some in wanted.items():
                    mine = np.isin(terms, some, assume_unique=True)
                    if mine.any():
                        each = np.repeat(mine, held)
                        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (terms[mine], held[mine], places[each])]
                        yield pa.RecordBatch.from_arrays([b.column("block").slice(i, 1), pa.array([g], pa.int64()), *lists, pa.array([adds[each]], pa.list_(pa.int64()))], names=["block", "bundle", "terms", "held", "places", "adds"])

    return found.select("block", "sizes", "terms", "held", "places", "times").mapInArrow(run, "block long, bundle long, terms array<int>, held array<int>, places array<int>, adds array<long>")


def visited(state: DataFrame, own: DataFrame, plan, stage: int, k: int) -> DataFrame:
    """The bundles' accumulators after one owner has added its contributions."""

    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left
        p = plan.value
        term, slot = p.parts[key[1].as_py()]
        numbers = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        acc = np.zeros((int(slot.max()) + 1, len(left.column("ids").combine_chunks().flatten())), np.int64)
        acc[numbers(left, "slots"), numbers(left, "places")] = numbers(left, "scores")
        places, adds, at = numbers(right, "places"), numbers(right, "adds"), 0
        low, high = (np.searchsorted(term, numbers(right, "terms"), side) for side in ("left", "right"))
        for a, b, n in zip(low.tolist(), high.tolist(), numbers(right, "held").tolist(), strict=True):
            acc[slot[a:b, None], places[at : at + n]] += adds[at : at + n]
            at += n
        rest = np.zeros(len(acc), np.int64)
        later = p.owner[term] > stage
        np.add.at(rest, slot[later], p.greatest[term[later]])
        for i in range(len(acc)):
            some = acc[i][acc[i] > 0]
            if len(some) > k:
                acc[i][acc[i] + rest[i] < np.partition(some, len(some) - k)[len(some) - k]] = 0
        slots, at = np.nonzero(acc)
        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (slots, at)]
        return pa.Table.from_arrays([*(left.column(c) for c in ("block", "bundle", "ids")), *lists, pa.array([acc[slots, at]], pa.list_(pa.int64()))], names=left.schema.names)

    return state.groupBy("block", "bundle").cogroup(own.groupBy("block", "bundle")).applyInArrow(add, state.schema)


def _candidates(docs: DataFrame, items: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(bundle, slot, id, score): the k best documents of each item in each block, equal scores with the last of them too."""
    plan = Plan(items)
    found = materialize(postings(docs, plan.terms, key, text), "ranked-postings")
    held = docs.sparkSession.sparkContext.broadcast(plan.weigh(found))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    bundles = F.array(*map(F.lit, plan.parts)).cast("array<long>")
    state = found.select("block", F.explode(bundles).alias("bundle"), "ids", none("int").alias("slots"), none("int").alias("places"), none("long").alias("scores"))
    for stage in range(len(SHARES)):
        state = visited(state, weighed(found, held, stage), held, stage, k)
    out = state.select("bundle", "ids", F.inline(F.arrays_zip("slots", "places", "scores")))
    return out.select("bundle", F.col("slots").alias("slot"), F.get("ids", F.col("places")).alias("id"), F.col("scores").alias("score"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item, rank, key, score): the k documents of each item with the highest scores above 0.

    Both tables have a column `text`. Items are taken in blocks of about `block` terms, each of which reads the
    documents once.
    """
    known = materialize(bundled(items, item, text), "ranked-items")
    terms = known.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-terms // block)
    out = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("bundle", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("id", docs.schema[key].dataType), T.StructField("score", T.LongType())]))
    for i in range(parts):
        part = known.where(F.pmod(F.xxhash64("bundle"), F.lit(parts)) == i)
        if not part.isEmpty():
            found = _candidates(docs, part, k, key, text)
            out = out.unionByName(found) if i else found
    best = top(out, ["bundle", "slot"], [F.desc("score"), "id"], k)
    return best.join(known.drop("terms"), ["bundle", "slot"]).select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = {
    "op13_ranked_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words))::BIGINT AS total FROM d),
m AS (SELECT r, doc_id, 10 + (90 * len(words) * s.n) // s.total AS m FROM d, s WHERE len(words) > 0),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, s),
i AS (SELECT q, item_id, unnest(list_distinct(words)) AS term FROM (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS words FROM benchmark)),
x AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
y AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM y WHERE rank <= 10
"""
}
