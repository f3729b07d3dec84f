"""N-gram Jaccard self-join by prefix trees.

Documents with equal n-gram sets are one class. Classes that can have a partner at all are found from exact counts of
prefix tokens; their sets, ordered by a global rarity order, are split into families that share a token of their
necessary prefixes, so that no link crosses families. A family's sets are stored in a compressed trie; each set
traverses it, sharing partial overlaps between sets with equal beginnings and pruning subtrees by remaining-length
bounds. Families beyond BLOCK sets are cut in blocks of sets of similar size, joined within. One set of each component
found so far is then compared with the others', which makes a dense family one component; at last a set meets another
block only if that block holds a token of its prefix in a set of fitting size and another component, so no task holds an
unbounded family and near copies aren't copied to all blocks. A task returns a forest of the links it found, never all
pairs; components are then joined across tasks.

Words are compared by a keyed 64-bit digest, sets as a whole by 128 bits. Tokens that very many sets hold come last in
the first order of tokens and count as shared where they are seen, so they are never gathered.

Defined results: null and wordless texts have no n-grams and link with nothing; fewer words than n are one n-gram;
repeated rows and ties get the smallest id of their group; rows with equal ids and different texts are judged apart;
a null id is judged like any other, but a component is named by its smallest id that isn't null (null if it has none);
an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, BitFilter, components, least_names, materialize, prepare, shingle_hashes, table, word_hashes

FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Sets of a family that one task joins (twice as many for a pair of blocks), about.
BLOCK = 512
#: Tokens with at least this many sets may be known as hot; a task tells of this many at most, after each batch.
HOT, TOLD = 64, 8192
#: Rounds in which one set of each component found so far is compared, before the rest of a large family meets.
HEADS = 2
#: Salts over which the tokens of a large family are spread.
SALTS = 16
#: Tokens counted exactly for the rarity order: at most this many, those above an equal share of all occurrences.
FREQUENT = 100_000
#: Hashed cells that count the other tokens.
CELLS = 1 << 20


class Measure:
    """Jaccard similarity of at least num / 100, and the lengths of prefixes that links must share."""

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, n):
        """The least size of a partner of a set of n, and the least overlap with any partner."""
        return -(-n * self.percent // 100)

    def spare(self, n):
        """Members of a set of n that no partner needs to hold."""
        return n - self.least(n)

    def shared(self, n):
        """Tokens that a set of n shares, in prefixes of spare + shared tokens, with partners of its size."""
        return 1 + n * (100 - self.percent) // 100

    def wanted(self, n):
        """Tokens that a set of n shares with partners of any fitting size."""
        return self.shared(self.least(n))

    def bucket(self, n):
        """A number for sizes: sets that can link have the same or neighbouring ones."""
        n = np.asarray(n, np.int64)
        if self.percent >= 100:
            return n
        return np.floor(np.log(np.maximum(n, 1)) / (np.log(100 / self.percent) * (1 + 1e-9))).astype(np.int64)

    def links(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)


def _gram_hashes(texts: list[str | None], n: int, at_once: int = 50_000) -> Iterator[np.ndarray]:
    """Two hashes (rows) of each text's n-grams; words are parted by ASCII blanks, A-Z are lower-cased.

    The n-grams of many texts are hashed at once; those that would join two texts are passed over.
    """
    held: list[list[bytes]] = []

    def hashed() -> Iterator[np.ndarray]:
        h = word_hashes([w for words in held for w in words])
        grams, at = shingle_hashes(h, n), 0
        for words in held:
            k = len(words)
            yield grams[:, at : at + k - n + 1] if k >= n else shingle_hashes(h[:, at : at + k], n)
            at += k

    size = 0
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").translate(FOLD).split() if t else []
        if held and size + len(words) > at_once:
            yield from hashed()
            held, size = [], 0
        held.append(words)
        size += len(words)
    yield from hashed()


def token_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams."""
    return (np.unique(g[0]) for g in _gram_hashes(texts, n))


def signed_sets(texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """token_sets with two 64-bit digests of each set over both hashes of its n-grams; 0, 0 of the empty one."""
    for g in _gram_hashes(texts, n):
        tokens, at = np.unique(g[0], return_index=True)
        yield tokens, *(struct.unpack("<qq", hashlib.blake2b(tokens.tobytes() + g[1, at].tobytes(), digest_size=16).digest()) if len(tokens) else (0, 0))


class Tally:
    """The tokens that most of the sets seen so far hold, about: less frequent ones are forgotten after each batch."""

    def __init__(self):
        self.tokens, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, sets: list[np.ndarray]) -> None:
        if not sets:
            return
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts > 1
        tokens, where = np.unique(np.concatenate([self.tokens, tokens[often]]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([self.counts, counts[often]]), len(tokens)).astype(np.int64)
        if len(tokens) > TOLD:
            best = np.sort(np.argpartition(-counts, TOLD)[:TOLD])
            tokens, counts = tokens[best], counts[best]
        self.tokens, self.counts = tokens, counts


class Seen:
    """Remembers sets by their digests, a bounded number of them."""

    def __init__(self, most: int = 500_000):
        self.known, self.most = set(), most

    def new(self, key: tuple[int, int]) -> bool:
        if key in self.known:
            return False
        if len(self.known) >= self.most:
            self.known.clear()
        self.known.add(key)
        return True


def _signatures(docs: DataFrame, columns: list[str], text: str, n: int) -> DataFrame:
    """(columns, n, s1, s2, t) of every row, t a hash of its text, and (null, -1, token, count) of tokens that many sets of a
    task hold."""
    kept = [T.StructField(f.name, f.dataType) for f in docs.select(*columns).schema.fields]
    schema = T.StructType([*kept, *T.StructType.fromDDL("n long, s1 long, s2 long, t long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, seen, kinds = Tally(), Seen(), None
        for b in batches:
            sets = list(signed_sets(b.column(len(columns)).to_pylist(), n))
            tally.add([s for s, *key in sets if len(s) and seen.new(tuple(key))])
            old = b.columns[: len(columns)]
            kinds = [c.type for c in old]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(x, pa.int64()) for x in zip(*[(len(s), *key) for s, *key in sets], strict=True)), b.columns[-1]] if sets else [*old, *[b.columns[-1]] * 4], names=schema.names)
        if kinds is not None:
            k = len(tally.tokens)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in kinds), pa.array(np.full(k, -1)), pa.array(tally.tokens.view(np.int64)), pa.array(tally.counts), pa.nulls(k, pa.int64())], names=schema.names)

    return docs.select(*columns, F.col(text), F.xxhash64(text)).mapInArrow(run, schema)


class Hot:
    """Tokens that very many sets hold, with their counts; at most FREQUENT, whatever the input."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]

    @classmethod
    def of(cls, signatures: DataFrame) -> Hot:
        told = signatures.where("n = -1").groupBy(F.col("s1").alias("token")).agg(F.sum("s2").alias("n"))
        total = told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        got = told.where(F.col("n") >= max(HOT, total // FREQUENT)).toArrow()  # at most FREQUENT rows
        return cls(got.column("token").to_numpy(), got.column("n").to_numpy())

    def counted(self, tokens: np.ndarray) -> np.ndarray:
        """The count of each hot token, 0 of others."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)


def _prefix_tokens(docs: DataFrame, text: str, n: int, measure: Measure, hot: Hot) -> DataFrame:
    """(token, s1, n): the first spare + shared tokens of each set, hot ones last; a task gives a set once.

    Hot tokens are shared surely: they are only counted, in one row of the set with its own place and n > 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            tokens, owners, counts = [], [], []
            for s, *key in signed_sets(b.column(text).to_pylist(), n):
                if len(s) and seen.new(tuple(key)):
                    s, k = s.view(np.int64), measure.spare(len(s)) + measure.shared(len(s))
                    often = held.value.counted(s)
                    p = np.lexsort((s, often))[:k]
                    rare = s[p[often[p] == 0]]
                    many = len(p) - len(rare)
                    tokens += [rare, [key[0]] * (many > 0)]
                    counts += [np.zeros(len(rare), np.int64), [many] * (many > 0)]
                    owners.append(np.full(len(rare) + (many > 0), key[0], np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (tokens, owners, counts)], names=["token", "s1", "n"])

    return docs.select(text).mapInArrow(run, "token long, s1 long, n long")


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, s1): how many tokens each s1 shares with another; holds one row between batches.

    Rows with n > 0 are counts already; of a set's copies from several tasks the counts are equal, one is taken.
    """
    held, held_shared = np.empty((0, 3), np.int64), False

    def give(rows: np.ndarray) -> pa.RecordBatch:
        s1, at = np.unique(rows[:, 1], return_inverse=True)
        n = np.bincount(at, np.maximum(rows[:, 2], 1), len(s1))
        return pa.RecordBatch.from_arrays([pa.array(s1), pa.array(n.astype(np.int64))], names=["s1", "n"])

    for b in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns], 1)])
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])]
        same = rows[1:, 0] == rows[:-1, 0]
        shared = rows[:, 2] > 0
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= held_shared and len(held) > 0
        held, held_shared = rows[-1:], bool(shared[-1])
        if shared[:-1].any():
            yield give(rows[:-1][shared[:-1]])
    if held_shared:
        yield give(held)


def _sets_of(docs: DataFrame, text: str, n: int, wanted: BitFilter, measure: Measure) -> DataFrame:
    """(s1, s2, bucket, tokens) of the texts whose hash may be wanted, the only ones that are cut again; a task gives a set once."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            rows = []
            have = bits.value.has(b.column(1).to_numpy())
            for s, *key in signed_sets(b.column(0).filter(pa.array(have)).to_pylist(), n):
                if len(s) and seen.new(tuple(key)):
                    rows.append((*key, s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(measure.bucket([len(r[2]) for r in rows]), pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["s1", "s2", "bucket", "tokens"])

    return docs.select(F.col(text), F.xxhash64(text)).mapInArrow(run, "s1 long, s2 long, bucket long, tokens array<long>")


class Rarity:
    """A total order of tokens, the rarest first: exact counts of frequent tokens after counts of hashed cells of others.

    Any total order gives the same links; this one is of fixed size (FREQUENT tokens and CELLS cells) and keeps tokens
    that many sets share out of the prefixes. Ties go by the token.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, cells: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts, self.cells = tokens[order], counts[order], cells

    @classmethod
    def count(cls, tokens: DataFrame) -> Rarity:
        """Of the one column `token`, with repetition."""
        seen = materialize(tokens.groupBy("token").count(), "token-counts")
        total = seen.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
        most = max(2, total // FREQUENT)
        often = seen.where(F.col("count") > most).toArrow()  # at most FREQUENT rows
        rest = seen.where(F.col("count").between(2, most)).groupBy(F.col("token").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).agg(F.sum("count").alias("n")).toArrow()  # at most CELLS rows
        cells = np.zeros(CELLS, np.int32)
        cells[rest.column("cell").to_numpy()] = np.minimum(rest.column("n").to_numpy(), most)
        return cls(often.column("token").to_numpy(), often.column("count").to_numpy(), cells)

    def order(self, tokens: np.ndarray) -> np.ndarray:
        """Places that sort tokens, the rarest first."""
        count = self.cells[tokens & (CELLS - 1)].astype(np.int64)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            count = np.where(self.tokens[at] == tokens, self.counts[at], count)
        return np.lexsort((tokens, count))


def _local_edges(batches: Iterator[pa.RecordBatch], prefix_of, measure: Measure) -> Iterator[pa.RecordBatch]:
    """Of sets (rep, bucket, tokens), batch by batch: (token, bucket, u, null) for the first set u of a token and bucket,
    and (u, -1, v, u) for other sets v of it: however many sets hold a token, a batch sends it once a bucket."""
    for b in batches:
        rows = [np.empty((0, 3), np.int64)]
        tokens = b.column("tokens")
        for i, (rep, bucket) in enumerate(zip(b.column("rep").to_pylist(), b.column("bucket").to_pylist(), strict=True)):
            p = prefix_of(tokens[i].values.to_numpy())
            rows.append(np.stack([p, np.full(len(p), bucket), np.full(len(p), rep)], 1))
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])[: len(rows)]
        lead = rows[first][np.cumsum(first) - 1, 2] if len(rows) else rows[:, 2]
        pairs = np.unique(np.stack([lead[~first], rows[~first, 2]], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((rows[first, 0], pairs[:, 0]), (rows[first, 1], np.full(len(pairs), -1)), (rows[first, 2], pairs[:, 1]), (np.full(first.sum(), -1), pairs[:, 0]))], names=["token", "bucket", "u", "v"])


def _family_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, bucket, u): links between neighbours of fitting buckets, a chain and not all pairs; links pass."""
    held = np.empty((0, 4), np.int64)
    for b in batches:
        rows = np.stack([c.to_numpy() for c in b.columns], 1)
        known = rows[rows[:, 1] < 0][:, 2:]
        rows = np.concatenate([held, rows[rows[:, 1] >= 0]])
        link = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] - rows[:-1, 1] <= 1) & (rows[1:, 2] != rows[:-1, 2])
        pairs = np.unique(np.concatenate([np.stack([rows[1:, 2][link], rows[:-1, 2][link]], 1), known]), axis=0)
        held = rows[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


class Trie:
    """Sets as sorted arrays of ranks, in lexical order, in a compressed trie.

    A node is (low, high, depth, end, children): sets low..high share their first `end` ranks; the node's own part is
    depth..end; sets that end there need no child.
    """

    def __init__(self, sets: list[np.ndarray], measure: Measure, sides: np.ndarray | None = None):
        """sides: a number for each set; with them, only sets of different sides are compared."""
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.sets, self.measure = [sets[i] for i in self.order], measure
        self.n = np.array([len(s) for s in self.sets])
        self.sides = None if sides is None else np.asarray(sides)[self.order]
        self.labels = np.arange(len(sets))
        self.mark = np.zeros(1 + max((int(s[-1]) for s in self.sets if len(s)), default=0), bool)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 2 * len(sets)))  # nested sets nest nodes
        self.root = self._node(0, len(sets), 0)

    def _node(self, low: int, high: int, depth: int):
        a, b = self.sets[low], self.sets[high - 1]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:m] != b[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        children, at = [], low
        while at < high and len(self.sets[at]) == end:
            at += 1
        while at < high:
            first, stop, top = self.sets[at][end], at + 1, high
            while stop < top:  # the sets that go on with the same rank
                mid = (stop + top) // 2
                if self.sets[mid][end] == first:
                    stop = mid + 1
                else:
                    top = mid
            children.append((at, stop))
            at = stop
        n = self.n[low:high]
        return (low, high, depth, end, [self._node(x, y, end) for x, y in children] if len(children) > 0 else [], int(n.min()), int(n.max()))

    def join(self) -> None:
        """Labels sets by the components of their links; sets in one component aren't compared again.

        A set's candidates are the sets before it that share a token of both necessary prefixes and fit in size; only
        subtrees with candidates are visited.
        """
        prefix = [s[: self.measure.spare(len(s)) + 1] for s in self.sets]
        owner = np.repeat(np.arange(len(prefix)), [len(p) for p in prefix])
        order = np.argsort(np.concatenate(prefix), kind="stable")  # owners of a token stay in order
        token = np.concatenate(prefix)[order]
        first = np.concatenate([[True], token[1:] != token[:-1]])
        begin = np.empty(len(order), np.int64)
        begin[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owners = owner[order]
        at = np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
        least = self.measure.least(self.n)
        for i, x in enumerate(self.sets):
            low, n = begin[at[i] : at[i + 1]], (place - begin)[at[i] : at[i + 1]]
            if not n.sum():
                continue
            near = np.unique(owners[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())])
            near = near[(self.labels[near] != self.labels[i]) & (self.n[near] >= least[i]) & (least[near] <= self.n[i])]
            if self.sides is not None:
                near = near[self.sides[near] != self.sides[i]]
            if len(near):
                self.mark[x] = True
                self._visit(i, x, near.tolist())
                self.mark[x] = False

    def _visit(self, i: int, x: np.ndarray, near: list[int]) -> None:
        percent, size, labels, todo = self.measure.percent, len(x), self.labels, [(self.root, 0, 0, len(near))]
        while todo:
            (low, high, depth, end, children, least, most), overlap, a, b = todo.pop()
            a, b = bisect_left(near, low, a, b), bisect_left(near, high, a, b)
            if a == b or (b - a == 1 and labels[near[a]] == labels[i]):
                continue  # no candidate below
            part = self.sets[low][depth:end]
            overlap += int(np.count_nonzero(self.mark[part]))
            rest = size - int(x.searchsorted(part[-1], "right")) if len(part) else size
            if (100 + percent) * (overlap + min(rest, most - end)) < percent * (size + least):
                continue
            while a < b and self.n[near[a]] == end:  # candidates that end at this node
                if self.measure.links(overlap, size, end) and labels[near[a]] != labels[i]:
                    one, other = sorted((labels[i], labels[near[a]]))
                    labels[labels == other] = one
                a += 1
            todo += [(c, overlap, a, b) for c in reversed(children)]

    def links(self) -> list[tuple[int, int]]:
        """A forest of the links by the sets' places: (set, first set of its component)."""
        return [(self.order[i], self.order[r]) for i, r in enumerate(self.labels.tolist()) if i != r]


def join_group(ids: np.ndarray, tokens: list[np.ndarray], rarity: Rarity, measure: Measure, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    known = np.unique(np.concatenate(tokens))
    rank = np.empty(len(known), np.int64)
    rank[rarity.order(known)] = np.arange(len(known))
    trie = Trie([np.sort(rank[np.searchsorted(known, t)]) for t in tokens], measure, sides)
    trie.join()
    return [(int(ids[a]), int(ids[b])) for a, b in trie.links()]


def _placed(family: DataFrame) -> DataFrame:
    """family(component, bucket, rep) with the block `at` of each set: -1 in families of at most BLOCK sets, else the
    bucket of its size and a hash, about BLOCK sets."""
    sizes = family.groupBy("component", "bucket").agg(F.count("*").alias("some"))
    whole = sizes.groupBy("component").agg(F.sum("some").alias("all"))
    parts = sizes.join(whole, "component").where(F.col("all") > BLOCK).select("component", "bucket", F.ceil(F.col("some") / BLOCK).alias("parts"))
    parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a large family has many members
    placed = family.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(parts, ["component", "bucket", "salt"], "left")
    code = F.coalesce(F.shiftleft("bucket", 20) + F.pmod(F.xxhash64("rep"), F.col("parts")), F.lit(-1))
    return placed.select("component", "bucket", "rep", code.alias("at"))


def _family_tokens(large: DataFrame, prefix_of) -> DataFrame:
    """(component, bucket, at, rep, token) of the prefix tokens of the sets of large families, large(..., tokens)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [prefix_of(t.values.to_numpy()) for t in b.column("tokens")]
            n = [len(p) for p in held]
            columns = [pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("component", "bucket", "at", "rep")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([np.empty(0, np.int64), *held]))], names=["component", "bucket", "at", "rep", "token"])

    return materialize(large.mapInArrow(explode, "component long, bucket long, at long, rep long, token long"), "family-tokens")


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows(rep, ...) with the component of each set by the links found so far, itself where it has none."""
    linked = components(links.join(rows.select(F.col("rep").alias("u")).distinct(), "u", "left_semi")).toDF("node", "label")
    out = rows.join(linked, rows.rep == linked.node, "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
    return materialize(out, "family-labels")


def _heads(rows: DataFrame) -> DataFrame:
    """(component, bucket, rep): one set for each label of each token that has several labels."""
    each = rows.groupBy("component", "token", "bucket", "label").agg(F.min("rep").alias("rep"))
    several = each.groupBy("component", "token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("component", "token")
    return each.join(several, ["component", "token"], "left_semi").select("component", "bucket", "rep").distinct()


def _meetings(rows: DataFrame) -> DataFrame:
    """(component, a, b, at, rep): the groups of two blocks in which each set of rows(component, bucket, at, rep, token, label)
    is compared: its own block and each other that holds a token of its prefix, in a fitting bucket and with another label."""
    blocks = rows.groupBy(F.col("component").alias("c"), F.col("token").alias("t"), F.col("bucket").alias("k"), F.col("at").alias("other")).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    fits = (F.col("component") == F.col("c")) & (F.col("token") == F.col("t")) & (mine.salt == blocks.salt) & (F.abs(F.col("bucket") - F.col("k")) <= 1) & (F.col("at") != F.col("other"))
    fits &= (F.col("label") != F.col("low")) | (F.col("label") != F.col("high"))
    return mine.join(blocks, fits).select("component", F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"), "at", "rep").distinct()


def similar_classes(docs: DataFrame, classes: DataFrame, hot: Hot, text: str, n: int, measure: Measure) -> DataFrame:
    """Links (u, v) between classes(s1, s2, n, rep, t), t the hash of one of its texts, by rep: a forest with the components of all links."""
    spark = docs.sparkSession
    tokens = _prefix_tokens(docs, text, n, measure, hot).repartition("token").sortWithinPartitions("token", "s1")
    shared = tokens.mapInArrow(_shared_counts, "s1 long, n long").groupBy("s1").agg(F.sum("n").alias("shared"))
    least = F.ceil(F.col("n") * measure.percent / 100)
    alive = classes.join(shared, "s1").where(F.col("shared") >= 1 + F.floor(least * (100 - measure.percent) / 100))
    alive = materialize(alive.select("s1", "s2", "rep", "t"), "alive")
    wanted = BitFilter.build(alive.select("t"), alive.count())
    sets = _sets_of(docs, text, n, wanted, measure).join(alive.drop("t"), ["s1", "s2"]).dropDuplicates(["rep"]).select("rep", "bucket", "tokens")
    sets = materialize(sets, "sets")
    rarity = spark.sparkContext.broadcast(Rarity.count(sets.select(F.explode("tokens").alias("token"))))

    def prefix_of(t: np.ndarray) -> np.ndarray:
        return t[rarity.value.order(t)[: measure.spare(len(t)) + 1]]

    rows = sets.mapInArrow(lambda batches: _local_edges(batches, prefix_of, measure), "token long, bucket long, u long, v long")
    edges = rows.repartition("token").sortWithinPartitions("token", "bucket", "u").mapInArrow(_family_edges, "u long, v long").distinct()
    family = components(edges).join(sets.select(F.col("rep").alias("node"), "bucket"), "node")
    family = materialize(family.select("component", "bucket", F.col("node").alias("rep")), "families")

    def join(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
        found = join_group(group.column("rep").to_numpy(), [x.values.to_numpy() for x in group.column("tokens")], rarity.value, measure, None if a == b else group.column("at").to_numpy())
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    def compared(member: DataFrame) -> DataFrame:
        # written before components are found: one Python step a stage needs half the workers
        return materialize(member.select("component", "a", "b", "at", "rep", "tokens").groupBy("component", "a", "b").applyInArrow(join, "u long, v long"), "links")

    def own(placed: DataFrame) -> DataFrame:
        return placed.withColumns({"a": F.col("at"), "b": F.col("at")})

    def some_of(groups: DataFrame) -> DataFrame:
        """groups(component, a, b, at, rep) with their sets; only sets that some group may have are moved."""
        groups = materialize(groups.select("component", "a", "b", "at", "rep"), "groups")
        wanted = BitFilter.build(groups.select("rep"), groups.count())
        return groups.join(large.select("rep", "tokens").where(wanted.column(spark, F.col("rep"))), "rep")

    placed = materialize(sets.drop("bucket").join(_placed(family), "rep").select("component", "bucket", "at", "rep", "tokens"), "placed-sets")
    links, large = compared(own(placed)), placed.where("at >= 0")
    if large.isEmpty():
        return links
    # Blocks of a large family have their links. What they have in common is found first by one set of each component so
    # far, as near copies are one component soon; then sets of different components meet, however many there are.
    tokens = _family_tokens(large, prefix_of)
    rows = _labelled(tokens, links)
    for _ in range(HEADS):
        more = compared(some_of(own(_placed(_heads(rows)))))
        if more.isEmpty():
            break
        links = links.unionByName(more)
        rows = _labelled(tokens, links)
    return links.unionByName(compared(some_of(_meetings(rows))))


def ngram_classes(docs: DataFrame, columns: list[str], name: Column, text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(columns, n, name) of every row: the least name (an expression over columns, nulls aside) of the rows in the
    component of the row's n-gram set; null without n-grams."""
    measure = Measure(percent)
    signed = materialize(_signatures(docs, columns, text, n), "signatures")
    hot, rows = Hot.of(signed), signed.where("n >= 0")
    classes = rows.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(name).alias("name"), F.min("t").alias("t")).withColumn("rep", F.monotonically_increasing_id())
    classes = materialize(classes, "classes")  # numbers are fixed by writing them
    linked = materialize(components(similar_classes(docs, classes, hot, text, n, measure)), "linked-classes")
    named = least_names(linked, classes)
    known = classes.join(named, classes.rep == named.node, "left").select("s1", "s2", F.col("n").alias("n0"), F.when(F.col("node").isNull(), F.col("name")).otherwise(F.col("best")).alias("name"))
    out = rows.join(known, (rows.s1 == known.s1) & (rows.s2 == known.s2) & (rows.n == F.col("n0")), "left")
    return out.select(*[rows[c] for c in columns], rows.n, known.name)


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id) of every row: components of links with Jaccard similarity >= percent / 100."""
    ids = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = ngram_classes(ids, ["id"], F.col("id"), "text", n, percent)
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(prepare(spark), sf_dir, "documents"))
