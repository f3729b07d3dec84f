"""Periodic runs of words, by a dictionary of basic factors.

Every factor of 2**k words of a text gets a name, equal factors the same one, from the names of its halves; factors that
occur once are forgotten, as nothing longer that begins there can repeat. A run with period q and at least four
periods holds, at the level whose length is the least power of two from q on, three successive occurrences of one factor
at distances of q: an arithmetic progression within twice that length. So each level's progressions propose periods;
proposals are extended both ways by the names of all levels, longest first, and equal stretches keep the least period.
Any number of texts is treated at once, as names of different texts differ.

Defined results: a null text and one without words have no runs and collapse to an empty text; repeated rows and null
ids are judged like any other row; an empty table gives no rows; columns of docs other than the key are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.arrays import bound

from .common import prepare, table

#: Least words and periods of a run.
LEAST, PERIODS = 6, 4
#: Bytes of text that are named together; a longer text stands alone.
SLICE = 4 << 20
#: What separates words.
SPACE = r"[\x20\x09-\x0D]+"
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


class Factors:
    """Names of the factors of 2**k words, at each place of words that lie one text after another; -1 where a factor is
    unique or crosses the end of its text. doc numbers each place's text, in ascending order."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.n = len(words)
        size = np.bincount(doc)
        self.stop = np.cumsum(size)[doc]
        self.begin = self.stop - size[doc]
        self.names: list[np.ndarray] = []
        self.proposed: list[tuple[np.ndarray, np.ndarray]] = []
        longest, length, at = int(size.max(initial=0)), 1, np.arange(self.n)
        key = doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        while len(at):
            name = self._name(at, key, length)
            at = at[name[at] >= 0]
            if not len(at) or 4 * length > longest:
                break
            at = at[at + 2 * length <= self.stop[at]]
            at = at[name[at + length] >= 0]
            key = name[at].astype(np.int64) * self.n + name[at + length]
            length *= 2

    def _name(self, at: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(at), bool)
        again[1:] |= same
        again[:-1] |= same
        name = np.full(self.n, -1, np.int32)
        name[at] = np.where(again, np.cumsum(np.concatenate([[0], ~same])), -1)
        self.names.append(name)
        gap = at[1:] - at[:-1]
        three = same[1:] & same[:-1] & (gap[1:] == gap[:-1]) & (gap[1:] <= 2 * length) & (2 * gap[1:] > length)
        place, period = at[:-2][three], gap[1:][three]
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        first = np.ones(len(place), bool)  # places next to each other with one period lie in one run
        first[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)
        self.proposed.append((place[first], period[first]))
        return name

    def _reach(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        """Words that agree from places a and b on, or before them; a < b in the same text."""
        got = np.zeros(len(a), np.int64)
        low, high = self.begin[a], self.stop[a]
        for k in reversed(range(len(self.names))):
            name, length = self.names[k], 1 << k
            while True:
                x, y = (a - got - length, b - got - length) if back else (a + got, b + got)
                fits = (x >= low) & (y < high)
                x, y = np.where(fits, x, 0), np.where(fits, y, 0)
                fits &= (name[x] >= 0) & (name[x] == name[y])
                got += length * fits
                if k + 1 < len(self.names) or not fits.any():  # only the greatest length may be needed again
                    break
        return got

    def runs(self, least: int = LEAST, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and period of each run, by start and period."""
        place = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in self.proposed)])
        period = np.concatenate([np.zeros(0, np.int64), *(q for _, q in self.proposed)])
        start = place - self._reach(place, place + period, back=True)
        end = place + period + self._reach(place, place + period, back=False)
        fits = end - start >= np.maximum(least, periods * period)
        start, end, period = start[fits], end[fits], period[fits]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[first], end[first], period[first]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def _slices(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of each text, in lists of texts of bounded size."""
    held, size = [], 0
    for t in texts:
        t = t or b""
        if held and size + len(t) > SLICE:
            yield held
            held, size = [], 0
        held.append(t.split())  # bytes are split at the ASCII spaces alone
        size += len(t)
    if held:
        yield held


def _collapsed(texts: list[list[bytes]], least: int, periods: int) -> Iterator[tuple[list[dict], bytes]]:
    """The runs of each text and what is left of it: runs keep their first period."""
    number: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    words = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, sum(sizes))
    starts, ends, periods_ = Factors(words, np.repeat(np.arange(len(texts)), sizes)).runs(least, periods)
    low = np.cumsum([0, *sizes])
    cut = np.searchsorted(starts, low)
    for i, t in enumerate(texts):
        if cut[i] == cut[i + 1]:
            yield [], b" ".join(t)
            continue
        s, e, q = (x[cut[i] : cut[i + 1]] - o for x, o in ((starts, low[i]), (ends, low[i]), (periods_, 0)))
        over = np.zeros(len(t) + 1, np.int64)
        np.add.at(over, s + q, 1)
        np.add.at(over, e, -1)
        kept = np.flatnonzero(np.cumsum(over)[:-1] == 0)
        yield [{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), (e - s).tolist(), q.tolist(), strict=True)], b" ".join([t[j] for j in kept.tolist()])


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """(key, runs, collapsed): all periodic runs of each text by start and period, in words from 0, and the text's words
    without those that any run holds after its first period, joined by one space.

    A run has at least `least` words and `periods` (four or more) times its smallest period.
    """
    if periods < PERIODS:
        raise ValueError("progressions of three factors are sure only in runs of four periods or more")
    kept = docs.select(key, text)
    out = T.StructType([kept.schema[0], T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for texts in _slices(b.column(1).cast(pa.binary()).to_pylist()) for x in _collapsed(texts, least, periods)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], pa.binary()).cast(pa.string())], names=out.names)

    return kept.mapInArrow(run, out)


def greatest(runs: Column) -> Column:
    """The run with the greatest exact quotient of length and period, the first of equal ones; null where there is none."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(more(best, r), r).otherwise(best))


def looped(docs: DataFrame) -> DataFrame:
    """documents with op12's given change: words of a tenth of the texts, by a checksum of the id, repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")

    def again(w: Column) -> Column:
        n, g = F.size(w), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(at, " ")).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, bound(words, again)).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_runs(looped(table(prepare(spark), sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = greatest(F.col("runs"))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
