"""Streams: feedback by day with late and repeated rows dropped, and documents into an index that merges its batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as tx
from corpusloom.operators import chunks, documents


def daily_feedback(stream: DataFrame, time: str = "timestamp", late: str = "1 day", unique: str | None = None) -> DataFrame:
    """Counts by event day and type; rows later than the watermark are dropped, and the state of days before it with them.

    unique: a column by which repeats within the watermark are dropped.
    """
    s = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    s = s.dropDuplicatesWithinWatermark([unique]) if unique else s
    return s.groupBy(F.window(time, "1 day").alias("w"), "type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "type", "n")


def run_available(out: DataFrame, folder: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Processes what there is; each batch's rows go to a folder of its number, so a batch that runs again overwrites itself.

    In update mode a batch holds the rows that it changed: read_counts() takes the last one of each.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, folder: str, keys: list[str], value: str = "n") -> DataFrame:
    """The last value that any batch wrote for each key."""
    rows = spark.read.option("basePath", folder).parquet(folder)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


class Index:
    """Documents and their chunks in a folder that batches are merged into.

    A batch is written under its number as a delta: `docs` has a row for each of its documents with its version (a document
    without chunks is a tombstone), `chunks` their chunks. After every `every` deltas they are merged with the base
    before them into a new base, named by the last batch that it holds; what a base holds is deleted when the next
    base is there, so that a reader of the one before isn't disturbed. A base counts once Spark has marked it complete, so
    a merge that was cut off is made anew. A batch at or before the base that runs again changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, order: str = "version", every: int = 5):
        self.spark, self.folder, self.order, self.every = spark, folder, order, every

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def numbers(self, kind: str) -> list[int]:
        """Numbers of the complete bases or deltas, ascending; a folder of few entries is listed."""
        at = self._path(kind)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit() and all(fs.exists(self._path(kind, n, part, "_SUCCESS")) for part in ("docs", "chunks")))

    def _delete(self, kind: str, number: int) -> None:
        at = self._path(kind, str(number))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _parts(self) -> list[tuple[str, int]]:
        """The last base and the deltas after it."""
        base = self.numbers("base")[-1:]
        return [("base", n) for n in base] + [("delta", n) for n in self.numbers("delta") if not base or n > base[0]]

    def _read(self, part: str) -> DataFrame | None:
        out = None
        for kind, n in self._parts():
            rows = self.spark.read.parquet(f"{self.folder}/{kind}/{n}/{part}")
            rows = rows if kind == "base" else rows.withColumn("batch", F.lit(n))
            out = rows if out is None else out.unionByName(rows)
        return out

    def last(self) -> DataFrame | None:
        """(stem, version, batch): the last version of each document, and the last batch that brought it."""
        docs = self._read("docs")
        return None if docs is None else docs.groupBy("stem").agg(F.max(F.struct(self.order, "batch")).alias("last")).select("stem", "last.*")

    def _current(self) -> tuple[DataFrame, DataFrame] | None:
        last = self.last()
        if last is None:
            return None
        rows = self._read("chunks")
        at = last.select(F.col("stem").alias("__stem"), F.col(self.order).alias("__order"), F.col("batch").alias("__batch"))
        same = rows["stem"].eqNullSafe(at["__stem"]) & rows[self.order].eqNullSafe(at["__order"]) & (rows["batch"] == at["__batch"])
        return last, rows.join(at, same, "left_semi")

    def chunks(self) -> DataFrame | None:
        """The chunks of each document's last version; None before the first batch."""
        now = self._current()
        return None if now is None else now[1].drop("batch")

    def add(self, batch: DataFrame, number: int, key: str = "id") -> None:
        """Writes a batch of documents(key, version, text) as a delta, the latest row of each key, and merges if it is time."""
        if any(n >= number for n in self.numbers("base")):
            return
        docs = documents.latest(batch, key, [F.desc(self.order)]).select(F.col(key).alias("stem"), self.order, tx.normalize_text(F.col("text")).alias("text"))
        at = f"{self.folder}/delta/{number}"
        docs.select("stem", self.order).write.mode("overwrite").parquet(f"{at}/docs")
        chunks.chunk_rows(docs).write.mode("overwrite").parquet(f"{at}/chunks")
        if sum(kind == "delta" for kind, _ in self._parts()) >= self.every:
            self.merge()

    def merge(self) -> None:
        """Makes a base of the last one and the deltas after it, and deletes what the last base held already."""
        parts = self._parts()
        number, before = max(n for _, n in parts), self.numbers("base")
        docs, rows = self._current()
        docs.write.mode("overwrite").parquet(f"{self.folder}/base/{number}/docs")
        rows.write.mode("overwrite").parquet(f"{self.folder}/base/{number}/chunks")
        for old in before[:-1]:
            self._delete("base", old)
        for old in self.numbers("delta"):
            if before and old <= before[-1]:
                self._delete("delta", old)


def ingest(stream: DataFrame, index: Index, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Upserts a stream of documents(key, version, text) into an index of chunks."""
    return stream.writeStream.foreachBatch(lambda batch, number: index.add(batch, number, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
