"""WARC archives with an index: records are written with their offsets first, then read by coalesced byte ranges.

Writing tasks append records, one gzip member each, to files of their own in a folder that all executors share, and
return one index row a record: file, offset, length, URL and digest. The index table is the commit: a file left by a
lost executor's attempt is in no index and so is never read. Reading takes selected index rows, sorts them by file and
offset, joins neighbours into ranges and opens each range once.

Defined results: a null payload is empty; of records with equal payloads of at least min_revisit bytes the one with
the smallest key is the response and the others revisit it (repeated rows of that key are responses too); a null URL
gives no target header, and blanks or control characters in one are percent-encoded; an empty table gives an empty
index. Extra columns of the pages are left out of the archives.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare, scratch, table

INDEX = "page_id long, url string, file string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: A file is closed beyond this size; a read range spans at most this; a gap between records up to this is read over.
FILE_BYTES, RANGE_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 100) -> DataFrame:
    """(page_id, url, payload binary, payload_bytes, payload_digest, record_type, refers_to) of pages.

    Only digests that repeat are joined back; the join's other side has one row a digest, so a payload that
    a third of all pages share is a skewed join that adaptive execution splits.
    """
    body = F.coalesce(F.encode(F.col(payload), "utf-8"), F.lit(b""))
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    p = p.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    long_ones = p.where(F.col("payload_bytes") >= min_revisit)
    first = long_ones.groupBy(F.col("payload_digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    p = p.join(first, p.payload_digest == first.d, "left")
    again = F.coalesce((F.col("payload_bytes") >= min_revisit) & (F.col("first") != F.coalesce("page_id", F.col("first") - 1)), F.lit(False))
    return p.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def _member(kind: str, headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _encode(row: dict, level: int) -> bytes:
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    target = row["url"] and re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), row["url"])
    headers = [("WARC-Record-ID", name(row["page_id"])), ("WARC-Target-URI", target or None), ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}")]
    if row["record_type"] == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(row["refers_to"])), ("X-Payload-Length", row["payload_bytes"])]
        return _member("revisit", headers, b"", level)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    return _member("response", [*headers, ("Content-Type", "application/http; msgtype=response")], head.encode() + row["payload"], level)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme by which Spark itself would read it, so that workers and Spark mean the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_archives(records: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Writes classified records to .warc.gz files in a shared folder; returns the written index."""
    folder = qualified(records.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, at, file = None, 0, ""
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            index = []
            for row in b.to_pylist():
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    file = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{file}", compression=None)
                    info = _member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Filename", file), ("Content-Type", "application/warc-fields")], b"format: WARC file version 1.1\r\n", level)
                    out.write(info)
                    at = len(info)
                record = _encode(row, level)
                out.write(record)
                index.append({k: row[k] for k in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")} | {"file": file, "offset": at, "length": len(record)})
                at += len(record)
            yield pa.RecordBatch.from_pylist(index, schema)
        if out is not None:
            out.close()

    return materialize(records.mapInArrow(run, INDEX), "warc-index")


def _parse(member: bytes) -> dict:
    """One record: its headers and payload, checked against its own digest and length."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("no WARC record at this offset")
    number = lambda x: int(v) if (v := x.removeprefix("<urn:x-page:").rstrip(">")) else None
    out = {"page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_digest": h["warc-payload-digest"].removeprefix("sha256:"), "record_type": h["warc-type"], "refers_to": None, "payload": None}
    if h["warc-type"] == "revisit":
        return out | {"payload_bytes": int(h["x-payload-length"]), "refers_to": number(h["warc-refers-to"])}
    payload = block.partition(b"\r\n\r\n")[2]
    if hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        raise ValueError(f"the payload of {out['page_id']} doesn't match its digest")
    return out | {"payload_bytes": len(payload), "payload": payload}


def read_archives(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of the selected index rows; with payload, their bytes too (null for revisits).

    Tasks are as many as RANGE_BYTES go into the selected records. Rows of a file are grouped by stretches of RANGE_BYTES, so a group is bounded by that many bytes of records;
    in a stretch, records nearer than GAP_BYTES share one read.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload
    folder = qualified(index.sparkSession, folder)
    ranges = index.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).alias("range")).agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"), F.sum("length").alias("bytes"))
    ranges = materialize(ranges, "warc-ranges")
    total = ranges.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    # as many tasks as the selected bytes need, however small the index is
    ranges = ranges.repartition(max(1, -(-total // RANGE_BYTES)), "file", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                with store.open_input_file(f"{root}/{r['file']}") as f:
                    runs: list[list[dict]] = []
                    for x in r["records"]:
                        if runs and x["offset"] - (runs[-1][-1]["offset"] + runs[-1][-1]["length"]) <= GAP_BYTES:
                            runs[-1].append(x)
                        else:
                            runs.append([x])
                    for xs in runs:
                        start = xs[0]["offset"]
                        f.seek(start)
                        data = f.read(xs[-1]["offset"] + xs[-1]["length"] - start)
                        rows = [_parse(data[x["offset"] - start : x["offset"] - start + x["length"]]) for x in xs]
                        yield pa.RecordBatch.from_pylist([{k: row[k] for k, _ in fields} for row in rows], pa.schema(fields))

    return ranges.mapInArrow(run, RECORD + ", payload binary" * payload)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(prepare(spark), "archives")
    index = write_archives(classify(table(spark, sf_dir, "pages")), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""
}
