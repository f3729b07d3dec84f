"""Queries whose SQL states a smaller job, against brute force over the whole one."""

import re
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.plans import registry
from corpusloom.streaming import jobs

QUERIES = registry.queries()
BLANK = " \t\n\x0b\f\r"


def brute_chunks(text, size=800, overlap=100):
    bare = (text or "").strip(BLANK)
    if len(bare) <= size:
        return [bare] if bare else []
    out, held = [], ""
    for s in filter(None, re.split(r"(?<=\. )|(?<=\n)", bare)):
        if held and len(held) + len(s) > size:
            out.append(held.strip())
            held = held[-overlap:].split(" ", 1)[-1]
        held += s
    return out + ([held.strip()] if held.strip() else [])


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def test_index_holds_chunks_of_documents(spark, sf_dir):
    pages = [(r["source"], f"crawled_{r['doc_id']}_c{i}", c) for r in documents(spark, sf_dir) for i, c in enumerate(brute_chunks(r["text"]))]
    got = Counter(tuple(r) for r in QUERIES["K8"](spark, sf_dir).where("type = 'crawled_page'").select("text", "id").collect())
    assert got == Counter((c, i) for _, i, c in pages)
    assert {r["type"]: r["n"] for r in QUERIES["K9"](spark, sf_dir).collect()}["crawled_page"] == len(pages)
    got = Counter(r["line"] for r in QUERIES["P3"](spark, sf_dir).where("type = 'crawled_page'").collect())
    assert got == Counter(f"[{source}] {c[:300]}" for source, _, c in pages)


def test_ingest_holds_chunks_of_last_versions(spark, sf_dir):
    last = {}
    for r in documents(spark, sf_dir):
        last[r["source"]] = max(last.get(r["source"], (-1, "")), (r["doc_id"], r["text"]))
    df = spark.createDataFrame([(s, t) for s, (_, t) in last.items()], "id string, text string")
    texts = df.select("id", tx.normalize_text(F.col("text")).alias("text")).collect()
    want = sorted((f"crawled_{r['id']}_c{i}", c) for r in texts for i, c in enumerate(brute_chunks(r["text"])))
    assert sorted(tuple(r) for r in QUERIES["X2"](spark, sf_dir).select("id", "text").collect()) == want


def test_ingest_of_shortened_emptied_and_late_documents(spark, tmp_path):
    long = " ".join(f"Sentence {i} is here." for i in range(150))
    batches = [[("a", 1, long), ("b", 1, long), ("c", 5, "new c"), ("d", 1, "d  one")], [("a", 2, "short"), ("b", 2, " \n"), ("c", 4, long), ("d", 1, "d two"), ("e", 1, "old"), ("e", 2, long)]]
    index, schema = jobs.Index(spark, f"file://{tmp_path}/index"), "id string, version long, text string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.ingest(stream, index, str(tmp_path / "checkpoint")).awaitTermination()
    want = {"a": ["short"], "c": ["new c"], "d": ["d two"], "e": brute_chunks(long)}
    got = sorted((r["id"], r["text"]) for r in index.chunks().collect())
    assert got == sorted((f"crawled_{k}_c{i}", c) for k, cs in want.items() for i, c in enumerate(cs))


def test_acronyms_of_all_languages(spark, sf_dir):
    def expand(t):
        for a, e in {"the": "definite article", "of": "preposition"}.items():
            t = re.sub(rf"\b{a}\b(?!\s*\()", f"{a} ({e})", t)
        return t

    rows = documents(spark, sf_dir)
    assert {r["lang"] for r in rows} > {"en"}
    assert {r["doc_id"]: r["text"] for r in QUERIES["T4"](spark, sf_dir).collect()} == {r["doc_id"]: expand(r["text"]) for r in rows}
    odd = ["éthe theé the", "प्रthe of", "the  (x) of (y)", "THE the_of the-of"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(tx.expand_acronyms(F.col("t"), {"the": "definite article", "of": "preposition"}).alias("t")).collect()
    assert [r["t"] for r in got] == [expand(t) for t in odd]
