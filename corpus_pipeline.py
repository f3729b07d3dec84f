"""A training-data pipeline over documents: each stage's rows are written as Parquet and reread by the next one.

toxicity drops documents that are more likely toxic than not; near_duplicates keeps one document (the smallest id) of
each group of n-gram similar ones; decontamination drops documents that hold a window of a benchmark item; secrets
masks what the secret rules find; encode turns the rest into token ids. All but the last return the columns of
documents and leave other columns out. Each stage judges its own input whole, row by row; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontamination, ngram_join, secrets, sentencepieces, toxicity
from corpusloom.llm.common import BitFilter, materialize, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MASK = "[SECRET]"
#: Near duplicates share five-word n-grams with a Jaccard similarity of 0.8 or more; op7's own values are stricter.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labels of the documents that come in, and drops those found toxic.

    Null and empty texts are kept; without labels of both kinds nothing is dropped; repeated rows are judged alike.
    """
    model = toxicity.fit(docs, table(prepare(spark), sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(~F.col("toxic")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: the smallest id (a null id last), of equal ids the smallest digest of the text.

    Rows are told apart by id and text, so of equal ids with unlike texts each is judged on its own. Of repeated rows one
    stays, texts without words among them. Only rows that may go, by a filter of bounded size, are moved at all.
    """
    prepare(spark)
    key = ["doc_id", "digest"]
    rows = docs.select(*COLUMNS).withColumn("digest", F.when(F.col("text").isNotNull(), F.md5("text")))
    name = F.struct(F.col("doc_id").isNull().alias("last"), *key)
    found = ngram_join.ngram_classes(rows.select(*key, "text"), key, name, n=NEAR_WORDS, percent=NEAR_PERCENT)
    found = materialize(found.groupBy(*key).agg(F.count("*").alias("rows"), F.first("name").alias("name")), "near-rows")
    stays = F.col("name").isNull() | name.eqNullSafe(F.col("name"))
    doubt = materialize(found.where((F.col("rows") > 1) | ~stays).select(*key, stays.alias("stays")), "near-doubts")
    number = F.xxhash64(*key)
    some = BitFilter.build(doubt.select(number.alias("number")), doubt.count())
    moved = some.column(spark, number)
    marked = doubt.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "stays")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("digest").eqNullSafe(F.col("__digest"))
    judged = rows.where(moved).join(marked, same, "left")
    passed = judged.where("stays IS NULL").select(*COLUMNS)
    kept = judged.where("stays").dropDuplicates(key).select(*COLUMNS)
    return rows.where(~moved).select(*COLUMNS).unionByName(passed).unionByName(kept)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a benchmark window; null, empty and wordless texts have none and stay, repeated rows too."""
    found = decontamination.decontaminate(docs.select(*COLUMNS), table(prepare(spark), sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; n_chars follows the text where it changed. All rows stay, null texts as they are."""
    prepare(spark)
    found = secrets.find_secrets(docs.select(*COLUMNS), mask=MASK)
    return found.withColumn("n_chars", F.when(F.col("spans") != "", F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the decoded text; null and empty texts give the end id."""
    prepare(spark)
    out = sentencepieces.encode_texts(docs.select("doc_id", "text"), sentencepieces.default_model())
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encode", encode),
]
#: The ordinal model, the prefix-tree components and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
