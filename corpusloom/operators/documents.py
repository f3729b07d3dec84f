"""Record normalization, enrichment and the fixed schema of processed documents; deduplication and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

#: Columns of a processed document with their defaults (None: null).
SCHEMA = {
    "source_url": ("string", None), "content_type": ("string", None), "text": ("string", ""), "cleaned_text": ("string", None), "language": ("string", None),
    "metadata": ("map<string,string>", "map()"), "tables": ("array<array<array<string>>>", "array()"),
    "figures": ("array<struct<page:int,width:double,height:double>>", "array()"),
    "visual_data": ("array<struct<page:int,type:string,contours:int,edge_density:double>>", "array()"),
    "document_type": ("string", None), "keywords": ("array<string>", "array()"),
}


def normalize_records(raw: DataFrame) -> DataFrame:
    """Takes the text from `text` where raw_text is missing, an empty map for missing metadata, strings for its values."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    as_text = F.transform_values("metadata", lambda _, v: v.cast("string"))
    return raw.withColumn("raw_text", F.coalesce("raw_text", "text")).withColumn("metadata", F.coalesce(as_text, empty))


def enrich(docs: DataFrame, language: Column, extra: dict[str, Column], text: str = "raw_text") -> DataFrame:
    """Adds language, text and metadata in which the enriched keys override; documents without text stay as they are."""
    some = F.coalesce(F.col(text) != "", F.lit(False))
    keys = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v.cast("string"))])
    rest = F.map_filter("metadata", lambda k, _: ~k.isin(*extra))
    return docs.withColumns({"language": F.when(some, language), "text": F.when(some, F.col(text)), "metadata": F.when(some, F.map_concat(rest, keys)).otherwise(F.col("metadata"))})


def to_schema(docs: DataFrame) -> DataFrame:
    """Keeps the columns of the fixed schema, adds missing ones and applies defaults."""
    out = []
    for name, (kind, default) in SCHEMA.items():
        c = F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)
        if default is not None:
            c = F.coalesce(c, F.expr(default).cast(kind) if default else F.lit(default))
        out.append(c.alias(name))
    return docs.select(*out)


def long_enough(docs: DataFrame, least: int = 50) -> DataFrame:
    return docs.where(F.length("text") >= least)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the first in the given order. Keys are near unique here, so groups are small."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows by key, the last written one wins."""
    return latest(existing.unionByName(new), key, [F.desc(order)])


def prefer_processed(raw: DataFrame, processed: DataFrame, key: str = "source_url", path: str = "path") -> DataFrame:
    """One document a URL (its path where there is none), processed ones before raw ones, then the first path."""
    both = processed.withColumn("priority", F.lit(1)).unionByName(raw.withColumn("priority", F.lit(0)))
    return latest(both.withColumn("key", F.coalesce(key, path)), "key", [F.desc("priority"), F.col(path)]).drop("key")


def metadata_rows(docs: DataFrame, key: str, metadata: str = "metadata") -> DataFrame:
    """(key, name, value) of each metadata entry with a value."""
    return docs.select(key, F.explode(metadata).alias("name", "value")).withColumn("value", F.col("value").cast("string")).where("value IS NOT NULL AND value <> ''")


def changed(docs: DataFrame, index: DataFrame, key: str = "id") -> DataFrame:
    """Documents that are new or whose text isn't the indexed one."""
    return docs.withColumn("digest", F.md5("text")).join(index.select(key, "digest"), [key, "digest"], "left_anti")


def refresh(docs: DataFrame, index: DataFrame, embed, key: str = "id") -> DataFrame:
    """The index after a refresh: entries whose document is unchanged, and embed() of the others."""
    kept = index.join(docs.select(key, F.md5("text").alias("digest")), [key, "digest"], "left_semi")
    return kept.unionByName(embed(changed(docs, index, key)), allowMissingColumns=True)


def documents_of(rows: DataFrame, acronyms: dict[str, str] | None = None) -> DataFrame:
    """cleaned_text, text and document_type of records with a raw_text."""
    raw = F.col("raw_text")
    return rows.withColumns({"cleaned_text": tx.cleaned_text(raw), "text": tx.normalize_text(raw, acronyms), "document_type": tx.document_type(raw)})
