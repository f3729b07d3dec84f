"""Chunks of documents, and the documents of the retrieval index that are spelled out from the graph."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corpusloom.sources.scratch import written

SIZE, OVERLAP = 800, 100


def sentences(text: Column) -> Column:
    """Pieces of a text, cut after ". " and after each line; nothing is lost."""
    return F.filter(F.split(text, r"(?<=\. )|(?<=\n)"), lambda s: s != "")


def pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Joins pieces to chunks of at most `size` where pieces allow it; a chunk begins with whole words of the last one's end."""
    held = ""
    for piece in pieces:
        if held and len(held) + len(piece) > size:
            yield held.strip()
            end = held[-overlap:] if overlap else ""
            held = end.split(" ", 1)[-1] + piece
        else:
            held += piece
    if held.strip():
        yield held.strip()


def chunked(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<string> of a text's chunks; the fold over sentences is a vectorized helper, the rest built in."""

    @pandas_udf(T.ArrayType(T.StringType()))
    def fold(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda p: list(pack(list(p), size, overlap)))

    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).when(F.length(bare) <= size, F.array(bare)).otherwise(fold(sentences(bare)))


def chunk_rows(docs: DataFrame, stem: str = "stem", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row a chunk: id, chunk_index and text beside the other columns of docs."""
    rest = [c for c in docs.columns if c not in (text, "id", "chunk_index")]
    out = docs.select(*rest, F.posexplode(chunked(F.col(text), size, overlap)).alias("chunk_index", "text"))
    return out.withColumn("id", F.concat(F.lit("crawled_"), F.col(stem).cast("string"), F.lit("_c"), F.col("chunk_index").cast("string")))


def first_names(groups: DataFrame, keys: list[str], name: str, most: int, alias: str) -> DataFrame:
    """Per key the first `most` distinct names in order; each task sends on no others."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(name))
    first = groups.where(F.col(name).isNotNull()).select(*keys, name).withColumn("rank", rank).where(F.col("rank") <= most)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_set(name)).alias(alias))


def satellite_docs(provides: DataFrame, most: int = 10) -> DataFrame:
    """provides(satellite, product) as one sentence a satellite."""
    out = first_names(provides, ["satellite"], "product", most, "products")
    return out.select(F.concat(F.lit("Satellite "), "satellite", F.lit(" provides data products: "), F.array_join("products", ", ")).alias("text"), F.lit("satellite").alias("type"), "satellite", "products")


def product_docs(provides: DataFrame, covers: DataFrame, most: int = 5, limit: int | None = 200) -> DataFrame:
    """(satellite, product) pairs with up to `most` regions that the product covers; the first `limit` pairs by name, which lie in
    the first `limit` satellites."""
    pairs = provides.select("satellite", "product")
    if limit is not None:
        names = pairs.where("satellite IS NOT NULL").select("satellite").distinct().orderBy("satellite").limit(limit).agg(F.max("satellite")).first()[0]
        pairs = pairs.where(F.col("satellite").isNull() | (F.col("satellite") <= names)) if names is not None else pairs
        pairs = written(pairs.distinct().orderBy("satellite", "product").limit(limit), "first-pairs")
    else:
        pairs = pairs.distinct()
    regions = first_names(covers.join(pairs.select("product").distinct(), "product", "left_semi"), ["product"], "region", most, "regions")
    out = pairs.join(regions, "product", "left").withColumn("regions", F.coalesce("regions", F.array().cast("array<string>")))
    tail = F.when(F.size("regions") > 0, F.concat(F.lit(" covering "), F.array_join("regions", ", "))).otherwise("")
    return out.select(F.concat(F.lit("Data product "), "product", F.lit(" from satellite "), "satellite", tail).alias("text"), F.lit("data_product").alias("type"), "product", "satellite", "regions")


def parameter_docs(parameters: DataFrame, measures: DataFrame, most: int = 5) -> DataFrame:
    """parameters(name) with up to `most` products that measure them."""
    by = first_names(measures, ["name"], "product", most, "products")
    out = parameters.select("name").distinct().join(by, "name", "left")
    tail = F.when(F.size("products") > 0, F.concat(F.lit(" measured by "), F.array_join("products", ", "))).otherwise("")
    return out.select(F.concat(F.lit("Parameter "), "name", F.coalesce(tail, F.lit(""))).alias("text"), F.lit("parameter").alias("type"), "name")


def assemble(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def breakdown(index: DataFrame) -> DataFrame:
    return index.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
