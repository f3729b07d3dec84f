"""The driver's tables in the shapes of the library: pages, documents, and a property graph out of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.scratch import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_folder(spark: SparkSession, d: str, name: str, tables: list[str]) -> str:
    """Where a model fitted on these tables is kept: a folder that all executors share, named by the tables' files, so
    that other or changed files have a model of their own."""
    files = None
    for t in tables:
        at = table(spark, d, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        files = at if files is None else files.unionByName(at)
    mark = files.agg(F.sum(F.xxhash64("file_path", "file_size", "file_modification_time") % (1 << 40)).alias("mark")).first()["mark"]
    return f"{shared_folder(spark)}/corpusloom/models/{name}-{mark or 0}"


def product_name() -> F.Column:
    return F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))


def provides(spark: SparkSession, d: str) -> DataFrame:
    """(satellite, product): distinct supplier and part of line items."""
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    return pairs.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("s_name").alias("satellite"), product_name().alias("product"))


def covers(spark: SparkSession, d: str) -> DataFrame:
    """(product, region): parts and the nations of the customers who ordered them; line items, the largest, are joined once, and
    keys are made distinct before names."""
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    keys = lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "c_nationkey").distinct()
    p, n = table(spark, d, "part"), table(spark, d, "nation")
    return keys.join(p, F.col("l_partkey") == F.col("p_partkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(product_name().alias("product"), F.col("n_name").alias("region"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    """(product, name): a part and its type."""
    return table(spark, d, "part").select(product_name().alias("product"), F.col("p_type").alias("name"))


def instruments(spark: SparkSession, d: str) -> DataFrame:
    """(satellite, instrument): a supplier and the brands of its parts."""
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    return pairs.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("satellite"), F.col("p_brand").alias("instrument")).distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(label, name, source) of the graph."""
    t = lambda n: table(spark, d, n)
    parts = [
        t("supplier").select(F.lit("SATELLITE").alias("label"), F.col("s_name").alias("name"), F.lit("supplier").alias("source")),
        t("part").select(F.lit("DATA_PRODUCT").alias("label"), product_name().alias("name"), F.lit("part").alias("source")),
        t("nation").select(F.lit("REGION").alias("label"), F.col("n_name").alias("name"), F.lit("nation").alias("source")),
        t("part").select(F.lit("PARAMETER").alias("label"), F.col("p_type").alias("name"), F.lit("part").alias("source")).distinct(),
        t("part").select(F.lit("INSTRUMENT").alias("label"), F.col("p_brand").alias("name"), F.lit("part").alias("source")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


EDGE = ["h_label", "h_name", "type", "t_label", "t_name"]


def _edges(pairs: DataFrame, head: tuple[str, str], kind: str, tail: tuple[str, str]) -> DataFrame:
    return pairs.select(F.lit(head[0]).alias("h_label"), F.col(head[1]).alias("h_name"), F.lit(kind).alias("type"), F.lit(tail[0]).alias("t_label"), F.col(tail[1]).alias("t_name"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return (
        _edges(provides(spark, d), ("SATELLITE", "satellite"), "PROVIDES", ("DATA_PRODUCT", "product"))
        .unionByName(_edges(covers(spark, d), ("DATA_PRODUCT", "product"), "COVERS", ("REGION", "region")))
        .unionByName(_edges(measures(spark, d), ("DATA_PRODUCT", "product"), "MEASURES", ("PARAMETER", "name")))
        .unionByName(_edges(instruments(spark, d), ("SATELLITE", "satellite"), "HAS_INSTRUMENT", ("INSTRUMENT", "instrument")))
    )


#: The same tables as DuckDB common table expressions, to begin a WITH clause.
GRAPH_SQL = """
provides AS (SELECT DISTINCT s_name AS satellite, p_name || '#' || p_partkey AS product FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
covers AS (SELECT DISTINCT p_name || '#' || p_partkey AS product, n_name AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
measures AS (SELECT p_name || '#' || p_partkey AS product, p_type AS name FROM part),
instruments AS (SELECT DISTINCT s_name AS satellite, p_brand AS instrument FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
nodes AS (SELECT 'SATELLITE' AS label, s_name AS name, 'supplier' AS source FROM supplier UNION ALL SELECT 'DATA_PRODUCT', p_name || '#' || p_partkey, 'part' FROM part UNION ALL SELECT 'REGION', n_name, 'nation' FROM nation UNION ALL SELECT DISTINCT 'PARAMETER', p_type, 'part' FROM part UNION ALL SELECT DISTINCT 'INSTRUMENT', p_brand, 'part' FROM part),
edges AS (SELECT 'SATELLITE' AS h_label, satellite AS h_name, 'PROVIDES' AS type, 'DATA_PRODUCT' AS t_label, product AS t_name FROM provides UNION ALL SELECT 'DATA_PRODUCT', product, 'COVERS', 'REGION', region FROM covers UNION ALL SELECT 'DATA_PRODUCT', product, 'MEASURES', 'PARAMETER', name FROM measures UNION ALL SELECT 'SATELLITE', satellite, 'HAS_INSTRUMENT', 'INSTRUMENT', instrument FROM instruments)
""".strip()
