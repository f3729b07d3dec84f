"""Files as tables and back: JSON document trees, curated knowledge, labelled examples, feedback logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "source_url string, content_type string, text string, raw_text string, metadata map<string,string>, tables array<array<array<string>>>, "
    "figures array<struct<page:int,width:double,height:double>>, visual_data array<struct<page:int,type:string,contours:int,edge_density:double>>"
)
CURATED = "id string, text string, type string, category string, source_url string"
EXAMPLES = "examples array<struct<text:string,label:int>>"
FEEDBACK = "timestamp string, message_id string, query string, response string, type string"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object a file in a tree of folders, with its path and stem; broken files give null columns."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").json(folder)
    return docs.withColumn("path", F.col("_metadata.file_path")).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.json$", 1))


def kind_of(content_type: F.Column) -> F.Column:
    t = F.lower(content_type)
    return F.when(t.contains("rss"), "rss").when(t.contains("pdf"), "pdfs").when(t.rlike("word|docx"), "docs").when(t.contains("html"), "html").otherwise("other")


def write_documents(docs: DataFrame, folder: str) -> None:
    """Writes documents as JSON, parted by kind; feeds are left out."""
    docs.withColumn("kind", kind_of(F.col("content_type"))).where("kind <> 'rss'").write.mode("append").partitionBy("kind").json(folder)


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CURATED).option("multiLine", True).json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAMPLES).option("multiLine", True).json(path).select(F.inline("examples"))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a feedback log; blank and malformed ones are dropped."""
    return spark.read.schema(FEEDBACK).option("mode", "DROPMALFORMED").json(path).where("timestamp IS NOT NULL")


def feedback_rows(rows: DataFrame, longest: int = 500) -> DataFrame:
    """Rows as the log stores them: missing fields empty, responses cut."""
    cols = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("") for c in ("timestamp", "message_id", "query", "response", "type")}
    cols["response"] = F.substring(cols["response"], 1, longest)
    return rows.select(*[v.alias(k) for k, v in cols.items()])


def append_feedback(rows: DataFrame, path: str) -> None:
    feedback_rows(rows).write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode("overwrite").text(path)


def write_examples(positive: DataFrame, negative: DataFrame, path: str) -> None:
    positive.select("text", "label").unionByName(negative.select("text", "label")).write.mode("overwrite").json(path)
