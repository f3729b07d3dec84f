"""Prompts and source cards for batch inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAST, VERBATIM, CONTEXT = 6, 4, 5


def history(turns: DataFrame, n: int = LAST) -> DataFrame:
    """Each user turn with the n messages before it as "User: ..." and "Assistant: ..." lines, oldest first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    out = turns.withColumn("line", line).withColumn("history", F.collect_list("line").over(w))
    return out.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), "history")


def history_block(lines: Column, verbatim: int = VERBATIM) -> Column:
    """The history as a paragraph: whole if short, else its last lines."""
    end = F.when(F.size(lines) > verbatim, F.slice(lines, F.size(lines) - verbatim + 1, verbatim)).otherwise(lines)
    title = F.when(F.size(lines) <= verbatim, "Previous conversation:\n").otherwise("Recent conversation:\n")
    return F.when(F.coalesce(F.size(lines), F.lit(0)) == 0, F.lit("")).otherwise(F.concat(title, F.array_join(end, "\n"), F.lit("\n\n")))


def format_doc() -> Column:
    """A retrieved document as one line, by its type; texts are cut."""
    c = F.col
    sat = F.coalesce("satellite", F.lit("?"))
    name = F.coalesce(*[F.when(c(x) != "", c(x)) for x in ("product", "satellite", "name")])
    body = F.substring(F.coalesce("text", F.lit("")), 1, 300)
    regions = F.when(F.size("regions") > 0, F.concat(F.lit(" covering "), F.array_join("regions", ", "))).otherwise("")
    return (
        F.when((c("type") == "satellite") & (F.size("products") > 0), F.concat(F.lit("Satellite "), sat, F.lit(" provides: "), F.array_join(F.slice("products", 1, 5), ", ")))
        .when(c("type") == "satellite", F.concat(F.lit("Satellite: "), sat))
        .when(c("type") == "data_product", F.concat(F.lit("Data product '"), F.coalesce("product", F.lit("?")), F.lit("' from "), sat, F.coalesce(regions, F.lit(""))))
        .when(c("type") == "curated", F.substring(F.coalesce("text", F.lit("")), 1, 500))
        .when(c("type") == "crawled_page", F.concat(F.lit("["), F.coalesce("source_url", F.lit("portal")), F.lit("] "), body))
        .when(name.isNotNull(), F.concat(name, F.lit(": "), body))
        .otherwise(body)
    )


def prompts(questions: DataFrame, lines: DataFrame, n: int = CONTEXT) -> DataFrame:
    """questions(qid, question, history) and lines(qid, place, line) -> (qid, prompt)."""
    best = lines.where(F.col("place") <= n).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    bullets = F.array_join(F.transform("lines", lambda s: F.concat(F.lit("- "), s["line"])), "\n")
    out = questions.join(best, "qid", "left")
    return out.select("qid", F.concat(history_block(F.col("history")), F.lit("Question: "), "question", F.lit("\n\nContext:\n"), F.coalesce(bullets, F.lit(""))).alias("prompt"))


def source_cards(docs: DataFrame, site: str, portal: str = "Portal", n: int = 3) -> DataFrame:
    """docs(qid, place, ...) -> (qid, place, satellite, dataset, url) of the n best, by type of document."""
    c = F.col
    path = F.initcap(F.replace(F.replace(F.coalesce("source_url", F.lit("")), F.lit(site), F.lit("")), F.lit("-"), F.lit(" ")))
    satellite = F.when(c("type") == "curated", F.initcap(F.coalesce("category", F.lit(portal)))).when(c("type") == "crawled_page", F.lit(portal)).otherwise(F.coalesce("satellite", F.lit("Unknown")))
    dataset = (
        F.when(c("type") == "curated", F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 80), F.lit("...")))
        .when(c("type") == "crawled_page", F.when(path == "", "Web Page").otherwise(path))
        .otherwise(F.coalesce("product", "name", F.lit("Dataset")))
    )
    return docs.where(c("place") <= n).select("qid", "place", satellite.alias("satellite"), dataset.alias("dataset"), F.coalesce("source_url", F.lit(site)).alias("url"))
