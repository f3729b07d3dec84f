"""Feedback analytics, progress and quality scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 1)).otherwise(0.0)


def totals(feedback: DataFrame) -> DataFrame:
    c = feedback.agg(F.count("*").alias("total"), F.count_if(F.col("type") == "up").alias("up"), F.count_if(F.col("type") == "down").alias("down"))
    return c.select("*", percent(F.col("up"), F.col("total")).alias("up_pct"), percent(F.col("down"), F.col("total")).alias("down_pct"))


def daily(feedback: DataFrame, days: int = 7) -> DataFrame:
    """(day, up, down) of the last days up to the newest entry, days without entries included."""
    end = feedback.agg(F.to_date(F.max("timestamp")).alias("end"))
    all_days = end.where("end IS NOT NULL").select(F.explode(F.sequence(F.date_sub("end", days - 1), F.col("end"))).alias("day"))
    n = feedback.groupBy(F.to_date("timestamp").alias("day")).agg(F.count_if(F.col("type") == "up").alias("up"), F.count_if(F.col("type") == "down").alias("down"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return all_days.join(n, "day", "left").select("day", zero("up"), zero("down"))


def disliked(feedback: DataFrame, n: int = 5) -> DataFrame:
    """The queries with the most down votes; ties by first occurrence, then by text."""
    q = feedback.where(F.col("type") == "down").withColumn("query", F.trim("query")).where("query <> ''")
    return q.groupBy("query").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen")).orderBy(F.desc("n"), "first_seen", "query").limit(n)


def recent(feedback: DataFrame, n: int = 20) -> DataFrame:
    return feedback.orderBy(F.desc("timestamp"), F.desc("message_id")).limit(n)


def progress(steps: DataFrame, group: list[str]) -> DataFrame:
    """Counts of steps by status, and the share of those not skipped that are done."""
    n = lambda s: F.count_if(F.col("status") == s)
    c = steps.groupBy(*group).agg(F.count("*").alias("total"), n("done").alias("done"), n("error").alias("error"), n("skipped").alias("skipped"))
    return c.withColumn("pct", F.when(F.col("total") > F.col("skipped"), F.round(100.0 * F.col("done") / (F.col("total") - F.col("skipped")), 0)).otherwise(0.0))


def evaluation(cases: DataFrame, metric: str, passed: Column) -> DataFrame:
    """(metric, passed, total, score) of a table of cases."""
    c = cases.agg(F.count_if(passed).alias("passed"), F.count("*").alias("total"))
    return c.select(F.lit(metric).alias("metric"), "passed", "total", percent(F.col("passed"), F.col("total")).alias("score"))


def contained(expected: Column, found: Column) -> Column:
    """Whether an expectation, if there is one, is contained in what was found, whatever the case."""
    return (expected == "") | F.lower(found).contains(F.lower(expected))


def phrases(required: Column, text: Column) -> tuple[Column, Column]:
    """The required phrases that a text holds and those that it lacks."""
    return F.filter(required, lambda p: text.contains(p)), F.filter(required, lambda p: ~text.contains(p))


def keyword_hits(keywords: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))


def enough_hits(keywords: Column, text: Column) -> Column:
    return keyword_hits(keywords, text) >= F.greatest(F.lit(1), F.floor(F.size(keywords) / 2))


def good_response(text: Column, least: Column, forbidden: Column) -> Column:
    low = F.lower(text)
    return (F.length(text) >= least) & (F.trim(text) != "") & ~F.exists(forbidden, lambda p: low.contains(F.lower(p)))


def scorecard(results: DataFrame) -> DataFrame:
    """Results by metric and, as metric 'overall', the mean of the scores that aren't null."""
    total = results.agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"), F.round(F.avg("score"), 1).alias("score"))
    return results.select("metric", "passed", "total", "score").unionByName(total.select(F.lit("overall").alias("metric"), "passed", "total", "score"))
