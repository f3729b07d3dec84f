"""Personal data: base kinds by pattern, and further identifiers by bootstrapped contextual extraction.

Everything runs in Spark SQL expressions. Base spans of four kinds (email, ip, card, phone) are found in whole texts
and are the seeds. The two words before an identifier are its lexical pattern; patterns and identifiers form a graph
over all documents. Rounds of scoring go from identifiers (seeds 1, others 0 at first) to patterns (the smoothed mean
score of the identifiers that they introduce) and back (the chance that not all of its patterns err). Identifiers that
a pattern of high confidence introduces and that no base span touches are added as spans of kind "found".

Every grouping pre-aggregates, and the graph is keyed by hashes of patterns and identifiers, so a pattern or identifier
that a third of all rows share costs one row a task; joins on them are skew joins. Texts are never shuffled.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows give
repeated results, and null and equal ids are judged like others; without seeds nothing is added; very long texts are
searched whole, with offsets summed over their matches in blocks; columns other than the id and the text are left out; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.arrays import bound, running_sums

from .common import materialize, table

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, written so that Java's matcher neither backtracks nor recurses in long texts.
#: Look-behinds only pass over starts from which the same match, or none, would be found; a card is a whole run of
#: single-spaced digits, and runs of other lengths than 12 to 19 fail anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of these has no match of the kind either; cheaper to look for.
HINTS = {"email": "@", "phone": "+"}
#: Tokens that could be identifiers: five characters or more with a digit, however long, without hyphens and underscores
#: at their ends. Only the start of a run of such characters is tried, and giving back stops at the run's last letter or digit.
CANDIDATE = r"(?<![A-Za-z0-9_@.+-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{3,}[A-Za-z0-9](?![_-]*+[A-Za-z0-9@])"
PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
OCTETS = rf"^{PART}(?:\.{PART}){{3}}$"
#: Rounds of scoring; smoothing of a pattern's mean; least confidence, and least different seeds behind a pattern.
ROUNDS, SMOOTH, CONFIDENT, SEEDS = 3, 1.0, 0.8, 3


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before>> of a pattern's leftmost non-overlapping matches, in code points.

    The text is cut at the matches; ends are running sums of the lengths of pieces and matches; before is the end of the
    piece before a match.
    """
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"), F.split(text, pattern, -1).alias("pieces"))

    def placed(c: Column) -> Column:
        pieces = F.slice(c["pieces"], 1, F.size(c["values"]))
        ends = running_sums(F.zip_with(pieces, c["values"], lambda p, v: F.length(p) + F.length(v)))
        rows = F.arrays_zip(c["values"].alias("value"), pieces.alias("piece"), ends.alias("end"))
        return F.transform(rows, lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.right(x["piece"], F.lit(80)).alias("before")))

    return bound(cut, placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    ds = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(ds, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind number, end, kind, value, before>> of the base kinds, sorted."""
    return F.array_sort(F.concat(*(_spans_of(i, kind, text) for i, kind in enumerate(KINDS))))


def _spans_of(i: int, kind: str, text: Column) -> Column:
    hint = text.contains(HINTS[kind]) if kind in HINTS else text.rlike(PATTERNS[kind])
    good = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))
    spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("n"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"), m["before"].alias("before")))
    return F.when(hint, spans).otherwise(F.expr("CAST(array() AS array<struct<start: int, n: int, end: int, kind: string, value: string, before: string>>)"))


def _of_kind(kind: str) -> Column:
    return F.filter("base", lambda s: s["kind"] == kind)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pattern_of(before: Column) -> Column:
    """The last two words before an identifier in lower case; null where there are fewer."""
    words = F.regexp_extract(F.lower(before), r"([\p{L}:#=]+)[\s\p{Punct}]+([\p{L}:#=]+)[\s\p{Punct}]*$", 0)
    return F.when(words != "", F.regexp_replace(words, r"\s+", " "))


def scored_patterns(occurrences: DataFrame) -> DataFrame:
    """(pattern, confidence, seeds) after ROUNDS of scoring on occurrences(pattern, token, seed).

    pattern and token are 64-bit hashes; the graph has one link for each pair, however often it occurs.
    """
    links = occurrences.groupBy("pattern", "token").agg(F.max("seed").alias("seed"))
    links = materialize(links, "pattern-links")
    score = links.groupBy("token").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        p = links.join(score, "token").groupBy("pattern").agg((F.sum("score") / (F.count("*") + SMOOTH)).alias("confidence"), F.sum("seed").alias("seeds"))
        p = materialize(p, "patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.when(F.col("seeds") >= SEEDS, F.col("confidence")).otherwise(0.0), F.lit(1e-9)))))
        score = links.join(p, "pattern").groupBy("token").agg(F.max("seed").alias("seed"), (1 - doubt).alias("score"))
        score = materialize(score.select("token", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("score")).alias("score")), "token-scores")
    return p


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    candidates = F.when(t.rlike("[0-9]"), matches(t, CANDIDATE))
    row = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), base_spans(t).alias("base"), candidates.alias("candidates"))
    row = row.withColumn("candidates", F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    rows = materialize(row, "base-spans")  # spans only; row numbers are fixed by writing them
    seeds = rows.select("row", F.inline("base")).select("row", "start", "end", F.lit(1).alias("seed"), "value", "before")
    others = rows.select("row", F.inline("candidates")).select("row", "start", "end", F.lit(0).alias("seed"), "value", "before")
    seen = seeds.unionByName(others).withColumn("words", pattern_of(F.col("before"))).where("words IS NOT NULL")
    seen = materialize(seen.select("row", "start", "end", "seed", F.xxhash64("words").alias("pattern"), F.xxhash64("value").alias("token")), "occurrences")
    good = scored_patterns(seen).where((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= SEEDS)).select("pattern")
    found = seen.where("seed = 0").join(good, "pattern", "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("n"), "end", F.lit("found").alias("kind"))).alias("more"))
    short = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["end"].alias("end"), s["kind"].alias("kind")))
    out = rows.select("id", "row", short.alias("base")).join(found, "row", "left")
    return out.select(
        F.col("id").alias(key),
        *[F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        F.when(F.col("more").isNull(), spelled(F.col("base"))).otherwise(spelled(F.array_sort(F.concat("base", "more")))).alias("spans"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
