"""Relations between mentions: sentences, pairs, explicit patterns, co-occurrence, and a model learned by distant supervision."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.arrays import bound, running_sums
from corpusloom.operators.chunks import sentences
from corpusloom.operators.entities import context_of
from corpusloom.sources.scratch import written

# Relation types and the head and tail types that they allow.
SCHEMA = [
    ("PROVIDES", "SATELLITE", "DATA_PRODUCT"), ("PROVIDES", "SATELLITE", "SERVICE"), ("MEASURES", "INSTRUMENT", "PARAMETER"), ("MEASURES", "SENSOR", "VARIABLE"),
    ("HAS", "MISSION", "DOCUMENT"), ("HAS", "PROJECT", "REPORT"), ("COVERS", "SATELLITE", "REGION"), ("COVERS", "INSTRUMENT", "REGION"),
    ("COVERS", "DATA_PRODUCT", "REGION"), ("LOCATED_IN", "STATION", "REGION"), ("LOCATED_IN", "OBSERVATORY", "REGION"),
]

#: Mentions of a document or sentence that are paired in one place; what a pair without a relation is called.
MENTIONS, NONE = 256, "NONE"


def sentence_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent, s_start, s_end): offsets are running sums within the row, so nothing is shuffled."""
    lengths = F.transform(sentences(F.col(text)), lambda s: F.length(s))
    spans = bound(lengths, lambda n: F.zip_with(n, running_sums(n), lambda k, end: F.struct((end - k).alias("s_start"), end.alias("s_end"))))
    return docs.select(key, F.posexplode(spans).alias("sent", "s")).select(key, "sent", "s.*")


def in_sentences(docs: DataFrame, mentions: DataFrame, key: str = "doc_id", least: int = 2) -> DataFrame:
    """Mentions of field 'text' with the sentence that contains them, of sentences with at least `least` of them.

    Sentences and mentions of a document are put in one order by place, and each mention takes the last sentence before
    it, so that their numbers add up and never multiply.
    """
    m = mentions.where("field = 'text'")
    both = m.unionByName(sentence_rows(docs, key).withColumn("start", F.col("s_start")), allowMissingColumns=True)
    so_far = Window.partitionBy(key).orderBy("start", F.col("s_start").isNull())
    last = lambda c: F.last(c, ignorenulls=True).over(so_far).alias(c)
    placed = both.select(*m.columns, F.col("s_start").isNotNull().alias("__sentence"), last("sent"), last("s_start"), last("s_end"))
    out = placed.where(~F.col("__sentence") & (F.col("end") <= F.col("s_end"))).drop("__sentence")
    return out.withColumn("__n", F.count("*").over(Window.partitionBy(key, "sent"))).where(F.col("__n") >= least).drop("__n")


def blocked(rows: DataFrame, group: list[str], size: int = MENTIONS) -> DataFrame:
    """rows with block and blocks: each group's rows are dealt to blocks of about `size` by a hash of all their columns."""
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    return rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64(*rows.columns), F.col("blocks")).cast("int"))


def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Each row of left with each of right that is equal in `on`; both are blocked by the same groups.

    Every two blocks of a group meet under a key of their own, so that no task and no row holds all of a group's pairs.
    """
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = left.withColumnRenamed("block", "of_left").withColumn("of_right", every).drop("blocks")
    b = right.withColumnRenamed("block", "of_right").withColumn("of_left", every).drop("blocks")
    return a.join(b, [*on, "of_left", "of_right"]).drop("of_left", "of_right")


def placed_pairs(placed: DataFrame, key: str = "doc_id", both: bool = True, size: int = MENTIONS) -> DataFrame:
    """Every two mentions of a sentence, in both directions if asked, with `forward` (the head stands first), the places
    a, a_end, b, b_end of the first and the second, and the sentence's s_start and s_end.

    Equal mentions of a sentence are one, so a sentence that repeats a name doesn't square it; a sentence of more than
    `size` mentions is paired block by block.
    """
    m = placed.groupBy(key, "sent", "text", "label").agg(F.min(F.struct("start", "end", "s_start", "s_end")).alias("at"))
    m = blocked(m, [key, "sent"], size)
    at = [key, "sent", "block", "blocks"]
    a = m.select(*at, F.col("text").alias("head"), F.col("label").alias("head_type"), F.col("at.start").alias("a"), F.col("at.end").alias("a_end"), "at.s_start", "at.s_end")
    b = m.select(*at, F.col("text").alias("tail"), F.col("label").alias("tail_type"), F.col("at.start").alias("b"), F.col("at.end").alias("b_end"))
    pairs = met(a, b, [key, "sent"]).where("a < b").withColumn("forward", F.lit(True))
    if both:
        turned = {"head": "tail", "head_type": "tail_type", "tail": "head", "tail_type": "head_type"}
        pairs = pairs.unionByName(pairs.withColumnsRenamed({k: f"__{v}" for k, v in turned.items()}).withColumnsRenamed({f"__{v}": v for v in turned.values()}).withColumn("forward", F.lit(False)))
    return pairs


def sentence_pairs(placed: DataFrame, key: str = "doc_id", both: bool = True, size: int = MENTIONS) -> DataFrame:
    """(key, sent, head, head_type, tail, tail_type) of placed_pairs()."""
    return placed_pairs(placed, key, both, size).select(key, "sent", "head", "head_type", "tail", "tail_type")


def explicit(docs: DataFrame, patterns: list[tuple[str, str, str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Relations from patterns(type, head type, tail type, regex with groups 1 head, 2 verb, 3 tail); evidence is the text."""
    hits = F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.struct(F.lit(kind).alias("type"), F.lit(h).alias("head_type"), F.lit(t).alias("tail_type"), F.regexp_extract_all(text, F.lit(p), 1).alias("heads"), F.regexp_extract_all(text, F.lit(p), 3).alias("tails"))) for kind, h, t, p in patterns])
    found = docs.select(key, F.col(text).alias("evidence"), F.inline(F.array_compact(hits)))
    return found.select(key, "evidence", "type", "head_type", "tail_type", F.inline(F.arrays_zip(F.col("heads").alias("head"), F.col("tails").alias("tail"))), F.lit("explicit_pattern").alias("source"))


def valid_types(relations: DataFrame, schema: DataFrame) -> DataFrame:
    """Relations whose types the schema allows; the schema is a small table of rules."""
    return relations.join(F.broadcast(schema), ["type", "head_type", "tail_type"], "left_semi")


def schema_frame(spark, rows: list[tuple[str, str, str]] = SCHEMA) -> DataFrame:
    return spark.createDataFrame(rows, "type string, head_type string, tail_type string")


def co_occurring(docs: DataFrame, mentions: DataFrame, schema: DataFrame, key: str = "doc_id", text: str = "text", size: int = MENTIONS) -> DataFrame:
    """Relations between mentions of one document whose types fit the schema, with the text around them as evidence.

    Mentions are made distinct per document, and types that no rule names are dropped, before they are paired block by
    block. Of a pair that fits in both directions, the one that stands first in the text is the head. Pairs stream past
    their document's text, which is held once.
    """
    m = mentions.where("field = 'text'").groupBy(key, "text", "label").agg(F.min(F.struct("start", "end")).alias("at"))
    m = blocked(m, [key], size)
    at = [key, "block", "blocks"]
    heads = m.join(F.broadcast(schema), m.label == schema.head_type).select(*at, F.col("text").alias("head"), "head_type", "type", "tail_type", F.col("at").alias("a"))
    tails = m.select(*at, F.col("text").alias("tail"), F.col("label").alias("tail_type"), F.col("at").alias("b"))
    pairs = met(heads, tails, [key, "tail_type"]).where((F.col("head") != F.col("tail")) & ((F.col("a.start") < F.col("b.start")) | (F.col("head_type") != F.col("tail_type"))))
    pairs = pairs.select(key, "head", "head_type", "type", "tail", "tail_type", F.least("a.start", "b.start").alias("s"), F.greatest("a.end", "b.end").alias("e"))
    held = pairs.join(docs.select(key, F.col(text).alias("body")), key)
    return held.select(key, "head", "head_type", "type", "tail", "tail_type", context_of(F.col("body"), F.col("s"), F.col("e")).alias("evidence"), F.lit("pattern").alias("source"))


def pair_words(docs: DataFrame, pairs: DataFrame, key: str = "doc_id", text: str = "text", near: int = 3) -> DataFrame:
    """placed_pairs() with `words`: those between the two mentions and `near` before and after them in the sentence, each
    with where it stands and the pair's direction.

    The mentions themselves and their types are left out, here and wherever they are repeated, so that nothing of what a
    pair is called can be read off its words. Pairs stream past their document's text.
    """
    held = pairs.join(docs.select(key, F.col(text).alias("__body")), key)
    cut = lambda low, high: F.filter(F.split(F.lower(F.substring("__body", F.col(low) + 1, F.col(high) - F.col(low))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & (w != F.lower("head")) & (w != F.lower("tail")))
    side = F.when(F.col("forward"), "f").otherwise("r")
    named = lambda words, place: F.transform(words, lambda w: F.concat_ws("|", side, F.lit(place), w))
    before = F.slice(F.reverse(cut("s_start", "a")), 1, near)
    return held.withColumn("words", F.concat(named(before, "before"), named(cut("a_end", "b"), "between"), named(F.slice(cut("b_end", "s_end"), 1, near), "after"))).drop("__body")


def with_known(rows: DataFrame, known: DataFrame, schema: DataFrame) -> DataFrame:
    """Pairs whose types some rule allows, with `label`: the type of a pair in known(head, type, tail), at most one of
    each pair; NONE for others."""
    allowed = rows.join(F.broadcast(schema.select("head_type", "tail_type").distinct()), ["head_type", "tail_type"], "left_semi")
    return allowed.join(known.select("head", "tail", F.col("type").alias("label")), ["head", "tail"], "left").withColumn("label", F.coalesce("label", F.lit(NONE)))


def fold_of(key: str) -> Column:
    """The half of the documents that one belongs to; each is scored by the model of the other."""
    return F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(2))


def distant_model(rows: DataFrame, sample: int = 20_000, features: int = 1 << 14, least: int = 5) -> PipelineModel:
    """Multinomial regression on the words of rows(words, label), as labelled by distant supervision.

    About `sample` rows are fitted, shared evenly by the labels and chosen by a hash, whatever the input's size. Labels of
    fewer than `least` rows count as NONE.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row a label
    kinds = sorted(k for k, n in counts.items() if n >= least and k != NONE)
    kind = F.when(F.col("label").isin(kinds), F.col("label")).otherwise(NONE) if kinds else F.lit(NONE)
    part = lambda k: min(1.0, sample / (len(kinds) + 1) / max(counts.get(k, 0), 1))
    share = F.lit(part(NONE))
    for k in kinds:
        share = F.when(F.col("label") == k, part(k)).otherwise(share)
    chosen = F.pmod(F.xxhash64("words", "label"), F.lit(1 << 30)) < share * (1 << 30)
    taken = written(rows.where(chosen).select("words", kind.alias("label")), "distant-sample")
    names = StringIndexer(inputCol="label", outputCol="number", stringOrderType="alphabetAsc", handleInvalid="keep").fit(taken.unionByName(taken.sparkSession.createDataFrame([([], NONE)], taken.schema)))
    stages = [
        HashingTF(inputCol="words", outputCol="features", numFeatures=features, binary=True),
        LogisticRegression(labelCol="number", maxIter=15, regParam=1e-3, family="multinomial"),
        IndexToString(inputCol="prediction", outputCol="guess", labels=names.labels + [NONE]),
    ]
    return Pipeline(stages=stages).fit(names.transform(taken.unionByName(taken.sparkSession.createDataFrame([([], NONE)], taken.schema))))


def cross_scored(rows: DataFrame, models: list[PipelineModel], key: str = "doc_id") -> DataFrame:
    """rows(key, words) with the type that the model of the other half of the documents gives (NONE for no relation)."""
    parts = [models[1 - i].transform(rows.where(fold_of(key) == i)).select(*rows.columns, F.col("guess").alias("type")) for i in (0, 1)]
    return parts[0].unionByName(parts[1])


def predicted(scored: DataFrame, schema: DataFrame) -> DataFrame:
    """Relations of scored pairs, kept where the schema allows them."""
    return valid_types(scored.where(F.col("type") != NONE), schema).withColumn("source", F.lit("model"))


def held_out(scored: DataFrame) -> DataFrame:
    """One row of measures of scored pairs with a label, over all types but NONE; undefined ones are 0."""
    y, p = F.col("label"), F.col("type")
    c = scored.agg(F.count_if((y == p) & (y != NONE)).alias("tp"), F.count_if((y != p) & (p != NONE)).alias("fp"), F.count_if((y != p) & (y != NONE)).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def counts(mentions: DataFrame, relations: DataFrame, key: str = "doc_id") -> DataFrame:
    e = mentions.groupBy(key).agg(F.count("*").alias("entity_count"))
    r = relations.groupBy(key).agg(F.count("*").alias("relation_count"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return e.join(r, key, "full").select(key, zero("entity_count"), zero("relation_count"))

