"""Edges as text, a valid/junk classifier over them, and its measures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.graph import KEY
from corpusloom.sources.scratch import written

VERBALISED = ["PROVIDES", "COVERS", "MEASURES"]


def verbalise(edges: DataFrame, types: list[str] = VERBALISED) -> DataFrame:
    """Edges of these types with both names, and their text "head verb tail"."""
    out = edges.where(F.col("type").isin(*types) & F.col("h_name").isNotNull() & F.col("t_name").isNotNull())
    return out.withColumn("text", F.concat_ws(" ", "h_name", F.lower("type"), "t_name"))


def split(rows: DataFrame, label: str = "label", share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds train (boolean): exactly the floor of `share` of each class, chosen by a hash of the text.

    Rows are counted by stretches of the hash; only those of the stretch that holds a class's cut are ranked.
    """
    mark = rows.withColumn("__h", F.xxhash64("text", F.lit(seed))).withColumn("__at", F.shiftright("__h", 50))
    counts = mark.groupBy(label, "__at").agg(F.count("*").alias("n"))  # at most 16,384 rows a class
    of_class = Window.partitionBy(label)
    counts = counts.select(F.col(label).alias("__label"), F.col("__at").alias("__k"), F.sum("n").over(of_class.orderBy("__at")).alias("__upto"), "n", F.floor(F.sum("n").over(of_class) * share).alias("__most"))
    counts = counts.select("__label", "__k", (F.col("__most") - F.col("__upto") + F.col("n")).alias("__need"), F.col("n").alias("__n"))
    both = mark.join(counts, mark[label].eqNullSafe(F.col("__label")) & (F.col("__at") == F.col("__k")))
    open_ = (F.col("__need") > 0) & (F.col("__need") < F.col("__n"))
    ranked = both.where(open_).withColumn("train", F.row_number().over(Window.partitionBy(label, "__at").orderBy("__h", "text")) <= F.col("__need"))
    return both.where(~open_).withColumn("train", F.col("__need") > 0).unionByName(ranked).select(*rows.columns, "train")


def numbered(names: DataFrame, column: str, number: str, buckets: int = 1024) -> DataFrame:
    """Distinct names with numbers from 0 on: ranks within hash buckets, after the counts of the buckets before."""
    rows = names.select(column).distinct().withColumn("__b", F.pmod(F.xxhash64(column), F.lit(buckets)))
    counts = rows.groupBy("__b").agg(F.count("*").alias("n"))  # at most one row a bucket
    before = counts.select(F.col("__b").alias("__k"), (F.sum("n").over(Window.orderBy("__b")) - F.col("n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(column))
    return rows.withColumn("__r", rank).join(F.broadcast(before), F.col("__b") == F.col("__k")).select(column, (F.col("__before") + F.col("__r") - 1).alias(number))


def pipeline(features: int = 1 << 16, penalty: float = 1e-3) -> Pipeline:
    """Logistic regression on TF-IDF of words; of rows(text, label), label 0.0 or 1.0."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(maxIter=30, regParam=penalty),
    ])


#: Feature sizes and penalties that model selection tries, and its folds.
SIZES, PENALTIES, FOLDS = (1 << 12, 1 << 16), (1e-3, 1e-1), 2


def select_model(rows: DataFrame, sizes: Sequence[int] = SIZES, penalties: Sequence[float] = PENALTIES, folds: int = FOLDS) -> CrossValidatorModel:
    """Cross-validation by the F1 of label 1 over feature sizes and penalties; the best pair is fitted on all rows(text, label).

    Folds go by a hash of the text, so equal texts never stand on both sides and runs agree however rows are partitioned.
    Each fold and all rows need both labels.
    """
    p = pipeline()
    tf, regression = p.getStages()[1], p.getStages()[3]
    grid = ParamGridBuilder().addGrid(tf.numFeatures, list(sizes)).addGrid(regression.regParam, list(penalties)).build()
    f1 = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0)
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(folds)).cast("int").alias("fold")
    data = written(rows.select("text", F.col("label").cast("double").alias("label"), fold), "classifier-rows")
    return CrossValidator(estimator=p, estimatorParamMaps=grid, evaluator=f1, numFolds=folds, foldCol="fold", parallelism=2).fit(data)


def saved(folder: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """The model in a folder that all executors share; fitted and written there where there is none yet."""
    try:
        return PipelineModel.load(folder)
    except (Py4JJavaError, AnalysisException) as e:
        if not any(x in str(e) for x in ("does not exist", "PATH_NOT_FOUND", "empty collection")):
            raise
    fit().write().overwrite().save(folder)
    return PipelineModel.load(folder)


def score(edges: DataFrame, model: PipelineModel) -> DataFrame:
    """Verbalised edges with valid (boolean); each text is scored once."""
    rows = verbalise(edges)
    scored = model.transform(rows.select("text").distinct()).select("text", (F.col("prediction") == 1).alias("valid"))
    return rows.join(scored, "text").select(*KEY, "text", "valid")


def metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1; undefined measures are 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def positives(provides: DataFrame, n: int, least: int = 3) -> DataFrame:
    """n verbalised pairs whose product name has more than `least` characters, label 1."""
    good = provides.where(F.length("product") > least).select("satellite", "product").distinct()
    return good.orderBy("satellite", "product").limit(n).select(F.concat_ws(" ", "satellite", F.lit("provides"), "product").alias("text"), F.lit(1).alias("label"))


def permuted(number: Column, rows: int, columns: int, seed: int = 42, rounds: int = 6) -> tuple[Column, Column]:
    """Place number of a pseudo-random order of all cells of a table: its row and column.

    A Feistel network over the two numbers: each round shifts one by a hash of the other, which can be undone, so
    different places below rows * columns are different cells and none has to be remembered.
    """
    i, j = F.floor(number / columns).cast("long"), F.pmod(number, F.lit(columns))
    for r in range(rounds):
        shift = lambda x, n: F.pmod(F.xxhash64(x, F.lit(seed), F.lit(r)), F.lit(n))  # noqa: B023, E731
        i, j = (F.pmod(i + shift(j, rows), F.lit(rows)), j) if r % 2 == 0 else (i, F.pmod(j + shift(i, columns), F.lit(columns)))
    return i, j


def negatives(satellites: DataFrame, terms: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """min(n, all) different pseudo-random pairs of a distinct satellite and a distinct unfit term, label 0.

    Pairs are the first places of a permutation of all of them, so they are neither formed nor drawn twice.
    """
    s = written(numbered(satellites, "satellite", "i"), "satellites")
    t = written(numbered(terms.toDF("term"), "term", "j"), "terms")
    ns, nt = s.count(), t.count()
    i, j = permuted(F.col("id"), max(ns, 1), max(nt, 1), seed)
    drawn = satellites.sparkSession.range(min(n, ns * nt)).select(i.alias("i"), j.alias("j"))
    return drawn.join(s, "i").join(t, "j").select(F.concat_ws(" ", "satellite", F.lit("provides"), "term").alias("text"), F.lit(0).alias("label"))
