"""Entity mentions from gazetteers, patterns and rules. All word lists are arguments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

MENTIONS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
COORDINATES = r"\d+(?:\.\d+)?° ?[NS], ?\d+(?:\.\d+)?° ?[EW]|\d+-\d+°[NSEW]|\d+°[NSEW]"
# Words that make a mention a data product or a region, in this order.
PRODUCT_WORDS = ["data", "product", "dataset", "measurement", "observation", "parameter", "variable"]
GEO_WORDS = ["sea", "ocean", "bay", "gulf", "region", "area", "coast", "peninsula", "territory", "zone"]
CONTEXT = 50


#: Candidates up to which a chain of expressions is cheaper than an automaton.
FEW = 16
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Automaton:
    """All terms of a list in one pass over a text, at a cost that doesn't grow with their number (Aho and Corasick).

    Travels as the list of terms; the automaton is built where it is first used, once a worker and list.
    """

    _built: dict[tuple[str, ...], ahocorasick.Automaton] = {}

    def __init__(self, terms: list[str]):
        self.terms = tuple(terms)

    def found(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the term) of each occurrence on boundaries of ASCII words, overlapping ones too, by end."""
        if (a := self._built.get(self.terms)) is None:
            if len(self._built) >= 8:
                self._built.clear()
            a = self._built[self.terms] = ahocorasick.Automaton()
            for i, t in reversed(list(enumerate(self.terms))):  # of equal terms the first one counts
                if t:
                    a.add_word(t, (i, len(t)))
            a.make_automaton()
        if not len(a):
            return
        for last, (i, n) in a.iter(text):
            start = last + 1 - n
            if (not start or text[start - 1] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
                yield start, last + 1, i

    def longest(self, text: str) -> list[tuple[int, int, int]]:
        """The longest occurrence at each place, from the left, none overlapping."""
        out, end = [], 0
        for start, last, i in sorted(self.found(text), key=lambda m: (m[0], -m[1])):
            if start >= end:
                out.append((start, last, i))
                end = last
        return out


def mentions_in(text: Column, gazetteer: list[tuple[str, str]]) -> Column:
    """array of mentions of gazetteer(label, term): the longest match at each place, none overlapping.

    A vectorized helper: the terms are broadcast and make one automaton a worker. A term with several labels has the
    first; a null text has no mentions, and an empty term is never found.
    """
    labels = list({term: label for label, term in reversed(gazetteer)}.items())
    held = SparkSession.active().sparkContext.broadcast((Automaton([t for t, _ in labels]), labels))

    @pandas_udf(MENTIONS)
    def find(texts: pd.Series) -> pd.Series:
        terms, labels = held.value
        return texts.map(lambda t: [{"text": labels[i][0], "label": labels[i][1], "start": a, "end": b} for a, b, i in terms.longest(t or "")])

    return find(text)


def extract(docs: DataFrame, gazetteer: list[tuple[str, str]], key: str = "doc_id", text: str = "text", metadata: str | None = None) -> DataFrame:
    """(key, field, ord, text, label, start, end) of mentions in the text and in each string of the metadata map."""
    fields = docs.select(key, F.lit("text").alias("field"), F.col(text).alias("value"))
    if metadata:
        fields = fields.unionByName(docs.select(key, F.explode(metadata).alias("field", "value")))
    found = fields.select(key, "field", F.posexplode(mentions_in(F.col("value"), gazetteer)).alias("ord", "m"))
    return found.select(key, "field", "ord", "m.*")


def acronym(term: Column) -> Column:
    return F.array_join(F.transform(F.split(term, " "), lambda w: F.left(w, F.lit(1))), "")


def coordinates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(COORDINATES), F.lit(0))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words]) if words else F.lit(False)


def relabel(mention: Column, label: Column, context: Column, products: list[str], satellites: list[str], geo: list[str] = GEO_WORDS, indicators: list[str] = PRODUCT_WORDS) -> Column:
    """The label that rules give a mention, in order: product name, product acronym, product word nearby, region, satellite."""
    low = F.lower(mention)
    short = (F.length(mention) <= 5) & ~mention.contains(" ") & mention.isin(*["".join(w[0] for w in p.split(" ") if w) for p in products])
    return (
        F.when(contains_any(low, [p.lower() for p in products]) | short | contains_any(F.lower(context), indicators), "DATA_PRODUCT")
        .when(label.isin("GPE", "LOC") | contains_any(low, geo), "REGION")
        .when((label == "ORG") & contains_any(mention, satellites), "SATELLITE")
        .otherwise(label)
    )


def context_of(text: Column, start: Column, end: Column, reach: int = CONTEXT) -> Column:
    """The text around [start, end), in code points."""
    low = F.greatest(start - reach, F.lit(0))
    return F.substring(text, low + 1, end + reach - low)


def refine(mention: Column, label: Column, classes: dict[str, list[str]]) -> Column:
    """The first class with a pattern found in the mention, whatever the case; else the label it has."""
    out = label
    for name, patterns in reversed(classes.items()):
        out = F.when(mention.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), name).otherwise(out)
    return out


def first_candidate(text: Column, candidates: list[str], few: int = FEW) -> Column:
    """The first candidate in list order that stands in the text as a word, whatever the case of ASCII letters; '' if none does.

    A long list is searched by an automaton, with the same result.
    """
    if len(candidates) <= few:
        return F.coalesce(*[F.when(text.rlike(rf"(?i)(^|[^A-Za-z0-9_]){re.escape(c)}($|[^A-Za-z0-9_])"), F.lit(c)) for c in candidates], F.lit(""))
    held = SparkSession.active().sparkContext.broadcast((Automaton([c.translate(_LOWER) for c in candidates]), candidates))

    @pandas_udf(T.StringType())
    def find(texts: pd.Series) -> pd.Series:
        terms, names = held.value
        first = lambda t: min((i for _, _, i in terms.found((t or "").translate(_LOWER))), default=None)
        return texts.map(lambda t: "" if (i := first(t)) is None else names[i])

    return find(text)


def consistent(label: Column, mention: Column, rules: list[tuple[str, list[str], str]]) -> Column:
    """rules of (label, words, new label): a mention with that label and one of the words gets the new label."""
    out = label
    for old, words, new in reversed(rules):
        out = F.when((label == old) & contains_any(mention, words), new).otherwise(out)
    return out


def regions_in(text: Column, registry: list[tuple[str, list[str], tuple[float, float, float, float]]]) -> Column:
    """array<struct<name, lat1, lon1, lat2, lon2>> of the registry's regions that a text names, in registry order."""
    low = F.lower(text)
    entries = [F.when(contains_any(low, patterns), F.struct(F.lit(name).alias("name"), *[F.lit(float(v)).alias(k) for k, v in zip(("lat1", "lon1", "lat2", "lon2"), box, strict=True)])) for name, patterns, box in registry]
    return F.array_compact(F.array(*entries))


def centre(regions: Column, default: tuple[float, float] = (15.0, 80.0)) -> Column:
    """Mean of the middles of the regions' boxes."""
    mean = lambda a, b: F.aggregate(regions, F.lit(0.0), lambda s, r: s + (r[a] + r[b]) / 2) / F.size(regions)
    some = F.size(regions) > 0
    return F.struct(F.when(some, mean("lat1", "lat2")).otherwise(default[0]).alias("lat"), F.when(some, mean("lon1", "lon2")).otherwise(default[1]).alias("lon"))
