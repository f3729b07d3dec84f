"""Graph queries answered in bulk: a table of queries joins the graph. CONTAINS counts both ways, with case."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.chunks import first_names
from corpusloom.sources.scratch import written

#: Texts of a segment, as a power of two: the places of one list of postings.
SEGMENT = 14
#: Parts that are verified on one copy of a text.
TOGETHER = 1000
#: Satellites that answer most queries by region and parameter.
FIRST = 256


class Index(NamedTuple):
    """texts(number, whole, ...) and the postings of their strings: lists(gram, segment, places), places sorted. A text's
    number is its segment and its place there; a list holds one segment, so it is bounded however common its string."""

    texts: DataFrame
    lists: DataFrame


def strings_of(text: Column) -> Column:
    """The distinct strings of three characters in a text, and the shorter ones at its end, in one scan."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(.{1,3}))"), F.lit(1)))


def index(rows: DataFrame, text: str) -> Index:
    """Numbers the rows that have a text (they are written once) and posts the strings of each text under its number."""
    texts = written(rows.withColumnRenamed(text, "whole").where("whole IS NOT NULL").withColumn("number", F.monotonically_increasing_id()), "texts")
    place = F.col("number").bitwiseAND((1 << SEGMENT) - 1).cast("int")
    strings = texts.select(F.shiftright("number", SEGMENT).alias("segment"), place.alias("place"), F.explode(strings_of(F.col("whole"))).alias("gram"))
    return Index(texts, strings.groupBy("gram", "segment").agg(F.sort_array(F.collect_list("place")).alias("places")))


def held(texts: Index, parts: DataFrame, part: str) -> DataFrame:
    """(part, number, whole, ...) of all indexed texts that contain a distinct part; nulls match nothing.

    A part is looked up by its two rarest strings of three characters: their lists are intersected segment by segment,
    and each text found is fetched once to verify its parts. A part with a string that no text holds is dropped at once.
    Parts of one or two characters are looked up as beginnings of strings. An empty part is in every text.
    """
    p = parts.select(F.col(part).alias("part")).where("part IS NOT NULL").distinct()
    counts = texts.lists.groupBy("gram").agg(F.sum(F.size("places")).alias("n"))
    own = p.where(F.length("part") > 2).select("part", F.explode(strings_of(F.col("part"))).alias("gram")).where(F.length("gram") == 3)
    rare = own.join(counts, "gram", "left").groupBy("part").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("rare"))
    two = rare.where("rare[0].n > 0").select("part", F.col("rare")[0]["gram"].alias("first"), F.coalesce(F.get("rare", F.lit(1)), F.get("rare", F.lit(0)))["gram"].alias("second"))
    both = two.join(texts.lists.select(F.col("gram").alias("first"), "segment", "places"), "first").join(texts.lists.select(F.col("gram").alias("second"), "segment", F.col("places").alias("more")), ["second", "segment"])
    found = both.select("part", "segment", F.explode(F.array_intersect("places", "more")).alias("place"))
    begin = texts.lists.select("segment", "places", F.explode(F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2)), lambda n: F.substring("gram", F.lit(1), n)))).alias("part"))
    short = begin.join(p.where(F.length("part").between(1, 2)), "part").select("part", "segment", F.explode("places").alias("place")).distinct()
    found = found.unionByName(short).select("part", F.shiftleft("segment", SEGMENT).bitwiseOR(F.col("place")).alias("number"))
    turn = F.floor(F.row_number().over(Window.partitionBy("number").orderBy("part")) / TOGETHER)
    found = found.withColumn("turn", turn).groupBy("number", "turn").agg(F.collect_list("part").alias("parts")).drop("turn")
    hits = texts.texts.join(found, "number").withColumn("part", F.explode(F.filter("parts", lambda x: F.col("whole").contains(x)))).drop("parts")
    empty = texts.texts.withColumn("part", F.lit("")).join(F.broadcast(p.where("part = ''")), "part", "left_semi")  # one row at most
    return hits.unionByName(empty)


def containing(texts: DataFrame, parts: DataFrame, text: str, part: str) -> DataFrame:
    """(text, part) of distinct texts and parts where the text contains the part."""
    found = held(index(texts.select(text).distinct(), text), parts, part)
    return found.select(F.col("whole").alias(text), F.col("part").alias(part))


def matching(names: DataFrame, queries: DataFrame, name: str, query: str) -> DataFrame:
    """(name, query) of distinct names and queries of which one contains the other."""
    known = index(names.select(name).distinct(), name)
    found = held(known, queries, query).select(F.col("whole").alias(name), F.col("part").alias(query))
    return found.unionByName(containing(queries, known.texts, query, "whole").withColumnRenamed("whole", name)).distinct()


def top(rows: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def _foremost(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """All rows of the first n values of `order` under each key."""
    return rows.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n).drop("place")


def by_satellite(queries: DataFrame, provides: DataFrame, n: int = 10, satellites: DataFrame | None = None) -> DataFrame:
    """queries(sat) -> (sat, satellite, product): names are matched first, edges then joined by equality.

    Here and below, names may be given as matched already: satellites(satellite, sat), parameters(name, param) and
    regions(region, region_q).
    """
    s = matching(provides, queries, "satellite", "sat") if satellites is None else satellites
    hits = queries.select("sat").distinct().join(s, "sat").join(provides, "satellite").select("sat", "satellite", "product").distinct()
    return top(hits, ["sat"], ["satellite", "product"], n)


def by_satellite_and_parameter(queries: DataFrame, provides: DataFrame, measures: DataFrame, n: int = 10, satellites: DataFrame | None = None, parameters: DataFrame | None = None) -> DataFrame:
    """queries(sat, param): products of matching satellites that measure a matching parameter."""
    p = matching(measures, queries, "name", "param") if parameters is None else parameters
    p = p.join(measures, "name").select("param", "product", F.col("name").alias("parameter"))
    s = matching(provides, queries, "satellite", "sat") if satellites is None else satellites
    s = s.join(provides, "satellite").select("sat", "satellite", "product")
    hits = queries.select("sat", "param").distinct().join(s, "sat").join(p, ["param", "product"]).select("sat", "param", "satellite", "product", "parameter").distinct()
    return top(hits, ["sat", "param"], ["satellite", "product", "parameter"], n)


def by_region_and_parameter(queries: DataFrame, provides: DataFrame, covers: DataFrame, measures: DataFrame, n: int = 10, regions: DataFrame | None = None, parameters: DataFrame | None = None, satellites: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """queries(region_q, param): two hops, region <- covers - product <- provides - satellite.

    Hits are ordered by satellite, so where all satellites(satellite) are given, those of the `first` names answer each query
    that has n hits among them, and the other queries alone meet all satellites.
    """
    asked = written(queries.select("region_q", "param").distinct(), "asked")
    r = matching(covers, asked, "region", "region_q") if regions is None else regions
    p = matching(measures, asked, "name", "param") if parameters is None else parameters
    r, p = written(asked.join(r, "region_q").select("region_q", "region").distinct(), "regions"), written(asked.join(p, "param").select("param", "name").distinct(), "parameters")

    if r.isEmpty() or p.isEmpty():
        return asked.limit(0).select("region_q", "param", *[F.lit("").alias(c) for c in ("satellite", "product", "region")], F.lit(0).alias("rank"))

    def answers(asked: DataFrame, provides: DataFrame) -> DataFrame:
        """A product gives its least satellite as a hit, so the n products that come first by it hold a query's first n hits, and n
        satellites of each: other hits are never made. They are looked for by region and name, which queries share."""
        pairs = asked.join(r, "region_q").join(p, "param").select("region_q", "param", "region", "name")
        held = written(first_names(provides, ["product"], "satellite", n, "satellites"), "first-satellites")
        least = held.select("product", F.col("satellites")[0].alias("least"))
        measured = measures.join(pairs.select("name").distinct(), "name", "left_semi").select("product", "name").join(least, "product")
        found = covers.join(pairs.select("region").distinct(), "region", "left_semi").select("product", "region").join(measured, "product")
        found = _foremost(found, ["region", "name"], ["least", "product"], n)
        found = _foremost(pairs.join(found, ["region", "name"]), ["region_q", "param"], ["least", "product"], n)
        hits = found.join(held, "product").select("region_q", "param", F.explode("satellites").alias("satellite"), "product", "region").distinct()
        return top(hits, ["region_q", "param"], ["satellite", "product", "region"], n)

    some = [] if satellites is None else satellites.where("satellite IS NOT NULL").select("satellite").distinct().orderBy("satellite").limit(first + 1).collect()
    if len(some) <= first:
        return answers(asked, provides)
    early = written(answers(asked, provides.where(F.col("satellite") <= some[first - 1]["satellite"])), "early-answers")
    whole = early.where(F.col("rank") == n).select("region_q", "param")
    rest = asked.join(whole, ["region_q", "param"], "left_anti")
    if rest.isEmpty():
        return early
    return early.join(whole, ["region_q", "param"], "left_semi").unionByName(answers(written(rest, "unanswered"), provides))


def by_parameter(queries: DataFrame, measures: DataFrame, n: int = 10, parameters: DataFrame | None = None) -> DataFrame:
    p = matching(measures, queries, "name", "param") if parameters is None else parameters
    hits = queries.select("param").distinct().join(p, "param").join(measures, "name").select("param", "product", F.col("name").alias("parameter")).distinct()
    return top(hits, ["param"], ["product", "parameter"], n)


def found_nodes(queries: DataFrame, nodes: DataFrame, n: int = 10) -> DataFrame:
    """queries(q) -> (q, label, name) of up to n nodes each."""
    return top(matching(nodes, queries, "name", "q").join(nodes.select("label", "name"), "name"), ["q"], ["label", "name"], n).drop("rank")


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, n: int = 10, neighbours: int = 5) -> DataFrame:
    """queries(q) -> up to n nodes each, with up to `neighbours` distinct outgoing neighbours, both in order."""
    hits = found_nodes(queries, nodes, n)
    out = edges.join(hits.select(F.col("label").alias("h_label"), F.col("name").alias("h_name")).distinct(), ["h_label", "h_name"], "left_semi")
    near = top(out.select("h_label", "h_name", F.col("t_name").alias("name"), F.col("t_label").alias("kind"), F.col("type").alias("rel")).distinct(), ["h_label", "h_name"], ["name", "kind", "rel"], neighbours)
    near = near.groupBy(F.col("h_label").alias("label"), F.col("h_name").alias("name0")).agg(F.array_sort(F.collect_list(F.struct("name", "kind", "rel"))).alias("neighbours"))
    joined = hits.join(near, (hits.label == near.label) & (hits.name == near.name0), "left")
    return joined.select("q", hits.label, hits.name, F.coalesce("neighbours", F.array().cast("array<struct<name:string,kind:string,rel:string>>")).alias("neighbours"))


def products_of(queries: DataFrame, provides: DataFrame) -> DataFrame:
    return queries.select("satellite").distinct().join(provides, "satellite")


def measured_by(queries: DataFrame, measures: DataFrame) -> DataFrame:
    """queries(name) -> who measures it, over reversed MEASURES edges."""
    return queries.select("name").distinct().join(measures, "name")


def mentioned_in(queries: DataFrame, mentions: DataFrame) -> DataFrame:
    """queries(name) -> distinct (name, source, label) of its mentions."""
    return mentions.join(queries.select(F.col("name").alias("text")).distinct(), "text").select(F.col("text").alias("name"), "source", "label").distinct()


def catalog(satellites: DataFrame, instruments: DataFrame, provides: DataFrame) -> DataFrame:
    """(satellite, instruments, products): both sides are aggregated before they are joined, so they never multiply."""
    i = instruments.groupBy("satellite").agg(F.array_sort(F.collect_set("instrument")).alias("instruments"))
    p = provides.groupBy("satellite").agg(F.array_sort(F.collect_set("product")).alias("products"))
    none = F.array().cast("array<string>")
    out = satellites.select("satellite").distinct().join(i, "satellite", "left").join(p, "satellite", "left")
    return out.select("satellite", F.coalesce("instruments", none).alias("instruments"), F.coalesce("products", none).alias("products"))


# The catalog's filters, as patterns over product names.
FILTERS = {"ocean": "sea|ocean|wave|wind", "weather": "rain|humidity|cyclone|tpw|olr", "land": "land|vegetation|imagery"}


def search_catalog(rows: DataFrame, term: str = "", kind: str | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """Catalog rows whose name, an instrument or a product holds the term, and with a product of the kind."""
    t = term.lower()
    has = lambda c: F.exists(c, lambda x: F.lower(x).contains(t))
    out = rows.where(F.lower("satellite").contains(t) | has("instruments") | has("products"))
    if kind:
        pattern = (FILTERS if filters is None else filters)[kind]
        out = out.where(F.exists("products", lambda x: x.rlike("(?i)" + pattern)))
    return out
